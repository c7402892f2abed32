"""Payments analytics as Spark DataFrame operators."""
