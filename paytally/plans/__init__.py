"""Composed result packs, the query registry and its SQL counterparts."""
