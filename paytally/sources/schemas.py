"""Explicit schemas of the star tables; readers never infer types."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**columns):
    return StructType([StructField(name, kind) for name, kind in columns.items()])


FACT = _struct(
    transaction_id=LongType(),
    txn_ts=TimestampType(),
    txn_date=DateType(),
    customer_id=IntegerType(),
    merchant_id=IntegerType(),
    channel_id=IntegerType(),
    amount=DecimalType(12, 2),
    mdr_pct=DecimalType(6, 4),
    cashback_amt=DecimalType(10, 2),
    processing_fee_amt=DecimalType(10, 2),
    status=StringType(),
    retry_count=IntegerType(),
    settlement_date=DateType(),
    refunded_amt=DecimalType(10, 2),
    device_os=StringType(),
    city_id=IntegerType(),
    acquirer_id=IntegerType(),
)

DIM_DATE = _struct(
    date=DateType(),
    year=IntegerType(),
    month=IntegerType(),
    day=IntegerType(),
    week_of_year=IntegerType(),
    is_weekend=BooleanType(),
    holiday_flag=BooleanType(),
)

DIM_CHANNEL = _struct(channel_id=IntegerType(), channel_name=StringType())

DIM_CITY = _struct(
    city_id=IntegerType(), city_name=StringType(), state=StringType(), tier=StringType()
)

DIM_CUSTOMER = _struct(
    customer_id=IntegerType(),
    signup_date=DateType(),
    first_txn_date=DateType(),
    city_id=IntegerType(),
    segment_tag=StringType(),
)

DIM_MERCHANT = _struct(
    merchant_id=IntegerType(),
    category=StringType(),
    merchant_name=StringType(),
    city_id=IntegerType(),
)

# Dimensions first, so that a load never sees a fact row before its keys.
STAR = {
    "dim_date": DIM_DATE,
    "dim_channel": DIM_CHANNEL,
    "dim_city": DIM_CITY,
    "dim_customer": DIM_CUSTOMER,
    "dim_merchant": DIM_MERCHANT,
    "fact_transactions": FACT,
}
