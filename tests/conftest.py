import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paytally.plans.session import local_session  # noqa: E402
from paytally.sources.schemas import FACT  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return dt.date.fromisoformat(text) if text else None


def payment(i, date, customer=1, amount="100.00", mdr="1.0000", cashback="0.10", fee="0.05",
            status="SUCCESS", retry=0, channel=1, city=1, merchant=1, settled=None, refunded="0"):
    d = day(date)

    def dec(v):
        return None if v is None else Decimal(v)

    ts = dt.datetime(d.year, d.month, d.day, 10, 30)
    return (i, ts, d, customer, merchant, channel, dec(amount), dec(mdr), dec(cashback), dec(fee),
            status, retry, day(settled) or d, dec(refunded), "Android", city, 7)


@pytest.fixture(scope="session")
def facts(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), FACT)

    return make


def rows(df, *keys):
    """Collected rows as dictionaries, by key when given."""
    out = [r.asDict() for r in df.collect()]
    if not keys:
        return out
    return {(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): r for r in out}
