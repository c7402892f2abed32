"""Registered queries against their SQL on the small driver tables.

A cross-section runs by default; PAYTALLY_ALL=1 runs every query (as tools/check.py does).
"""

import os
import sys

import pytest

from paytally.plans.catalog import oracle_sql, queries

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

SF = os.environ.get("PAYTALLY_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = """etl_02_incremental_append dq_04_orphans kpi_09_mom_growth kpi_12_monthly_aov ch_09_mom
geo_04_category_tier mer_02_top cb_02_by_channel ub_07_deciles wn_16_trailing_30_day_users
co_05_milestones rf_03_qcut5 rf_09_snapshot_transition cl_04_rank_tiers cl_11_pareto cr_03_funnel_c
wi_01_full wi_06_channel_shift sx_06_mann_whitney ms_02_users exp_07_rfm""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("PAYTALLY_ALL") else SAMPLE)
def test_query_matches_sql(spark, con, name):
    note, _, fine = check.compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert fine, note


def test_every_query_has_sql():
    assert sorted(queries()) == sorted(oracle_sql())


def test_catalogue_loads_without_a_session():
    """Queries and SQL are listed before any Spark session exists."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import __spark_entry__ as e; from paytally.plans import catalog as c; "
            "print(len(c.queries()), len(set(c.queries()) & set(e.queries()) & set(e.oracle_sql())))")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    first, second = out.stdout.split()
    assert first == second
