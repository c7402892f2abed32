"""Scans with bad lines, merges into stored tables, maintained rollups and published runs."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from conftest import payment, rows
from pyspark.sql import functions as F

from paytally.functions.ordered import checkpointed
from paytally.operators import etl, rollup
from paytally.plans import catalog_loading, catalog_platform, export
from paytally.sources import schemas
from paytally.sources.csvscan import split_csv
from paytally.sources.readers import read_star


# --- CSV ---------------------------------------------------------------------------------------

def test_bad_lines_are_kept_and_counted(spark, tmp_path):
    lines = ["city_id,city_name,state,tier", '1,"A, with comma",S,Tier-1', "x,B,S,Tier-1", "2,C", "3,D,S,Tier-2,more",
             '4,"quote ""in"" it",,Tier-3', "", "99999999999,E,S,Tier-1"]
    (tmp_path / "dim").mkdir()
    (tmp_path / "dim" / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "dim" / "b.csv").write_text(lines[0] + "\n5,F,S,Tier-1\n")
    found = split_csv(spark, str(tmp_path / "dim"), schemas.DIM_CITY, str(tmp_path / "out"))
    assert sorted(r["city_id"] for r in rows(found.good)) == [1, 4, 5]
    assert rows(found.good, "city_id")[4]["city_name"] == 'quote "in" it'
    assert {r["line"]: r["problems"] for r in rows(found.bad)} == {
        "x,B,S,Tier-1": ["city_id"], "2,C": ["fields"], "3,D,S,Tier-2,more": ["fields"], "99999999999,E,S,Tier-1": ["city_id"]}
    assert (found.lines, found.bad_lines) == (7, 4)
    assert found.good.schema == schemas.DIM_CITY
    # The verdict on a line does not depend on the columns read.
    assert sorted(r["tier"] for r in rows(found.good.select("tier"))) == ["Tier-1", "Tier-1", "Tier-3"]


def test_empty_csv_and_wrong_header(spark, tmp_path):
    (tmp_path / "none.csv").write_text("city_id,city_name,state,tier\n")
    found = split_csv(spark, str(tmp_path / "none.csv"), schemas.DIM_CITY, str(tmp_path / "o"))
    assert (found.lines, found.bad_lines, found.good.count(), found.bad.count()) == (0, 0, 0, 0)
    (tmp_path / "wrong.csv").write_text("city_id,state,city_name,tier\n1,a,b,c\n")
    with pytest.raises(Exception, match="(?i)header"):
        split_csv(spark, str(tmp_path / "wrong.csv"), schemas.DIM_CITY, str(tmp_path / "p"))


# --- merge -------------------------------------------------------------------------------------

def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def batch_of(spark, *updates):
    schema = "transaction_id long, txn_date date, refunded_amt decimal(10,2), settlement_date date"
    return spark.createDataFrame([(i, dt.date.fromisoformat(d) if d else None, Decimal(a), dt.date(2025, 6, 1))
                                  for i, d, a in updates], schema)


@pytest.mark.parametrize("grain", ["day", "month", "year"])
@pytest.mark.parametrize("dated", [True, False])
def test_merge_replaces_only_what_changes(spark, facts, tmp_path, grain, dated):
    path = f"{tmp_path}/fact"
    old = facts(payment(1, "2024-01-05"), payment(2, "2025-01-06"), payment(3, "2025-02-07"), payment(4, "2025-02-08"))
    etl.save_by_period(old, path, grain)
    before = files(path)
    batch = batch_of(spark, (2, "2025-01-06", "5.00"), (2, "2025-01-06", "4.00"), (9, "2025-01-06", "7.00"))
    if not dated:
        batch = batch.drop("txn_date")
    want = {r["transaction_id"]: r for r in rows(etl.upsert_refunds(old, batch))}
    report = rows(etl.merge_refunds(spark, path, batch, grain))
    assert sum(r["updated"] for r in report) == 1 and sum(r["inserted"] for r in report) == 1
    got = {r.pop("transaction_id"): r for r in rows(etl.stored_fact(spark, path).drop("period"))}
    assert got == {i: {k: v for k, v in r.items() if k != "transaction_id"} for i, r in want.items()}
    after = files(path)
    untouched = {f for f in before if "2024" in f}
    assert untouched and all(after.get(f) == before[f] for f in untouched)
    if grain == "day":
        assert sum(after.get(f) == t for f, t in before.items()) == 3
    if dated:  # without dates a new id has no period to be found in but its own
        assert rows(etl.merge_refunds(spark, path, batch, grain)) == [] and files(path) == after


def test_merge_again_without_dates(spark, facts, tmp_path):
    path = f"{tmp_path}/fact"
    etl.save_by_period(facts(payment(1, "2025-01-05"), payment(2, "2025-01-06")), path)
    batch = batch_of(spark, (2, None, "5.00"), (9, None, "7.00")).drop("txn_date")
    assert sum(r["inserted"] for r in rows(etl.merge_refunds(spark, path, batch))) == 1
    before = files(path)
    assert rows(etl.merge_refunds(spark, path, batch)) == [] and files(path) == before
    assert etl.stored_fact(spark, path).count() == 3


def test_merge_reads_only_the_periods_of_the_batch(spark, facts, tmp_path):
    path = f"{tmp_path}/fact"
    etl.save_by_period(facts(*[payment(i, f"2025-01-{i:02d}") for i in range(1, 10)]), path)
    plan = etl.stored_fact(spark, path).filter(etl._within(["2025-01-03"]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "2025-01-03" in plan.split("PartitionFilters: [")[1].split("]")[0]
    empty = batch_of(spark)
    before = files(path)
    assert rows(etl.merge_refunds(spark, path, empty)) == [] and files(path) == before


# --- rollup ------------------------------------------------------------------------------------

def test_states_add_up(spark, facts):
    customers = [1, 1, 32_768, 32_769, 70_000, None, -3, 0]
    payments = [payment(i, f"2025-01-{1 + i % 3:02d}", customer=c, channel=1 + i % 2) for i, c in enumerate(customers)]
    f = facts(*payments, payment(90, "2025-01-01", customer=5, status="FAILED"))
    days = rollup.user_state(f, "txn_date", "channel_id")
    assert rows(rollup.count_users(days, by=["channel_id"]), "channel_id")[1]["unique_customers"] == 4
    whole = rollup.count_users(days, by=[F.lit("all").alias("k")])
    assert rows(whole)[0]["unique_customers"] == len({c for c in customers if c is not None})
    split = F.col("txn_date") < dt.date(2025, 1, 2)
    parts = [rollup.user_state(f.filter(c), "channel_id") for c in (split, ~split)]
    assert sorted(map(tuple, rollup.count_users(*parts, by=["channel_id"]).collect())) == \
        sorted(map(tuple, rollup.count_users(days, by=["channel_id"]).collect()))
    assert rollup.count_users(rollup.user_state(facts(), "txn_date"), by=["txn_date"]).count() == 0
    plan = rollup.count_users(days, by=["channel_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


# --- publishing --------------------------------------------------------------------------------

def one(n):
    return lambda star: star["fact_transactions"].limit(n).select("transaction_id")


def test_a_failed_run_leaves_the_old_one(spark, facts, tmp_path):
    star, out = {"fact_transactions": facts(*[payment(i, "2025-01-01") for i in range(5)])}, str(tmp_path / "out")
    first = export.publish(star, out, sets={"a": one(3), "b": one(5), "c": one(0)})
    assert {r["name"]: r["n_rows"] for r in rows(export.manifest(spark, out))} == {"a": 3, "b": 5, "c": 0}
    assert export.read_published(spark, out, "b").count() == 5

    def broken(star):
        return star["fact_transactions"].select(F.raise_error(F.lit("stop")).alias("x"))

    with pytest.raises(Exception, match="stop"):
        export.publish(star, out, sets={"a": one(1), "b": broken})
    assert export._run(spark, out).endswith(first) and export.read_published(spark, out, "a").count() == 3
    second = export.publish(star, out, fmt="csv", sets={"a": one(1)})
    assert export._run(spark, out).endswith(second) and export.read_published(spark, out, "a").count() == 1


def test_star_from_csv_still_fails_fast_by_default(spark, tmp_path):
    for name, schema in schemas.STAR.items():
        (tmp_path / name).write_text(",".join(schema.names) + "\n")
    (tmp_path / "dim_channel").write_text("channel_id,channel_name\nx,UPI\n")
    with pytest.raises(Exception):
        read_star(spark, str(tmp_path), "csv")["dim_channel"].collect()


# --- the fact is computed once -----------------------------------------------------------------

def counted(spark, f):
    """The frame, and a counter of the rows computed for it."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def pass_on(i):
        seen.add(1)
        return i

    return f.withColumn("transaction_id", pass_on.asNondeterministic()("transaction_id")), seen


def some_payments(facts):
    return facts(*[payment(i, f"2025-0{1 + i % 3}-05", customer=i % 4, status="FAILED" if i % 2 else "SUCCESS", city=i % 3)
                   for i in range(12)])


@pytest.mark.parametrize("again", [False, True])
def test_merge_computes_the_fact_once(spark, facts, again):
    f, seen = counted(spark, some_payments(facts))
    merged, report = catalog_loading._merged({"fact_transactions": f}, again)
    assert len(rows(report)) == (0 if again else 4)  # three months, and new ids without a date
    assert sorted(r["transaction_id"] for r in rows(merged)) == [-3, -2, -1, *range(12)]
    assert seen.value == 12


def test_merge_moves_whole_rows_only_into_the_table(spark, facts, tmp_path, monkeypatch):
    """Merged rows go to the table at once, not by way of a checkpoint; only the short report is one."""
    etl.save_by_period(some_payments(facts), f"{tmp_path}/fact", "month")
    kept = []
    monkeypatch.setattr(etl, "checkpointed", lambda df: kept.append(df.columns) or checkpointed(df))
    batch = batch_of(spark, (1, "2025-02-05", "5.00"), (50, "2025-03-05", "7.00"))
    assert sorted(map(tuple, etl.merge_refunds(spark, f"{tmp_path}/fact", batch, "month").collect())) == [
        ("2025-02", 1, 0), ("2025-03", 0, 1)]
    assert kept == [["period", "updated", "inserted"]]


@pytest.mark.parametrize("dated", [True, False])
def test_merge_of_repeated_null_and_misdated_ids(spark, facts, tmp_path, dated):
    """Each row of a repeated id is updated, null ids stay, an id is looked for in the periods of the batch."""
    old = facts(payment(1, "2025-01-05"), payment(1, "2025-01-05", amount="9.00"), payment(None, "2025-01-06"),
                payment(2, "2025-02-07"), payment(3, "2025-03-08"))
    etl.save_by_period(old, f"{tmp_path}/fact", "month")
    batch = batch_of(spark, (1, "2025-01-05", "5.00"), (2, "2025-02-07", "0.00"), (None, "2025-03-01", "8.00"),
                     (9, "2025-02-01", "7.00"))
    batch = batch.withColumn("settlement_date", F.when(F.col("transaction_id") == 2, F.lit(dt.date(2025, 2, 7)))
                             .otherwise(F.col("settlement_date")))
    report = etl.merge_refunds(spark, f"{tmp_path}/fact", batch if dated else batch.drop("txn_date"), "month")
    assert {r["period"]: (r["updated"], r["inserted"]) for r in rows(report)} == {
        "2025-01": (2, 0), "2025-02" if dated else None: (0, 1)}
    got = sorted((r["transaction_id"] or 0, r["refunded_amt"]) for r in rows(etl.stored_fact(spark, f"{tmp_path}/fact")))
    assert got == [(0, 0), (1, 5), (1, 5), (2, 0), (3, 0), (9, 7)]


def test_months_are_stored_without_a_shuffle_and_days_in_few_files(spark, facts, tmp_path):
    old = some_payments(facts).repartition(3)
    for grain in ("month", "day"):
        etl.save_by_period(old, f"{tmp_path}/{grain}", grain)
        assert sorted(r["transaction_id"] for r in rows(etl.stored_fact(spark, f"{tmp_path}/{grain}"))) == list(range(12))
    plans = []
    for grain in ("month", "day"):
        plans.append(etl._placed(old, grain)._jdf.queryExecution().optimizedPlan().toString())
    assert "xxhash64" not in plans[0] and "xxhash64" in plans[1]


def test_upsert_computes_the_fact_once(spark, facts):
    f, seen = counted(spark, some_payments(facts))
    found = rows(catalog_platform.upserted({"fact_transactions": f}), "transaction_id")
    assert sorted(found) == [-3, -2, -1, *range(12)] and seen.value == 12
    assert found[1]["refunded_amt"] == Decimal("100.00") and found[2]["refunded_amt"] == 0


def test_upsert_deals_the_fact_into_a_given_number_of_parts(spark, facts):
    """Parts sized by bytes held a growing number of rows: ids are a few bytes each when packed."""
    found = catalog_platform.upserted({"fact_transactions": some_payments(facts)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 or "ReusedExchange" in plan


def test_loaded_ids_are_not_grouped(spark, facts):
    """They serve an anti join, which does not need them distinct; grouping them filled two hash maps a task."""
    old = facts(payment(1, "2025-01-05"), payment(1, "2025-01-06"), payment(None, "2025-01-06"))
    ids = spark.createDataFrame([(1,), (2,)], "transaction_id long")
    found = etl._loaded_ids(old, ids)
    assert {r["transaction_id"] for r in rows(found)} == {1}
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_csv_counts_compute_the_fact_once(spark, facts):
    f, seen = counted(spark, some_payments(facts))
    cities = spark.createDataFrame([(1, "A", "S", "Tier-1"), (2, 'B, "b"', None, "")], schemas.DIM_CITY)
    found = rows(catalog_loading._csv_counts({"dim_city": cities, "fact_transactions": f}), "table_name")
    assert {n: (r["lines"], r["bad_lines"], r["good_rows"]) for n, r in found.items()} == {
        "dim_city": (2, 0, 2), "fact_transactions": (12, 0, 12), "damaged": (12, 1, 11)}
    assert seen.value == 12


@pytest.mark.parametrize("damaged", [False, True])
def test_csv_lines_are_compressed_into_short_files(spark, facts, tmp_path, monkeypatch, damaged):
    monkeypatch.setattr(catalog_loading, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setitem(catalog_loading.LINES, "maxRecordsPerFile", 5)
    star = {"fact_transactions": some_payments(facts).coalesce(1)}
    split = catalog_loading._damaged(star) if damaged else catalog_loading._csv(star, "fact_transactions")
    assert (split.lines, split.bad_lines, split.good.count()) == (12, damaged, 12 - damaged)
    names = [n for n in os.listdir(tmp_path / "csv" / "lines") if n.startswith("part-")]
    assert len(names) == 3 and all(n.endswith(".lz4") for n in names)


def test_a_published_run_computes_the_fact_once(spark, facts):
    f, seen = counted(spark, some_payments(facts))
    names = ["01_monthly_kpi", "11_cashback_roi", "12_whatif_scenarios"]
    found = catalog_loading._published({"fact_transactions": f}, names, export.manifest)
    assert sorted(r["name"] for r in rows(found)) == names and seen.value == 12
