"""The pipeline's stages against plain versions: nulls, repeated ids, equal rows, empty tables, clashing names."""

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from paytally.llm import quality_rules

from .conftest import HARD, SF
from .test_operators import plain_simhash, text_of

driver_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

BENCH = "one two three four five six seven eight nine ten eleven"
TOKENS = "alpha bravo carol delta eagle fever giant hotel india juice karma lemon"
SAME_ID = [(1, "first text with words of its own, long enough to be told apart " * 3),
           (1, "another document under the same number, about other things entirely " * 3),
           (None, "a text without any number that should stay where it is " * 4),
           (None, "a second text without number which differs from the first in all its words " * 3),
           (3, f"leaks {BENCH} here " + TOKENS), (3, "the third number again, but without a leak " + TOKENS * 2),
           (4, "equal rows " + TOKENS), (4, "equal rows " + TOKENS), (5, "equal rows " + TOKENS), (None, "equal rows " + TOKENS)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("a", BENCH), (None, "x"), ("b", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def stay(spark, stage, rows, folder, docs_of):
    docs = docs_of(rows, extra=True)
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert stage(spark, docs_of([], extra=True), folder).count() == 0
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_quality_judges_rows(spark, docs_of, folder, monkeypatch):
    """One good row keeps no other row of its id."""
    rows = [*HARD, *SAME_ID]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality_rules.score_texts(docs_of(rows), labels)
    good = scored.withColumn("predicted", (F.crc32("text_key") % 2 == 0).cast("int"))
    monkeypatch.setattr(quality_rules, "score_texts", lambda *a, **k: good)
    import hashlib
    import zlib

    want = Counter((i, t) for i, t in rows if zlib.crc32(hashlib.sha256(text_of(t).encode()).digest()) % 2 == 0)
    assert 3 < sum(want.values()) < len(rows)
    assert stay(spark, lambda s, d, f: pipeline.quality(s, d, f) if d.count() else d, rows, folder, docs_of) == want


def test_quality_of_an_empty_table(spark, docs_of, folder):
    assert pipeline.quality(spark, docs_of([], extra=True), folder).count() == 0


def test_one_row_of_each_component_stays(spark, docs_of, folder):
    rows = [*HARD, *SAME_ID]
    marks = {t: plain_simhash(t) for t in {text_of(t) for _, t in rows}}
    group = {t: t for t in marks}
    for a in marks:
        for b in marks:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                low, high = sorted((group[a], group[b]))
                group = {t: low if g == high else g for t, g in group.items()}
    members = defaultdict(list)
    for i, t in rows:
        members[group[text_of(t)]].append((i, t))
    got = stay(spark, pipeline.near_duplicates, rows, folder, docs_of)
    assert max(got.values()) == 1 and sum(got.values()) == len(members)
    for group_rows in members.values():
        kept = [r for r in got if r in group_rows]
        known = [i for i, _ in group_rows if i is not None]
        assert len(kept) == 1 and kept[0][0] == (min(known) if known else None)


def test_decontamination_judges_rows(spark, docs_of, folder):
    rows = [*HARD, *SAME_ID]
    want = Counter((i, t) for i, t in rows
                   if not re.search(r"(?<![a-z])" + " ".join(BENCH.split()[:10]), text_of(t)))
    assert (3, SAME_ID[4][1]) not in want and (3, SAME_ID[5][1]) in want
    assert stay(spark, pipeline.decontamination, rows, folder, docs_of) == want


def test_pii_keeps_rows(spark, docs_of, folder):
    rows = [*HARD, *SAME_ID, (None, "mail a.b@c.example.com"), (None, "mail x.y@c.example.com"), (None, None)]
    got = stay(spark, pipeline.pii, rows, folder, docs_of)
    assert sum(got.values()) == len(rows)
    assert not any("a.b@" in text_of(t) or "x.y@" in text_of(t) for _, t in got)
    assert Counter(r for r in got.elements() if "mail" not in text_of(r[1])) == \
        Counter(r for r in rows if "mail" not in text_of(r[1]))


def test_packing_takes_every_row(spark, docs_of, folder):
    rows = [*HARD, *SAME_ID]
    got = pipeline.best_fit_packing(spark, docs_of(rows, extra=True), folder).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in rows)
    assert pipeline.best_fit_packing(spark, docs_of([]), folder).count() == 0


@driver_tables
def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pipeline.run(spark, SF)
    ids = [r.doc_id for r in got.select("doc_id").distinct().collect()]
    assert 0 < len(ids) <= docs.count() and got.filter("length > 1024").count() == 0
    step = docs
    for name, stage in pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns, name
