"""From documents to packed training sequences: quality, near duplicates, benchmark text, PII, packing.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``.

Stages decide on rows by what they hold, never by the id alone: decisions are joined by the SHA-256 of
the text (with the id where labels or the choice of a copy depend on it), so rows without an id, of
one id, or equal to each other are judged one by one. Null texts count as empty and stay null; empty
texts are near duplicates of one another, so one of them stays; an empty table gives an empty table;
columns of any other name are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytally.functions.ordered import scratch
from paytally.llm import catalog, decontaminate, packing, quality_rules, simhash_pivots, surrogates

KEY = "__text_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the SHA-256 of the text (null: empty)."""
    return docs.withColumn(KEY, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))


def _same(found: DataFrame, docs: DataFrame, id_too: bool) -> Column:
    same = docs[KEY] == found["_key"]
    return same & docs["doc_id"].eqNullSafe(found["_id"]) if id_too else same


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of label 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = quality_rules.score_texts(docs, labels).filter("predicted = 1").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = _keyed(docs)
    return rows.join(good, _same(good, rows, True), "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of equal or near texts one row: that of the smallest id, then of the smallest key."""
    rows = _keyed(docs)
    found = simhash_pivots.near_duplicates(rows, shingle=3, max_bits=2, id_col=KEY).select(
        F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")).distinct()
    kinds = rows.select("doc_id", KEY).distinct()
    placed = kinds.join(found, _same(found, kinds, False))
    known = F.when(F.col("doc_id").isNull(), 1).otherwise(0)  # a null id stays only if no other row can
    heads = placed.groupBy("_group").agg(F.min(F.struct(known, "doc_id", KEY)).alias("h")).select(
        F.col("h.doc_id").alias("_id"), F.col(f"h.{KEY}").alias("_key"))
    kept = rows.join(heads, _same(heads, rows, True), "left_semi")
    return kept.dropDuplicates(["doc_id", KEY]).select(*docs.columns)  # equal rows are copies, too


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    rows = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated_words(rows, benchmark, window=10, id_col=KEY)
    clean = found.filter("n_hit = 0").select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(clean, _same(clean, rows, False), "left_semi").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for detected entities; n_chars follows the text."""
    out = surrogates.replace_pii(docs, catalog.surrogate_key(spark))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return packing.pack(docs, catalog.tokenizer_path(), capacity=1024, end_id=2)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("PII", pii), ("best-fit packing", best_fit_packing)]

#: Forest, lasso, hashing and byte-pair encoding have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
