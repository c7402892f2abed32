"""Helpers shared by the operators: intermediate tables, batches of texts, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from paytally.functions.ordered import scratch


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a compressed table in the shared checkpoint folder and read it back.

    Lineage ends at the table, so a lost executor costs no more than its unfinished tasks. The table
    goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "llm")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), so that no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def map_texts(docs: DataFrame, schema: str, per_batch: Callable[[list, list[bytes]], dict],
              finish: Callable[[], dict] | None = None, size: int | None = None) -> DataFrame:
    """Apply ``per_batch(ids, texts)`` to batches of (doc_id, text) rows; texts come as UTF-8 bytes.

    ``schema`` lists the output columns; "doc_id" alone takes the type of the input. Each result is
    a dict of equally long columns. ``finish`` may give rows at the end of a task. ``size``: see ``sliced``.
    """
    id_type = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = []
    for part in schema.split(";"):
        name, _, kind = part.strip().partition(" ")
        fields.append(StructField(name, id_type if name == "doc_id" else _type(kind)))
    out = StructType(fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, size=size):
            rows = per_batch(part.column(0).to_pylist(),
                             part.column(1).cast(pa.binary()).to_pylist())
            if rows:
                yield _batch(rows, arrow)
        if finish is not None and (rows := finish()):
            yield _batch(rows, arrow)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1_000, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds the Python objects alive at once.

    With ``size`` a batch has at most as many bytes, or one row.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _halved(batch.slice(at, rows), size)


def _halved(part: pa.RecordBatch, size: int | None) -> Iterator[pa.RecordBatch]:
    if size is None or part.num_rows < 2 or part.nbytes <= size:
        yield part
    else:
        half = part.num_rows // 2
        yield from _halved(part.slice(0, half), size)
        yield from _halved(part.slice(half), size)


def _type(kind: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(kind)


def _batch(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (a, b): one row (node, root) per node with an edge.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Minima per node are combined
    map-side and joined back, so a hub's neighbours need not meet in one task; every round is
    written to the shared folder, until one changes nothing. ``root`` is the smallest node of the
    component.
    """
    edges = stored(edges.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = stored(small.filter("a != b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct())
