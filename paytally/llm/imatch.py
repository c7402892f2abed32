"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms within a band of inverse document frequency, counted over all documents: terms
in at least ``low`` and at most ``high`` of them. A document's distinct lexicon terms are sorted, and each of
``len(RATES) * per_rate`` random subsets of the lexicon hashes those of the terms that it holds. Subsets keep
terms at several rates, so that short and long documents both have subsets with a few of their terms.
Likeness is the share of equal hashes among the subsets that hold a term of either document, at the rate
whose subsets are the most telling for the pair (see ``likeness``).

Document frequencies are counted in one pass and summed by term. Of T distinct terms a document on average
at most T / ``low`` reach the band, so the lexicon does not grow with the number of documents; it is broadcast.

Defined results: null counts as an empty text; equal texts have equal fingerprints and likeness 1; two texts
without lexicon terms are alike (1) only if both have none; documents follow one another by (doc_id, text),
null ids first, and ids may be of any type that sorts; the only document of a table is
its own next document; texts may be of any length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paytally.llm.common import map_texts, narrow, stored

#: Shares of the lexicon that a subset keeps.
RATES = [2.0**-k for k in range(1, 9)]


def terms(text: bytes) -> set[bytes]:
    return set(text.lower().split())


def counted(docs: DataFrame, chunk: int = 200_000) -> DataFrame:
    """(kind, term, n): documents with each term (kind 2), all documents (0) and bytes of text (1).

    A task hands its counts on whenever it holds ``chunk`` terms.
    """
    local: Counter = Counter()
    state = {"docs": 0, "bytes": 0}

    def out() -> dict:
        made = {"kind": [2] * len(local), "term": list(local.keys()), "n": list(local.values())}
        local.clear()
        return made

    def batch(ids: list, texts: list[bytes]) -> dict:
        for text in texts:
            local.update(terms(text))
        state["docs"] += len(texts)
        state["bytes"] += sum(map(len, texts))
        return out() if len(local) >= chunk else {}

    def rest() -> dict:
        made = out()
        made = {"kind": [*made["kind"], 0, 1], "term": [*made["term"], None, None],
                "n": [*made["n"], state["docs"], state["bytes"]]}
        state["docs"] = state["bytes"] = 0
        return made

    return map_texts(docs, "kind int; term binary; n long", batch, rest).groupBy("kind", "term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, low: float = 0.002, high: float = 0.2, chunk: int = 200_000) -> list[bytes]:
    """Sorted terms whose document frequency lies in the band; ``docs`` has doc_id and text."""
    return _band(stored(counted(docs, chunk)), low, high)[0]


def _band(counts: DataFrame, low: float, high: float) -> tuple[list[bytes], int, int]:
    """The lexicon, and the number and bytes of all texts."""
    sizes = {r.kind: r.n for r in counts.filter("kind < 2").collect()}  # two rows
    total = sizes.get(0, 0)
    # Of T distinct terms a document on average, at most T / low reach the band: no more with more documents.
    band = counts.filter((F.col("kind") == 2) & (F.col("n") >= low * total) & (F.col("n") <= high * total))
    return sorted(bytes(r[0]) for r in band.select("term").collect()), total, sizes.get(1, 0)


class Subsets:
    """Random lexicon subsets: for each term the subsets that keep it, as bits, and a hash."""

    def __init__(self, words: list[bytes], per_rate: int = 8):
        self.number = {w: i for i, w in enumerate(words)}
        n = len(RATES) * per_rate
        kept = np.zeros((len(words), n), dtype=bool)
        for k in range(n):
            draws = np.array([xxhash.xxh64_intdigest(w, 1 + k) for w in words], dtype=np.uint64)
            kept[:, k] = draws / 2.0**64 < RATES[k // per_rate]
        self.kept, self.n = kept, n

    def fingerprint(self, found: set[bytes]) -> np.ndarray:
        """One 32-bit hash per subset over its sorted distinct terms; 0 where it holds none."""
        get = self.number.get
        ids = np.array(sorted(i for i in map(get, found) if i is not None), dtype=np.uint32)
        out = np.zeros(self.n, dtype=np.uint32)
        rows = self.kept[ids]
        for k in np.flatnonzero(rows.any(axis=0)).tolist():
            out[k] = xxhash.xxh32_intdigest(ids[rows[:, k]].tobytes(), k) or 1
        return out


def likeness(a: np.ndarray, b: np.ndarray, per_rate: int = 8) -> float:
    """Share of equal hashes among subsets with terms, pooled over the sparsest rates that together have at
    least ``per_rate`` such subsets: there a subset holds few terms, so one change spoils few hashes."""
    used, same = (a != 0) | (b != 0), (a == b) & (a != 0)
    if not used.any():
        return 1.0
    n = hits = 0
    for r in range(len(a) // per_rate - 1, -1, -1):
        part = slice(r * per_rate, (r + 1) * per_rate)
        n, hits = n + int(used[part].sum()), hits + int(same[part].sum())
        if n >= per_rate:
            break
    return hits / n


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of the following document."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _place() -> Column:
    """Where a document belongs: null ids first, then the id, then the beginning of the text."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"),
                    F.substring("text", 1, 64).alias("begin"))


def bounds(rows: DataFrame, buckets: int, total: int, sample: int = 50_000) -> DataFrame:
    """Places that cut the documents into about equal buckets, in one row: an array ``cuts``.

    They come from distinct places drawn by hash, about ``sample`` of the ``total`` rows, in the ids'
    own order, so ids may be of any type, and equal ids are told apart by their texts. Only the balance
    of the buckets depends on the sample.
    """
    places = rows.select(_place().alias("p"))
    drawn = places.filter(F.pmod(F.xxhash64("p"), F.lit(max(1, total // sample))) == 0).distinct()
    listed = drawn.agg(F.sort_array(F.collect_list("p")).alias("all"))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(buckets - 1, 1))),
                     lambda i: F.element_at("all", F.greatest((i * F.size("all") / buckets).cast("int"), F.lit(1))))
    none = F.slice("all", 1, 0)
    return listed.select(F.when((F.size("all") == 0) | (F.lit(buckets) == 1), none)
                         .otherwise(F.array_distinct(at)).alias("cuts"))


def _in_order(docs: DataFrame, buckets: int, total: int) -> DataFrame:
    """Rows in buckets of consecutive places, each bucket followed by the first row of the next (``_tail``)."""
    cuts = stored(bounds(docs, buckets, total))
    where = F.size(F.filter("cuts", lambda b: b <= F.col("_place")))
    rows = docs.withColumn("_place", _place()).crossJoin(F.broadcast(cuts)).select(  # one row
        where.alias("_bucket"), "doc_id", "text")
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")
    heads = stored(rows.groupBy("_bucket").agg(F.min(first).alias("h")))  # one row per bucket
    order = Window.orderBy("_bucket")  # over the buckets
    heads = heads.select(F.lag("_bucket").over(order).alias("before"), "_bucket", "h.doc_id", "h.text")
    top = heads.agg(F.max("_bucket").alias("m"))
    tails = heads.crossJoin(F.broadcast(top)).select(  # one row: the first document follows the last
        F.coalesce("before", "m").alias("_bucket"), "doc_id", "text", F.lit(True).alias("_tail"))
    return rows.withColumn("_tail", F.lit(False)).union(tails)


def fingerprint_documents(docs: DataFrame, low: float = 0.002, high: float = 0.2, id_col: str = "doc_id",
                          text_col: str = "text", buckets: int | None = None, bucket_bytes: int = 1 << 24) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the two likenesses.

    Documents are dealt into ``buckets`` runs of consecutive places, by default of ``bucket_bytes`` each.
    """
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col)
    words, total, size = _band(stored(counted(rows)), low, high)
    shared = spark.sparkContext.broadcast(words)
    parts = buckets or max(1, min(-(-size // bucket_bytes), 10_000))
    dealt = _in_order(rows, parts, total).repartitionByRange(parts, "_bucket").sortWithinPartitions(
        "_bucket", "_tail", F.col("doc_id").asc_nulls_first(), "text")
    out = StructType([docs.schema[id_col]]) if id_col == "doc_id" else StructType([rows.schema["doc_id"]])
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"),
                       ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        out = out.add(name, kind)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subsets, before = None, None
        for batch in batches:
            subsets = subsets or Subsets(shared.value)
            made: list[tuple] = []
            for bucket, doc, text, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = subsets.fingerprint(terms(text.encode()))
                if before is not None:
                    made.append(_row(*before, text, mark, subsets))
                before = None if tail else (doc, text, mark)
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)],
                    schema=schema)

    return dealt.select("_bucket", "doc_id", "text", "_tail").mapInArrow(run, out)


def _row(doc, text: str, mark: np.ndarray, following: str, next_mark: np.ndarray, subsets: Subsets) -> tuple:
    new = edited(text, following)
    new_mark = mark if new == text else subsets.fingerprint(terms(new.encode()))
    return (doc, len(text), hashlib.sha256(new.encode()).hexdigest(), mark.astype(">u4").tobytes().hex(),
            new_mark.astype(">u4").tobytes().hex(), likeness(mark, new_mark), likeness(mark, next_mark))
