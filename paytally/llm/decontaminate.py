"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ``window`` consecutive words (a shorter item is one window). Word
shingles (pairs) are ordered by how rare they are in the corpus, counted over all documents. A document
can contain a window only if it contains every shingle of it, so the prefix that must be joined is the
single rarest shingle of each window. Each place where that shingle occurs fixes one possible start of
the window; length and position bounds drop starts that cross the ends of the document, and the rest
are compared word by word.

The benchmark is the query set: it is taken in blocks of at most ``block_bytes`` of text, each block is
broadcast and held against all documents. Documents are never shuffled for a single block.

Defined results: null and empty texts have no words and no hits; items without words match nothing;
a repeated item counts once; rows with equal ids are judged one by one; texts may be of any length; an
empty table gives no rows and an empty benchmark no hits; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import map_texts, narrow

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """The distinct windows of a block of items as arrays of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                size = min(window, len(ids))
                for i in range(len(ids) - size + 1):
                    owners.setdefault(tuple(ids[i:i + size]), set()).add(item)
        self.windows = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.base = len(self.vocabulary) + 1

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row (-1: not in the benchmark), and where each text begins."""
        get, parts, starts = self.vocabulary.get, [], [0]
        for text in texts:
            found = words_of(text)
            parts.append(np.fromiter((get(w, -1) for w in found), np.int64, len(found)))
            starts.append(starts[-1] + len(found))
        return (np.concatenate(parts) if parts else np.empty(0, np.int64)), np.array(starts)

    def shingles(self, ids: np.ndarray) -> np.ndarray:
        """Number of the word pair at each place; -1 where a word is unknown."""
        pair = ids[:-1] * self.base + ids[1:]
        pair[(ids[:-1] < 0) | (ids[1:] < 0)] = -1
        return pair

    def all_shingles(self) -> np.ndarray:
        out = {w[i] * self.base + w[i + 1] for w in self.windows for i in range(len(w) - 1)}
        return np.array(sorted(out), dtype=np.int64)

    def index(self, counts: dict[int, int]) -> None:
        """Choose the rarest shingle of each window; ties go to the smaller number, then the earlier place."""
        entries = []
        for number, w in enumerate(self.windows):
            if len(w) == 1:
                entries.append((w[0], 1, 0, number))
                continue
            pairs = [w[i] * self.base + w[i + 1] for i in range(len(w) - 1)]
            at = min(range(len(pairs)), key=lambda i: (counts.get(pairs[i], 0), pairs[i], i))
            entries.append((pairs[at], 2, at, number))
        self.tables = {}
        for kind in (1, 2):
            rows = sorted((key, at, number) for key, k, at, number in entries if k == kind)
            self.tables[kind] = tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.flat = np.array([x for w in self.windows for x in w], dtype=np.int64)
        self.flat_at = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def occurrences(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every verified occurrence."""
        places, found = [], []
        for kind in (1, 2):
            keys, offsets, numbers = self.tables[kind]
            codes = ids if kind == 1 else self.shingles(ids)
            if not len(keys) or not len(codes):
                continue
            low = np.searchsorted(keys, codes, "left")
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == codes)
            low = low[hit]
            many = np.searchsorted(keys, codes[hit], "right") - low
            at = np.repeat(hit, many)
            row = np.repeat(low, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            begin, window = at - offsets[row], numbers[row]
            text = np.searchsorted(starts, at, "right") - 1
            inside = (begin >= starts[text]) & (begin + self.lengths[window] <= starts[text + 1])
            begin, window = begin[inside], window[inside]
            same = np.ones(len(begin), dtype=bool)
            for i in range(int(self.lengths.max(initial=0))):
                live = np.flatnonzero(same & (self.lengths[window] > i))
                same[live] = ids[begin[live] + i] == self.flat[self.flat_at[window[live]] + i]
            places.append(begin[same])
            found.append(window[same])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(found)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"),
                             F.col(f"`{text_col}`").cast("string").alias("text")).filter(
        "item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // block_bytes)
    if n <= 1:
        return [items]
    n *= 2  # hashed blocks are uneven
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _shingle_counts(docs: DataFrame, block: Windows) -> dict[int, int]:
    """Corpus counts of the block's shingles: at most one row per shingle and task is shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((block, block.all_shingles()))
    totals: Counter = Counter()

    def count(ids: list, texts: list[bytes]) -> dict:
        windows, wanted = shared.value
        pairs = windows.shingles(windows.number(texts)[0])
        at = np.minimum(np.searchsorted(wanted, pairs), max(len(wanted) - 1, 0))
        if len(wanted) and len(pairs):
            keys, n = np.unique(at[wanted[at] == pairs], return_counts=True)
            totals.update(dict(zip(wanted[keys].tolist(), n.tolist(), strict=True)))
        return {}

    def rest() -> dict:
        out = {"shingle": list(totals.keys()), "n": list(totals.values())}
        totals.clear()
        return out if out["n"] else {}

    rows = map_texts(docs, "shingle long; n long", count, rest).groupBy("shingle").agg(F.sum("n")).collect()
    return {r[0]: r[1] for r in rows}  # bounded by the shingles of one block


def _hits(docs: DataFrame, block: DataFrame, window: int) -> DataFrame:
    """Per document: its number of words, the runs of hit words and the items found, for one block."""
    spark = docs.sparkSession
    items = [(r.item, r.text.encode()) for r in block.collect()]  # at most block_bytes
    table = Windows(items, window)
    table.index(_shingle_counts(docs, table))
    shared = spark.sparkContext.broadcast(table)

    def match(ids: list, texts: list[bytes]) -> dict:
        t = shared.value
        numbers, starts = t.number(texts)
        begin, found = t.occurrences(numbers, starts)
        # +1 where an occurrence begins and -1 behind its end: hit words have a positive running sum.
        edge = np.zeros(len(numbers) + 1, dtype=np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + t.lengths[found], -1)
        hit = (np.cumsum(edge[:-1]) > 0).astype(np.int8)
        text = np.searchsorted(starts, begin, "right") - 1
        items: dict[int, set[str]] = {}
        for i, w in zip(text.tolist(), found.tolist(), strict=True):
            items.setdefault(i, set()).update(t.owners[w])
        n_words, spans = np.diff(starts), [[] for _ in ids]
        for i in items:
            mine = np.diff(np.concatenate([[0], hit[starts[i]:starts[i + 1]], [0]]))
            spans[i] = [{"start": a, "end": b} for a, b in zip(
                np.flatnonzero(mine == 1).tolist(), np.flatnonzero(mine == -1).tolist(), strict=True)]
        return {"doc_id": ids, "n_words": n_words, "spans": spans,
                "items": [sorted(items.get(i, ())) for i in range(len(ids))],
                "text_key": [hashlib.sha256(x).digest() if i in items else None for i, x in enumerate(texts)]}

    return map_texts(docs, "doc_id; n_words long; spans array<struct<start:long,end:long>>; "
                           "items array<string>; text_key binary", match)


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (array), hit_spans (word ranges)."""
    rows = narrow(docs, id_col, text_col)
    parts = [_hits(rows, block, window) for block in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", _covered("spans").alias("n_hit"), "items",
                               F.col("spans").alias("hit_spans"))
    # Several blocks: only documents with hits are gathered; equal rows have equal hits.
    found = parts[0].filter("size(items) > 0")
    for part in parts[1:]:
        found = found.union(part.filter("size(items) > 0"))
    found = found.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr("""aggregate(spans, array(cast(null as struct<start:bigint,end:bigint>)), (acc, x) ->
        if(element_at(acc, -1) is null, array(x),
           if(x.start <= element_at(acc, -1).end,
              concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start,
                     greatest(element_at(acc, -1).end, x.end) as end))), concat(acc, array(x)))))""")
    found = found.withColumn("spans", merged)
    # The text of a document without hits is not hashed above, so hash here for the join.
    left = map_texts(rows, "doc_id; n_words long; text_key binary", lambda ids, texts: {
        "doc_id": ids, "n_words": [len(words_of(x)) for x in texts],
        "text_key": [hashlib.sha256(x).digest() for x in texts]})
    f = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans", "items")
    joined = left.join(f, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    joined = joined.withColumns({
        "spans": F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")),
        "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))})
    return joined.select("doc_id", "n_words", _covered("spans").alias("n_hit"), "items",
                         F.col("spans").alias("hit_spans"))


def _covered(spans: str):
    return F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s.end - s.start)")


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
