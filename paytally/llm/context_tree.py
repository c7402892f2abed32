"""Language-model scoring by context-tree weighting over bytes.

Every byte is coded as eight binary decisions; a decision's node is its context (the last d bytes) with the
bits already known. Each node has counts of zeros and ones and a Krichevsky-Trofimov estimate, and all
depths 0..``depth`` are mixed by their weighted probabilities on the training text:
``P = 1/2 KT + 1/2 prod(P of the longer contexts)``. With the counts frozen the mixture along a path is fixed, so
each node stores one probability and scoring a byte is a table lookup. A path ends at the deepest node seen in
training. Code length per byte is ``-log2`` of these products. A text ends with byte 0xFF, which UTF-8 never
uses; contexts before its beginning are 0xFF too.

What is gathered: counts of (context, byte) and of words over all training texts, combined in each task and
then by Spark; both grow with the corpus and nothing is dropped. The tree stays distributed. Contexts that
share their last ``split`` bytes form a subtree, and a bucket of whole subtrees is mixed in one task. Only the
nodes above, at most 255 for each pair of bytes that text can hold, are mixed on the driver and broadcast. The
probabilities of the ``frequent_codes`` most common (context, byte) pairs and the counts of the ``frequent`` most
common words are broadcast as a cache; all others, pairs never seen in training included, are counted per
document and joined. The size of the caches does not change a result.

Defined results: null and empty texts are the end token alone; without training texts N, V and all counts are 0
and the tree answers 1/2 for each bit; equal ids are scored row by row; texts of any length are read in segments; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import map_texts, narrow, stored

END = 0xFF
SLICE = 2 << 20  # bytes handled at once
WORD, GRAM, DOCS = 0, 1, 2


def segments(texts: list[bytes], depth: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (text number, context + bytes): each piece begins with ``depth`` bytes of context."""
    numbers, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        whole = bytes([END]) * depth + text + bytes([END])
        for a in range(depth, len(whole), SLICE):
            numbers.append(i)
            pieces.append(whole[a - depth:a + SLICE])
            size += len(pieces[-1])
            if size >= SLICE:
                yield numbers, pieces
                numbers, pieces, size = [], [], 0
    if pieces:
        yield numbers, pieces


def codes(pieces: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | byte) for each byte behind the contexts, and where each piece's codes begin."""
    text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    code = text.copy()
    for k in range(1, depth + 1):
        code[k:] |= text[:-k] << np.uint64(8 * k)
    lengths = np.array([len(p) for p in pieces])
    keep = np.ones(len(text), dtype=bool)
    begin = np.cumsum(lengths) - lengths
    for k in range(depth):
        keep[begin + k] = False
    own = lengths - depth
    return code[keep], np.cumsum(own) - own


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def gather(docs: DataFrame, depth: int) -> DataFrame:
    """(kind, code, n): counts over ``docs``, one row per key."""
    words: Counter = Counter()
    grams = {"codes": [], "counts": [], "rows": 0}
    seen = {"docs": 0}

    def merge() -> None:
        key = np.concatenate(grams["codes"])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate(grams["counts"])[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        grams["codes"], grams["counts"] = [key[first]], [np.add.reduceat(n, first)]
        grams["rows"] = len(first)

    def drain() -> dict:
        if grams["codes"]:
            merge()
        code = [word_hash(list(words)), *[c.view(np.int64) for c in grams["codes"]], np.array([0])]
        n = [np.fromiter(words.values(), np.int64, len(words)), *grams["counts"], np.array([seen["docs"]])]
        kind = [np.full(len(c), k) for c, k in zip(code, [WORD, *[GRAM] * len(grams["codes"]), DOCS], strict=True)]
        words.clear()
        grams.update(codes=[], counts=[], rows=0)
        seen["docs"] = 0
        return {"kind": np.concatenate(kind), "code": np.concatenate(code), "n": np.concatenate(n)}

    def count(ids: list, texts: list[bytes]) -> dict:
        lowered = [t.lower() for t in texts]
        for text in lowered:
            words.update(text.split())
        seen["docs"] += len(texts)
        for _, pieces in segments(lowered, depth):
            key, n = np.unique(codes(pieces, depth)[0], return_counts=True)
            grams["codes"].append(key)
            grams["counts"].append(n)
            grams["rows"] += len(key)
            if grams["rows"] > 4_000_000:
                merge()
        return drain() if len(words) + grams["rows"] > 4_000_000 else {}

    rows = map_texts(docs, "kind int; code long; n long", count, drain)
    return stored(rows.groupBy("kind", "code").agg(F.sum("n").alias("n")))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: eight recurrence steps, then Stirling's series."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)


def nodes(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted node keys (context << 8 | 1 and known bits) with their zeros and ones, from sorted codes."""
    byte, context = code & np.uint64(255), code >> np.uint64(8) << np.uint64(8)
    keys, zeros, ones = [], [], []
    for j in range(8 if len(code) else 0):
        prefix = np.uint64(1 << j) | byte >> np.uint64(8 - j) if j else np.full_like(byte, 1)
        bit = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
        key = context | prefix
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keys.append(key[first])
        zeros.append(np.add.reduceat(np.where(bit, 0, n), first))
        ones.append(np.add.reduceat(np.where(bit, n, 0), first))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0), np.empty(0)
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate(zeros)[order].astype(float), np.concatenate(ones)[order].astype(float)


def parents(key: np.ndarray, level: int) -> np.ndarray:
    """Keys of the same bits one byte of context above ``level``."""
    mask = np.uint64((1 << 8 * (level - 1)) - 1)
    return ((key >> np.uint64(8)) & mask) << np.uint64(8) | (key & np.uint64(255))


class Tree:
    """Levels ``low``..``high`` of the context tree: per level the sorted node keys and P(bit = 1)."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, low: int, high: int,
                 below: np.ndarray | None = None):
        """From the nodes of level ``high``; ``below``: summed log probabilities of the contexts beneath each."""
        self.low, self.high = low, high
        self.keys, self.up, self.estimate, self.stay, self.one = {}, {}, {}, {}, {}
        for d in range(high, low - 1, -1):
            own = _kt(zeros, ones)
            mixed = own if below is None else np.log(0.5) + np.logaddexp(own, below)
            self.keys[d], self.estimate[d] = key, (ones + 0.5) / (zeros + ones + 1)
            self.stay[d] = np.ones(len(key)) if below is None else np.exp(np.log(0.5) + own - mixed)
            self.root = zeros, ones, mixed
            if d > low:
                key, self.up[d] = np.unique(parents(key, d), return_inverse=True)
                zeros, ones, below = (np.bincount(self.up[d], x, len(key)) for x in self.root)

    def mix(self, share: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixture going down: the weight left at the nodes of ``low`` and the probability gathered above them.

        Returns the same for what lies beneath the nodes of ``high``.
        """
        for d in range(self.low, self.high + 1):
            if d > self.low:
                share, total = share[self.up[d]], total[self.up[d]]
            self.one[d] = total + share * self.estimate[d]
            total = total + share * self.stay[d] * self.estimate[d]
            share = share * (1 - self.stay[d])
        return share, total


def walk(code: np.ndarray, keys: dict[int, np.ndarray], ones: dict[int, np.ndarray]) -> np.ndarray:
    """log10 probability of each code's byte in its context, by descending the tree bit by bit."""
    total, byte, context = np.zeros(len(code)), code & np.uint64(255), code >> np.uint64(8)
    for j in range(8):
        prefix = np.uint64(1 << j) | byte >> np.uint64(8 - j) if j else np.full_like(byte, 1)
        one, open_ = np.full(len(code), 0.5), np.ones(len(code), dtype=bool)
        for d in sorted(keys, reverse=True):
            rows = np.flatnonzero(open_)
            if not len(rows) or not len(keys[d]):
                continue
            key = (context[rows] & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | prefix[rows]
            at = np.minimum(np.searchsorted(keys[d], key), len(keys[d]) - 1)
            hit = keys[d][at] == key
            one[rows[hit]] = ones[d][at[hit]]
            open_[rows[hit]] = False
        bit = byte >> np.uint64(7 - j) & np.uint64(1)
        total += np.log10(np.clip(np.where(bit == 1, one, 1 - one), 1e-12, 1))
    return total


class Lookup:
    """Open-addressing table from codes to values."""

    NONE = np.iinfo(np.uint64).max

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(code), 1) * 2))))
        self.code = np.full(1 << self.bits, self.NONE, dtype=np.uint64)
        self.value = np.zeros(1 << self.bits)
        at, left = self._slot(code), np.arange(len(code))
        while len(left):
            put = left[self.code[at[left]] == self.NONE]
            self.code[at[put]] = code[put]  # of several for one slot the last stays
            won = self.code[at[left]] == code[left]
            self.value[at[left[won]]] = value[left[won]]
            left = left[~won]
            at[left] = at[left] + 1 & (1 << self.bits) - 1

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each code (0 if absent) and whether it is there."""
        at = self._slot(code)
        slot = self.code[at]
        found = slot == code
        out = np.where(found, self.value[at], 0.0)
        left = np.flatnonzero(~found & (slot != self.NONE))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            slot = self.code[at[left]]
            hit = slot == code[left]
            out[left[hit]], found[left[hit]] = self.value[at[left[hit]]], True
            left = left[~hit & (slot != self.NONE)]
        return out, found


class ContextTree:
    """The tree of all training counts; its subtrees live in Spark, its top in a broadcast."""

    def __init__(self, grams: DataFrame, depth: int, split: int = 3, codes_per_bucket: int = 100_000):
        """``grams``: one row (code, n) for each pair of context and byte."""
        self.grams, self.depth, self.split, self.per_bucket = grams.select("code", "n"), depth, min(split, depth), codes_per_bucket
        self.size = grams.count()
        low, high = self.split, self.depth

        def upward(rows: pa.Table) -> pa.Table:
            key, a, b, mixed = _subtrees(rows, low, high)[1]
            above, at = np.unique(parents(key, low), return_inverse=True)
            return pa.table({"key": above.view(np.int64), **{
                name: np.bincount(at, x, len(above)) for name, x in (("a", a), ("b", b), ("below", mixed))}})

        got = self._buckets(self.grams, self.size, upward, "key long, a double, b double, below double").groupBy("key").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toArrow()
        key, a, b, below = (c.to_numpy() for c in got.columns)
        order = np.argsort(key)
        top = Tree(key[order].astype(np.uint64), a[order], b[order], 0, low - 1, below[order])
        share, total = top.mix(np.ones(len(top.keys[0])), np.zeros(len(top.keys[0])))
        self.top = grams.sparkSession.sparkContext.broadcast((top.keys, top.one, share, total))
        self.values = stored(self._answers(self.grams, self.size, False))

    def _buckets(self, codes: DataFrame, size: int, work: Callable, schema: str) -> DataFrame:
        """Apply ``work`` to buckets of about ``codes_per_bucket`` rows that hold whole subtrees."""
        suffix = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * self.split) - 1))
        bucket = F.pmod(F.xxhash64(suffix), F.lit(max(1, -(-size // self.per_bucket))))
        return codes.select(bucket.alias("bucket"), "code", "n").groupBy("bucket").applyInArrow(work, schema)

    def _answers(self, codes: DataFrame, size: int, asked: bool) -> DataFrame:
        """(code, n, value): log10 probabilities of the training codes or, if ``asked``, of those with n = 0."""
        top, low, high = self.top, self.split, self.depth

        def downward(rows: pa.Table) -> pa.Table:
            tree, (key, *_) = _subtrees(rows, low, high)
            keys, ones, share, total = top.value
            at = np.searchsorted(keys[low - 1], parents(key, low))
            tree.mix(share[at], total[at])
            code, n = rows.column("code").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
            code, n = (code[n == 0], n[n == 0]) if asked else (code, n)
            value = walk(code, keys | tree.keys, ones | tree.one)
            return pa.table({"code": code.view(np.int64), "n": n, "value": value})

        return self._buckets(codes, size, downward, "code long, n long, value double")

    def common(self, most: int) -> Lookup:
        """At most ``most`` of the most frequent codes."""
        got = self.values.filter(F.col("n") >= _cutoff(self.values, most)).toArrow()
        return Lookup(got.column("code").to_numpy().astype(np.uint64), got.column("value").to_numpy())

    def values_with(self, held: DataFrame) -> DataFrame:
        """(code, value) of all training codes and of those in ``held`` that training never saw."""
        unseen = stored(held.select("code").distinct().join(self.values.select("code"), "code", "left_anti"))
        asked = self.grams.union(unseen.select("code", F.lit(0).cast("long")))
        answers = self._answers(asked, self.size + unseen.count(), True)
        return self.values.select("code", "value").union(answers.select("code", "value"))


def _subtrees(rows: pa.Table, low: int, high: int) -> tuple[Tree, tuple]:
    """The levels from ``low`` on of a bucket, and (key, zeros, ones, mixed) of its nodes at ``low``."""
    code, n = rows.column("code").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(code)
    order = order[n[order] > 0]
    tree = Tree(*nodes(code[order], n[order]), low, high)
    return tree, (tree.keys[low], *tree.root)


def _cutoff(counts: DataFrame, most: int) -> int:
    """Smallest count n such that at most ``most`` rows have n or more; looks at 1/8 powers of two."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("s")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).orderBy(F.desc("s")).collect()
    total, cutoff = 0, None
    for s in steps:  # at most a few hundred
        total += s.rows
        if total > most:
            return s.high + 1 if cutoff is None else cutoff
        cutoff = s.low
    return cutoff or 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, frequent: int = 200_000,
          frequent_codes: int = 500_000, split: int = 3, codes_per_bucket: int = 100_000) -> DataFrame:
    """One row per document: unigram base score, the tree's log10 probability of the lower-cased text and, from it,
    the code length in bits per byte (null for an empty text)."""
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col)
    counts = gather(rows.filter(~held_out(F.col("doc_id"))), depth)
    words = counts.filter(F.col("kind") == WORD)
    n_words, v_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = counts.filter(F.col("kind") == DOCS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = n_words + n_docs, v_words + (n_docs > 0)
    cutoff = _cutoff(words, frequent) if v_words else 1
    top = words.filter(F.col("n") >= cutoff).toArrow()
    top_hash, top_n = top.column("code").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(top_hash)
    tree = ContextTree(counts.filter(F.col("kind") == GRAM), depth, split, codes_per_bucket)
    shared = spark.sparkContext.broadcast((tree.common(frequent_codes), top_hash[order], top_n[order]))
    state = {"row": None}

    def batch(ids: list, texts: list[bytes]) -> dict:
        lookup, known, known_n = shared.value
        if state["row"] is None:
            state["row"] = TaskContext.get().partitionId() << 40
        first = state["row"]
        state["row"] += len(texts)
        lowered = [t.lower() for t in texts]
        model = np.zeros(len(texts))
        n_tokens, n_known, logs = [], [], []
        # Rare words and codes with their counts; a long text has several rows of them.
        numbers, rare, times, is_code = [], [], [], []
        for pieces_of, pieces in segments(lowered, depth):
            code, begin = codes(pieces, depth)
            value, hit = lookup.find(code)
            np.add.at(model, pieces_of, np.add.reduceat(value, begin))
            owner = np.repeat(pieces_of, np.diff(np.append(begin, len(code))))[~hit]
            code = code[~hit]
            order = np.lexsort((code, owner))
            owner, code = owner[order], code[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])[:len(code)])
            n, owner, code = np.diff(np.append(new, len(code))), owner[new], code[new].view(np.int64)
            at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[:len(owner)])
            numbers += owner[at].tolist()
            rare += np.split(code, at[1:]) if len(at) else []
            times += np.split(n, at[1:]) if len(at) else []
            is_code += [True] * len(at)
        for a in range(0, len(texts), 256):
            part = [t.split() for t in lowered[a:a + 256]]
            number: dict[bytes, int] = {}
            for w in part:
                for x in w:
                    number.setdefault(x, len(number))
            hashes = word_hash(list(number))
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            common = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
            log_n = np.where(common, np.log10((known_n[at] if len(known) else np.zeros(len(hashes))) + 1.0), 0.0)
            for i, w in enumerate(part, a):
                ids_ = np.fromiter((number[x] for x in w), np.int64, len(w))
                others, n = np.unique(ids_[~common[ids_]], return_counts=True)
                n_tokens.append(len(w) + 1)
                n_known.append(int(common[ids_].sum()) + (n_docs > 0))
                logs.append(float(log_n[ids_].sum()) + float(np.log10(n_docs + 1)))
                if len(others):
                    numbers.append(i)
                    rare.append(hashes[others])
                    times.append(n)
                    is_code.append(False)
        more, whole = [None] * len(numbers), len(texts)
        return {"doc_id": [*ids, *[ids[i] for i in numbers]], "row": [*range(first, first + whole), *[first + i for i in numbers]],
                "n_bytes": [*map(len, texts), *more], "n_tokens": [*n_tokens, *more], "n_known": [*n_known, *more], "logs": [*logs, *more],
                "model": [*model.tolist(), *more], "is_code": [None] * whole + is_code,
                "rare": [None] * whole + rare, "times": [None] * whole + times}

    scored = stored(map_texts(rows, "doc_id; row long; n_bytes long; n_tokens long; n_known long; logs double; model double; "
                                    "is_code boolean; rare array<long>; times array<long>", batch))
    rare = scored.select("row", "is_code", held_out(F.col("doc_id")).alias("held"),
                         F.explode(F.arrays_zip("rare", "times")).alias("e")).select(
        "row", "is_code", "held", F.col("e.rare").alias("code"), "e.times")
    others = words.filter(F.col("n") < cutoff).select("code", "n")
    in_words = rare.filter("not is_code").join(others, "code").select(  # a word without a match adds log10(0 + 1) = 0
        "row", (F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.col("times").alias("known"), F.lit(0.0).alias("bits"))
    in_codes = rare.filter("is_code").join(tree.values_with(rare.filter("is_code and held")), "code").select(
        "row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("known"), (F.col("times") * F.col("value")).alias("bits"))
    found = in_words.union(in_codes).groupBy("row").agg(
        F.sum("more").alias("more"), F.sum("known").alias("known"), F.sum("bits").alias("bits"))
    size = float(np.log10(total + distinct + 1))
    return scored.filter("n_tokens is not null").drop("rare", "times", "is_code").join(found, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"),
        (F.col("model") + F.coalesce("bits", F.lit(0.0))).alias("score"), "n_bytes").withColumn(
        "bits_per_byte", -F.col("score") * math.log2(10) / F.nullif("n_bytes", F.lit(0))).drop("n_bytes")
