"""Phrase collocations: every frequent phrase by mergeable summaries, then exact counts and scores.

**First pass.** Each task counts the hashes of all n-grams of its batches and deals the counts by hash
partition, one packed row per batch and partition. A task per hash partition merges them into a
Misra-Gries summary. There are enough partitions that a summary's capacity exceeds the partition's
mass divided by the threshold, so what a summary subtracts from any counter stays below the threshold
and every n-gram that reaches it survives. ``Summary`` holds to that for any data: where a subtraction
would reach the threshold (a hot n-gram can raise a partition's mass), the capacity grows instead.
Hash collisions only add survivors.

**Second pass.** The survivors set bits in a bitmap of at most 32 MB, whatever their number. Tasks
pass over the texts again, take the n-grams whose bit and whose parts' bits are set, and count them by
their words; Spark adds the counts up by phrase. False survivors fall to the threshold here, so the
counts, and all that follows, are exact.

Cuts look their parts up by a join that deals hot parts (a word that begins a third of all phrases)
over many tasks. Counts and products are decimals of 38 digits before the last division.

Defined results: a null text is empty; a null lang is ``und``; rows that repeat count each time; empty
tables and texts give no phrases; a text of any length is read in pieces that share their last words;
equal scores go by count and then by the phrase's bytes. Only the text and the lang column are read,
so extra columns cannot clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytally.functions.skew import skewed_join
from paytally.llm.common import sliced, stored

#: Fixed by the contract: A-Z in lower case, piece ends as one mark, blanks as a space.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
MARK = b"\xff"  # no byte of a UTF-8 text
TABLE = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS + b"\t",
                        bytes(range(97, 123)) + MARK * len(PIECE_ENDS) + b" ")

WORDS = 1 << 19  # words per batch, and at most as many new words per piece of a text
IDS = 21  # bits of a word's number within a task
KEY = 40  # bits of an n-gram's hash within a partition
FILTER = 28  # bits of a bitmap position at most: 32 MB


def words_of(text: bytes, size: int = 2 * WORDS) -> Iterator[list[bytes]]:
    """Words and piece marks of a text, in lists of at most about ``size / 2``."""
    text = text.translate(TABLE).replace(MARK, b" " + MARK + b" ")
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Batch:
    """Numbers words per lang within a task and hands over arrays of about ``WORDS`` word numbers.

    ``flush(ids, new, batch)`` gets the numbers (-1 between pieces and texts); only n-grams that end
    at position ``new`` or later are new, the ones before it are the words carried over.
    """

    def __init__(self, order: int, flush: Callable, words: int = WORDS):
        self.order, self.flush, self.limit = order, flush, words
        self.carry = np.empty(0, np.int64)
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.hashes = array("Q")
        self.held = array("q")

    def number(self, lang: str, word: bytes) -> int:
        import xxhash

        self.words.append(word)
        self.langs.append(lang)
        self.hashes.append(xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang)))
        return len(self.words) - 1

    def add(self, lang: str, text: bytes) -> Iterator:
        table = self.table(lang)
        for words in words_of(text):
            self.held.extend(map(table.__getitem__, words))
            if len(self.held) >= self.limit or len(self.words) > 1 << (IDS - 1):
                yield from self.out()
                table = self.table(lang)
        self.held.append(-1)

    def table(self, lang: str) -> dict[bytes, int]:
        if lang not in self.numbers:
            owner = self

            class Table(dict):
                def __missing__(self, word: bytes) -> int:
                    self[word] = found = owner.number(lang, word)
                    return found

            self.numbers[lang] = Table({MARK: -1})
        return self.numbers[lang]

    def out(self) -> Iterator:
        if not self.held:
            return
        ids = np.concatenate([self.carry, np.frombuffer(self.held, np.int64)])
        yield from self.flush(ids, len(self.carry), self)
        self.held = array("q")
        self.carry = ids[-(self.order - 1):] if self.order > 1 else ids[:0]
        if len(self.words) > 1 << (IDS - 1):  # begin again with the carried words
            kept = [(self.langs[i], self.words[i]) if i >= 0 else None for i in self.carry]
            self.reset()
            self.carry = np.array([-1 if k is None else self.table(k[0])[k[1]] for k in kept], np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(ids: np.ndarray, hashes: array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``order``: per end position the n-gram's hash, and whether n words end there."""
    if not len(hashes):
        return
    one = np.frombuffer(hashes, np.uint64)[ids]  # the value at a mark is not used
    valid = word = ids >= 0
    h = one
    for n in range(1, order + 1):
        if n > 1:
            before, ends = np.zeros_like(h), np.zeros_like(valid)
            before[1:], ends[1:] = h[:-1], valid[:-1]
            h, valid = _mixed(before * np.uint64(0x9E3779B97F4A7C15) ^ one) + np.uint64(n), ends & word
        yield h, valid


def _map(docs: DataFrame, schema: str, arrow: pa.Schema, order: int, flush: Callable) -> DataFrame:
    """Apply ``flush`` to the batches of (lang, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Batch(order, flush)
        for part in sliced(batches, 1_000):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(),
                                  strict=True):
                yield from held.add(lang, text)
        yield from held.out()

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(typed, schema)


# --- first pass --------------------------------------------------------------------------------


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys of 40 bits as low words and high bytes; counts as bytes, large ones behind them."""
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<u8")
    return (keys.astype("<u4").tobytes() + (keys >> np.uint64(32)).astype(np.uint8).tobytes(),
            small.tobytes() + large.tobytes())


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // 5
    low = np.frombuffer(keys, "<u4", n).astype(np.uint64)
    high = np.frombuffer(keys, np.uint8, n, 4 * n).astype(np.uint64)
    found = np.frombuffer(counts, np.uint8, n).astype(np.int64)
    found[found == 255] = np.frombuffer(counts, "<u8", offset=n)
    return low | high << np.uint64(32), found


class Summary:
    """Misra-Gries summary of counted keys that merges packed counts.

    ``off`` is what has been subtracted in all; a key counted c times has a counter of at least
    ``c - off``. ``off`` stays below ``threshold``: a merge that would need more doubles the capacity.
    """

    def __init__(self, capacity: int, threshold: int, pending: int = 1 << 20):
        self.capacity, self.threshold, self.limit = max(1, capacity), threshold, pending
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.off = self.mass = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((keys, counts))
        self.waiting += len(keys)
        self.mass += int(counts.sum())
        if self.waiting > max(self.limit, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if not self.pending:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self.pending]])
        counts = np.concatenate([self.counts, *[c for _, c in self.pending]])
        self.pending, self.waiting = [], 0
        order = np.argsort(keys, kind="stable")  # sorted runs: a merge
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
        self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        while len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[-self.capacity - 1])
            if self.off + cut >= self.threshold:
                self.capacity *= 2
                continue
            self.off += cut
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.off >= self.threshold]


def survivors(docs: DataFrame, order: int, threshold: int, bits: int, mass: int) -> DataFrame:
    """``v``: partition and key of every n-gram hash that may reach the threshold.

    ``bits`` says how many hash partitions there are (2**bits), ``mass`` bounds a partition's mean mass.
    """
    shift, mask = np.uint64(64 - KEY - bits), np.uint64((1 << KEY) - 1)

    def flush(ids: np.ndarray, new: int, batch: Batch) -> Iterator[tuple]:
        found = [h[new:][valid[new:]] for h, valid in gram_hashes(ids, batch.hashes, order)]
        if not found:
            return
        found = np.sort(np.concatenate(found) >> shift)
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.empty(0, int)
        if not len(starts):
            return
        counts = np.diff(np.append(starts, len(found)))
        keys = found[starts]
        parts = (keys >> np.uint64(KEY)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        for at in range(0, len(edges), 64):
            some = edges[at:at + 64]
            ends = np.append(edges[at + 1:at + 64], edges[at + 64] if at + 64 < len(edges) else len(parts))
            packed = [pack(keys[a:b] & mask, counts[a:b]) for a, b in zip(some, ends, strict=True)]
            yield parts[some], [k for k, _ in packed], [c for _, c in packed]

    arrow = pa.schema([("p", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    packed = _map(docs, "p long, keys binary, counts binary", arrow, order, flush)
    capacity = mass // threshold + 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}
        for batch in sliced(batches, 16):
            for row in batch.to_pylist():
                summary = held.setdefault(row["p"], Summary(capacity, threshold))
                summary.add(*unpack(row["keys"], row["counts"]))
        for p in list(held):
            v = held.pop(p).survivors() | np.uint64(p << KEY)
            for at in range(0, len(v), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[at:at + 100_000].astype(np.int64))], names=["v"])

    # Partitions by number, so that no task gets several of them by chance.
    return packed.repartitionById(1 << bits, F.col("p").cast("int")).mapInArrow(merge, "v long")


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """The bits named by the low ``bits`` bits of ``v``: 2**bits / 8 bytes, built by Spark in blocks of 4 kB."""
    at = F.col("v").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    blocks = (found.groupBy(F.shiftright(at, 15).alias("block"))
              .agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767).cast("long"))).alias("bits")))
    out = np.zeros((max(1, (1 << bits) >> 15), 4096), np.uint8)
    for row in blocks.toLocalIterator():  # at most 2**13 blocks
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


# --- second pass -------------------------------------------------------------------------------


def exact_counts(docs: DataFrame, order: int, threshold: int, bits: int, members: np.ndarray, width: int) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of k = 1 to ``order`` words with f >= threshold; k = 0 with an empty
    phrase counts a lang's words."""
    shift = np.uint64(64 - KEY - bits)
    held = docs.sparkSession.sparkContext.broadcast(members)  # at most 32 MB
    low = np.uint64((1 << width) - 1)

    def flush(ids: np.ndarray, new: int, batch: Batch) -> Iterator[tuple]:
        member = held.value
        fresh = np.arange(len(ids)) >= new
        owner = np.frombuffer(batch.hashes, np.uint64) if batch.hashes else np.empty(0, np.uint64)
        counts = np.bincount(ids[new:][ids[new:] >= 0], minlength=len(owner))
        totals: dict[str, int] = {}
        for i in np.flatnonzero(counts):
            totals[batch.langs[i]] = totals.get(batch.langs[i], 0) + int(counts[i])
        yield list(totals), [0] * len(totals), [""] * len(totals), list(totals.values())
        passed = number = None
        for n, (h, valid) in enumerate(gram_hashes(ids, batch.hashes, order), 1):
            at = (h >> shift) & low
            hit = valid & ((member[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1)
            if n > 1:  # both parts of n - 1 words have to be frequent, too
                hit[1:] &= passed[:-1] & passed[1:]
                hit[0] = False
            where = np.flatnonzero(hit)
            key = ids[where] if n == 1 else number[where - 1] << IDS | ids[where]
            _, first, code = np.unique(key, return_index=True, return_inverse=True)
            seen = np.bincount(code[fresh[where]], minlength=len(first))
            passed, number = hit, np.full(len(ids), -1)
            number[where] = code
            some = np.flatnonzero(seen)
            for a in range(0, len(some), 50_000):
                part = some[a:a + 50_000]
                ends = where[first[part]]
                names = [" ".encode().join([batch.words[i] for i in ids[e - n + 1:e + 1].tolist()]) for e in ends.tolist()]
                yield [batch.langs[i] for i in ids[ends]], [n] * len(part), names, seen[part]

    arrow = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64())])
    found = _map(docs, "lang string, k int, phrase binary, f long", arrow, order, flush)
    return (found.groupBy("lang", "k", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
            .filter((F.col("k") == 0) | (F.col("f") >= threshold)))


def frequent(docs: DataFrame, order: int = 4, threshold: int = 30, lang_col: str = "lang", text_col: str = "text",
             partition_mass: int = 1 << 24) -> DataFrame:
    """Exact counts of all phrases of up to ``order`` words that occur ``threshold`` times in a lang (see
    ``exact_counts``). ``partition_mass`` bounds the n-gram occurrences of a hash partition on average."""
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    mass = order * size // 2  # a word takes two bytes at least
    bits = min(20, max(0, -(-mass // partition_mass) - 1).bit_length())
    found = stored(survivors(docs, order, threshold, bits, max(partition_mass, mass >> bits)))
    width = min(FILTER, max(15, found.count().bit_length() + 6), KEY)
    return stored(exact_counts(docs, order, threshold, bits, bitmap(found, width), width))


# --- scores ------------------------------------------------------------------------------------


def _words(words: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def score(counts: DataFrame, order: int = 4, top: int = 2_000, cover: int = 80, scale: int = 2_000_000) -> DataFrame:
    """Best ``top`` phrases of each lang by the score of their weakest cut, from ``frequent``'s counts.

    A phrase goes if a longer one that contains it has ``cover`` hundredths of its count or more.
    """
    words = F.split("phrase", " ")
    phrases = counts.filter("k >= 2").withColumn("w", words)
    parts = counts.filter(f"k between 1 and {order - 1}").select("lang", F.col("phrase").alias("part"), "f")

    cuts = F.filter(F.flatten(F.array(*[F.array(
        F.struct(F.lit(c).alias("cut"), F.lit(0).alias("side"), _words(F.col("w"), 1, c).alias("part"),
                 (F.col("k") > c).alias("ok")),
        F.struct(F.lit(c).alias("cut"), F.lit(1).alias("side"),
                 F.when(F.col("k") > c, F.array_join(F.slice("w", F.lit(c + 1), F.greatest(F.col("k") - c, F.lit(0))), " "))
                 .alias("part"), (F.col("k") > c).alias("ok"))) for c in range(1, order)])), lambda x: x["ok"])
    asked = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select(
        "lang", "phrase", "a", "c.cut", "c.side", "c.part")
    found = skewed_join(asked, parts, ["lang", "part"], spread=["phrase", "cut", "side"])
    sides = [F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias(f"{'lr'[s]}{c}")
             for c in range(1, order) for s in (0, 1)]
    wide = found.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *sides)

    def cut(c: int) -> Column:
        total = _exact(F.col(f"l{c}")) + _exact(F.col(f"r{c}"))
        value = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(19,0)) div "
                       f"(cast(l{c} as decimal(19,0)) + cast(r{c} as decimal(19,0)))")
        return F.when(total.isNotNull(), F.struct(value.cast("long").alias("score"), F.lit(c).alias("cut"),
                                                  F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))

    scored = wide.select("lang", "phrase", "a", F.array_min(F.array(*[cut(c) for c in range(1, order)])).alias("b"))
    inner = F.explode(F.filter(F.flatten(F.array(*[F.array(*[
        F.when(F.col("k") > n, F.when(F.col("k") >= s + n - 1, _words(F.col("w"), s, n))) for s in range(1, order - n + 2)])
        for n in range(2, order)])), lambda x: x.isNotNull())) if order > 2 else None
    if inner is not None:
        covers = phrases.select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("m"))
        held = scored.join(covers, ["lang", "phrase"], "left")
        scored = held.filter(F.col("m").isNull() | (_exact(F.col("m")) * 100 < _exact(F.col("a")) * cover))
    # The best of each of 16 parts of a lang first, so that one task ranks 16 * top phrases at most.
    order_by = [F.desc("b.score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(16))
    best = scored.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order_by))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order_by)).cast("long"))
    best = best.filter(F.col("rank") <= top)
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "b.l", "b.r", "n", "b.score")


def mine(docs: DataFrame, threshold: int = 30, order: int = 4, top: int = 2_000, cover: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best collocations."""
    return score(frequent(docs, order, threshold), order, top, cover)
