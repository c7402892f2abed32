"""Removal of repeated byte strings with a suffix array built by Lyndon grouping.

1. Every window of ``length`` bytes has an anchor: the place of the smallest hash among its ``gram``-byte
   strings (the rightmost of equals). Equal windows have the same anchor string at the same offset, so only
   windows of one anchor string need comparing. A run of windows with one anchor is a context (about
   ``2 * length - gram`` bytes).
2. Anchor strings that occur once are done. Equal contexts are counted with map-side combine; a context that
   occurs twice is covered throughout. Only groups with different contexts go on, one copy of each.
3. Those groups are hashed into blocks. A block's contexts, cut into 16-byte cells counted from the anchor, form
   one integer sequence; its suffix array is built by the linear grouping construction (``suffix_array``).
   Neighbours in the order that share ``length`` bytes show which windows occur elsewhere. A task takes whole
   groups of some ``COMPARED`` bytes at once, however many groups fall into a block.
4. Groups with more than ``crowd`` different contexts are not gathered: their windows are hashed one by one
   (128 bits with the anchor) and counted by Spark, which gives the same answer for them.

Defined results: null counts as empty; texts shorter than ``length`` are kept; a text that repeats is removed
throughout if it has ``length`` bytes; rows that repeat with their id are copies like any other; long texts are
read in slices that overlap; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from paytally.functions.skew import skewed_join
from paytally.llm.common import map_texts, narrow, sliced, stored

SLICE = 1 << 18  # bytes hashed at once, at some 100 bytes of working memory each; places must fit 24 bits
COMPARED = 1 << 18  # bytes of contexts compared at once, at some 150 bytes of working memory each; a group goes whole
PIECE = 1 << 20  # bytes of an Arrow batch turned into Python objects at once, which may take ten times as much
MADE = 5_000  # rows made before they go on
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers that end in a unique smallest value, without renaming or recursion.

    Suffixes start grouped by first symbol. Groups are taken from the greatest down. When a group comes up, its
    suffixes share a Lyndon prefix u, and for each the nearest earlier suffix of a smaller group (its previous
    smaller one) is found by following such pointers. A suffix that is pointed to k times has its own Lyndon
    prefix extended by u k times, so it leaves its group upwards, more repeats further up. Afterwards the groups
    are those of the longest Lyndon prefixes; one pass from the smallest suffix up then puts every suffix into the
    next free place of its group.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, end = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for i, s in enumerate(order):
        if i and text[s] != text[order[i - 1]]:
            end[start] = i
            start = i
        place[s], group[s] = i, start
    end[start] = n
    before = [-1] * n
    top = n
    while top > 1:
        low = group[order[top - 1]]
        times: dict[int, int] = {}
        for s in sorted(order[low:top]) if top - low > 1 else (order[low],):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, k in times.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):
            cut: dict[int, int] = {}
            for p in levels[k]:
                g = group[p]
                last = cut.get(g, end[g]) - 1
                other, here = order[last], place[p]
                order[here], order[last] = other, p
                place[other], place[p] = here, last
                cut[g] = last
            for g, at in cut.items():
                if at > g:
                    for i in range(at, end[g]):
                        group[order[i]] = at
                    end[at], end[g] = end[g], at
        top = low
    out, used, done = [0] * n, [0] * n, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[g + used[g]] = s
            used[g] += 1
            done[s] = 1
            s = before[s]
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        inverse = np.array([pow(_BASE, -1, 2**64)], dtype=np.uint64)
        base = np.array([_BASE], dtype=np.uint64)
        one = np.ones(1, dtype=np.uint64)
        _POWERS[0] = tuple(np.multiply.accumulate(np.concatenate([one, np.repeat(b, n - 1)])) for b in (base, inverse))
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of each string of ``gram`` bytes."""
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    h = (total[gram:] - total[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from running minima within blocks."""
    n = len(key)
    pad = -n % width
    blocks = np.concatenate([key, np.full(pad, np.iinfo(key.dtype).max, key.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def contexts(pieces: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with windows: its number and, per context, anchor hash, first and last window, anchor."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    if len(data) < length:
        return
    h = gram_hashes(data, gram)
    back = np.uint64((1 << 24) - 1)
    key = h >> np.uint64(24) << np.uint64(24) | back - np.arange(len(h), dtype=np.uint64)
    anchor = (back - (_window_min(key, length - gram + 1) & back)).astype(np.int64)
    begin = 0
    for i, piece in enumerate(pieces):
        if len(piece) >= length:
            own = anchor[begin:begin + len(piece) - length + 1]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            last = np.concatenate([first[1:], [len(own)]]) - 1
            yield i, h[own[first]].view(np.int64), first, last, own[first] - begin
        begin += len(piece)


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Groups of pieces with (text number, offset); pieces of one long text overlap by length - 1 bytes."""
    where, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(len(text) - length + 1, 0), SLICE):
            where.append((i, a))
            pieces.append(text[a:a + SLICE + length - 1])
            size += len(pieces[-1])
            if size >= SLICE:
                yield where, pieces
                where, pieces, size = [], [], 0
    if pieces:
        yield where, pieces


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _find_contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Per text: its contexts (equal ones within the text once, with their number) and what those cover."""

    def batch(ids: list, texts: list[bytes]) -> dict:
        found: list[dict] = [{} for _ in texts]
        own: list[list] = [[] for _ in texts]
        for where, pieces in _slices(texts, length):
            for j, g, first, last, anchor in contexts(pieces, length, gram):
                i, offset = where[j]
                piece, mine = pieces[j], found[i]
                for gg, a, b, c in zip(g.tolist(), first.tolist(), last.tolist(), anchor.tolist(), strict=True):
                    x = xxhash.xxh3_64_intdigest(piece[a:b + length], c - a)
                    seen = mine.get((gg, x))
                    if seen is None:
                        mine[gg, x] = [a + offset, b + offset, c + offset, 1]
                    else:
                        if seen[3] == 1:
                            own[i].append((seen[0], seen[1] + length))
                        seen[3] += 1
                        own[i].append((a + offset, b + offset + length))
        signed = np.array([x for m in found for _, x in m], dtype=np.uint64).view(np.int64).tolist()
        columns: dict[str, list] = {k: [] for k in ("g", "x", "first", "last", "anchor", "n")}
        at = 0
        for m in found:
            columns["g"].append([g for g, _ in m])
            columns["x"].append(signed[at:at + len(m)])
            at += len(m)
            for k, name in enumerate(("first", "last", "anchor", "n")):
                columns[name].append([v[k] for v in m.values()])
        spans = [[{"start": a, "end": b} for a, b in merged(o)] for o in own]
        return columns | {"doc_id": ids, "key": _text_keys(texts), "own": spans}

    return map_texts(rows, "doc_id; key long; own array<struct<start:long,end:long>>; g array<long>; x array<long>; "
                           "first array<long>; last array<long>; anchor array<long>; n array<long>", batch, size=PIECE)


def _text_keys(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)


CELL = 16


def repeated_windows(group: list[int], text: list[bytes], anchor: list[int], length: int) -> list[np.ndarray]:
    """For each context: which of its windows occur in another context of its group at the same anchor offset."""
    symbols, where, cells = [], [], []
    for i, (g, t, a) in enumerate(zip(group, text, anchor, strict=True)):
        begin = a % CELL
        count = -(-(len(t) - begin) // CELL)
        raw = np.frombuffer(t[begin:].ljust(count * CELL, b"\0"), np.dtype(">u8")).reshape(count, 2)
        cells.append(raw.astype(np.uint64))
        row = np.empty((count, 5), dtype=np.uint64)
        row[:, 0] = np.int64(g).astype(np.uint64)
        row[:, 1] = np.arange(count) - (a - begin) // CELL + (1 << 40)
        row[:, 2:4] = raw
        row[:, 4] = np.minimum(CELL, len(t) - begin - CELL * np.arange(count))
        where.append((len(symbols), begin, count))
        symbols.append(row)
    flat = np.concatenate(symbols)
    # Symbols are numbered by (group, cell number, bytes); every context ends in a separator of its own.
    order = np.lexsort(flat.T[::-1])
    fresh = np.any(flat[order][1:] != flat[order][:-1], axis=1)
    number = np.empty(len(flat), dtype=np.int64)
    number[order] = np.concatenate([[0], np.cumsum(fresh)]) + len(text) + 1
    sequence, at, starts = [], 0, []
    for i, (_, _, count) in enumerate(where):
        starts.append(len(sequence))
        sequence += number[at:at + count].tolist()
        sequence.append(len(text) - i)
        at += count
    sequence.append(0)
    sa = np.array(suffix_array(sequence))
    rank = np.empty(len(sa), dtype=np.int64)
    rank[sa] = np.arange(len(sa))
    common = _common_bytes(np.array(sequence), sa, starts, where, flat)
    table = [common]  # minima over 1, 2, 4, ... neighbours
    while 2 << len(table) <= 2 * len(common):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    # Each window start: the bytes up to the next cell border and the rank of the suffix that begins there.
    short, ranks, left = [], [], []
    for i, (t, (_, begin, _)) in enumerate(zip(text, where, strict=True)):
        p = np.arange(len(t) - length + 1)
        to_border = (begin - p) % CELL
        short.append(to_border)
        ranks.append(rank[starts[i] + (p + to_border - begin) // CELL])
        padded = np.frombuffer(t[:len(p) + CELL].ljust(len(p) + CELL, b"\0"), np.uint8)
        head = np.lib.stride_tricks.sliding_window_view(padded, CELL)[:len(p)].copy()
        head[np.arange(CELL)[None] >= to_border[:, None]] = 0
        left.append(head.view(">u8").astype(np.uint64))
    short, ranks, left = map(np.concatenate, (short, ranks, left))
    order = np.lexsort((ranks, left[:, 1], left[:, 0], short))
    a, b = order[:-1], order[1:]
    alike = (short[a] == short[b]) & (left[a] == left[b]).all(axis=1) & (ranks[a] < ranks[b])
    a, b = a[alike], b[alike]
    low, high = ranks[a] + 1, ranks[b] + 1
    level = np.floor(np.log2(high - low)).astype(np.int64)
    shared = np.empty(len(a), dtype=np.int64)
    for k in range(len(table)):
        on = level == k
        shared[on] = np.minimum(table[k][low[on]], table[k][high[on] - (1 << k)])
    long_enough = shared + short[a] >= length
    hit = np.zeros(len(ranks), dtype=bool)
    hit[a[long_enough]] = hit[b[long_enough]] = True
    out, at = [], 0
    for t in text:
        out.append(hit[at:at + len(t) - length + 1])
        at += len(t) - length + 1
    return out


def _common_bytes(sequence: np.ndarray, sa: np.ndarray, starts: list[int], where: list, flat: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order (0 for the first)."""
    cell_of = np.full(len(sequence), -1)
    at = 0
    for s, (_, _, count) in zip(starts, where, strict=True):
        cell_of[s:s + count] = np.arange(at, at + count)
        at += count
    x, y = sa[:-1].copy(), sa[1:].copy()
    total, live = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(live):
        same = sequence[x[live]] == sequence[y[live]]  # separators differ, so both end
        total[live[same]] += flat[cell_of[x[live[same]]], 4].astype(np.int64)
        x[live[same]] += 1
        y[live[same]] += 1
        stop = live[~same]
        p, q = cell_of[x[stop]], cell_of[y[stop]]
        both = (p >= 0) & (q >= 0)
        stop, p, q = stop[both], p[both], q[both]
        aligned = (flat[p, :2] == flat[q, :2]).all(axis=1)
        stop, p, q = stop[aligned], p[aligned], q[aligned]
        bytes_p = flat[p, 2:4].astype(">u8").view(np.uint8).reshape(-1, CELL)
        bytes_q = flat[q, 2:4].astype(">u8").view(np.uint8).reshape(-1, CELL)
        run = np.cumprod(bytes_p == bytes_q, axis=1).sum(axis=1)
        total[stop] += np.minimum(run, np.minimum(flat[p, 4], flat[q, 4]).astype(np.int64))
        live = live[same]
    return np.concatenate([[0], total])


def _runs(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 160, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = 1 << 20, crowd: int = 1_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed)."""
    rows = narrow(docs, id_col, text_col)
    found = stored(_find_contexts(rows, length, gram))
    each = found.select("doc_id", "key", F.explode(F.arrays_zip("g", "x", "first", "last", "anchor", "n")).alias("e")).select(
        "doc_id", "key", "e.*")
    often = each.groupBy("g").agg(F.sum("n").alias("_n")).filter("_n > 1").select("g")
    # A passage of many documents is one hot key; its contexts are dealt over many tasks.
    place = ["doc_id", "key", "first"]
    each = stored(skewed_join(each, often, ["g"], spread=place))
    equal = each.groupBy("g", "x").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "key", "first", "last", "anchor")).alias("one"))
    groups = equal.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    equal = stored(skewed_join(equal, groups, ["g"], spread=["x"]))

    twice = skewed_join(each, equal.filter("n > 1").select("g", "x"), ["g", "x"], spread=place).select(
        "doc_id", "key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    # Contexts to compare: all of a group in which one occurs once.
    ask = equal.filter("kinds > 1 and least = 1").select("one.*", "g", "x", "n", "kinds")
    wanted = ask.groupBy("doc_id", "key").agg(F.collect_list(F.struct("g", "x", "n", "kinds", "first", "last", "anchor")).alias("asks"))
    size = ask.filter(F.col("kinds") <= crowd).agg(F.sum(F.col("last") - F.col("first") + length)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    cut = stored(_fetch(rows, wanted, length, crowd))
    apart = cut.filter("window is null").withColumn("block", F.pmod(F.xxhash64("g"), F.lit(blocks)))
    by_array = _by_block(apart, blocks, length, min(block_bytes, COMPARED))
    crowded = cut.filter("window is not null")
    more = crowded.groupBy("g", "anchor", "window").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    by_count = crowded.filter("n = 1").join(more, ["g", "anchor", "window"]).select(
        "doc_id", "key", F.col("first").alias("start"), (F.col("first") + length).alias("end"))

    spans = twice.union(by_array).union(by_count).union(
        found.select("doc_id", "key", F.explode("own").alias("s")).select("doc_id", "key", "s.start", "s.end"))
    spans = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return _cut_out(rows, spans)


def _with_text(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Texts joined with what belongs to them by (doc_id, hash of the text)."""
    keyed = map_texts(rows, "doc_id; key long; text string", lambda ids, texts: {
        "doc_id": ids, "key": _text_keys(texts), "text": [t.decode() for t in texts]}, size=PIECE)
    other = other.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    on = keyed["doc_id"].eqNullSafe(other["_id"]) & (keyed["key"] == other["_key"])
    return keyed.join(other, on, how).drop("_id", "_key")


def _fetch(rows: DataFrame, wanted: DataFrame, length: int, crowd: int) -> DataFrame:
    """Bytes of the contexts to compare; windows one by one for crowded groups."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = _parse_datatype_string(
        f"struct<doc_id:{id_type},key:bigint,g:bigint,n:bigint,first:bigint,anchor:bigint,context:binary,window:binary>")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, size=PIECE):
            made: list[tuple] = []
            for doc, key, text, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for e in asks:
                    a, b, c = e["first"], e["last"], e["anchor"]
                    if e["kinds"] <= crowd:
                        made.append((doc, key, e["g"], e["n"], a, c - a, raw[a:b + length], None))
                    else:
                        made += [(doc, key, e["g"], e["n"], p, c - p, None, xxhash.xxh3_128_digest(raw[p:p + length]))
                                 for p in range(a, b + 1)]
                    if len(made) > MADE:
                        yield _to_batch(made, schema)
                        made = []
            if made:
                yield _to_batch(made, schema)

    return _with_text(rows, wanted, "inner").select("doc_id", "key", "text", "asks").mapInArrow(run, out)


def _to_batch(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def whole_groups(rows: Iterable[tuple], group: int, context: int, size: int) -> Iterator[list[tuple]]:
    """Rows that are sorted by their group, in lists of whole groups with at most ``size`` bytes, or one group."""
    held, total = [], 0
    for _, own in groupby(rows, itemgetter(group)):
        own = list(own)
        more = sum(len(r[context]) for r in own)
        if held and total + more > size:
            yield held
            held, total = [], 0
        held += own
        total += more
    if held:
        yield held


def _by_block(cut: DataFrame, blocks: int, length: int, size: int) -> DataFrame:
    id_type = cut.schema["doc_id"].dataType.simpleString()
    out = _parse_datatype_string(f"struct<doc_id:{id_type},key:bigint,start:bigint,end:bigint>")
    schema = to_arrow_schema(out)

    def compare(some: list[tuple]) -> list[tuple]:
        hits = repeated_windows([r[3] for r in some], [r[7] for r in some], [r[6] for r in some], length)
        return [(r[1], r[2], r[5] + s["start"], r[5] + s["end"] + length)
                for r, hit in zip(some, hits, strict=True) if r[4] == 1 for s in _runs(hit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in sliced(batches, size=PIECE)
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for some in whole_groups(rows, 3, 7, size):
            if made := compare(some):
                yield _to_batch(made, schema)

    parts = max(1, min(blocks, 100_000))
    return (cut.select("block", "doc_id", "key", "g", "n", "first", "anchor", "context")
            .repartition(parts, "block").sortWithinPartitions("block", "g").mapInArrow(run, out))


def _cut_out(rows: DataFrame, spans: DataFrame) -> DataFrame:
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = _parse_datatype_string(f"struct<doc_id:{id_type},n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,"
                                 "spans:array<struct<start:bigint,end:bigint>>>")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, size=PIECE):
            made: list[tuple] = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                cuts = merged([(s["start"], s["end"]) for s in spans or ()])
                edges = [0, *(x for c in cuts for x in c), len(raw)]
                kept = b"".join(raw[a:b] for a, b in list(pairwise(edges))[::2])
                made.append((doc, len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(),
                             [{"start": a, "end": b} for a, b in cuts]))
            if made:
                yield _to_batch(made, schema)

    return _with_text(rows, spans, "left").select("doc_id", "text", "spans").mapInArrow(run, out)
