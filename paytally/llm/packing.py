"""Best-fit packing of documents into training sequences, certified by lower bounds.

Documents become token ids plus an end id; only documents longer than a sequence are cut, into full
pieces with the short one first. Full pieces are sequences of their own. Short pieces are dealt by hash
into partitions of bounded size; each partition packs best-fit decreasing and compares its number of
sequences with lower bounds from dual feasible functions. A partition that meets its bound is done. One
with a gap keeps its full sequences and gives the pieces of the others to a common pool; the pool is dealt
anew (all gap partitions mixed) and packed again, until no round saves a sequence.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by one; ids
are carried as they are (null too); pieces of equal length go in the order of their partition; a text of
any length is tokenised whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paytally.llm.common import map_texts, narrow, stored


@lru_cache(maxsize=2)
def encoder(path: str):
    """Byte-level BPE from a ``tokenizers`` file.

    The ids of its vocabulary are its merge ranks, so tiktoken's faster merge loop gives the ids that
    ``tokenizers`` gives (tested). Strings of special tokens in a text are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    # Byte-level vocabularies write printable bytes as themselves and move the others to 256, 257, ...
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in token): i
             for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(ids: list, texts: list[bytes]) -> dict:
        enc = encoder(tokenizer)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(ids, texts, strict=True):
            tokens = np.append(enc.encode_to_numpy(text.decode(), disallowed_special=()), end_id).astype("<u4")
            n = len(tokens)
            first = (n - 1) % capacity + 1
            bounds = [0, *range(first, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                for name, value in zip(out, (doc, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())), strict=True):
                    out[name].append(value)
        return out

    return map_texts(docs, "doc_id; piece int; start long; length long; ids_crc32 long", cut)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that pieces with ``counts[length]`` need at least.

    Dual feasible functions f (any set that fits a sequence has sum f(x)/f(capacity) <= 1): the
    identity, the threshold functions that round pieces above capacity - e up and below e down, and the
    staircase functions floor((k+1) x / capacity) / k.
    """
    sizes = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    number = np.concatenate([[0], np.cumsum(counts)])
    volume = np.concatenate([[0], np.cumsum(sizes * counts)])
    for e in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[min(capacity - e + 1, len(counts))])
        middle = int(volume[min(capacity - e + 1, len(counts))] - volume[min(e, len(counts))])
        best = max(best, large + max(0, -(-middle // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        value = np.where(exact, sizes * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and the room left in each bin.

    Open bins are kept by room; a bit set of rooms in use finds the tightest fit in one step.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in order.tolist():
        size = int(lengths[i])
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                used &= ~(1 << room)
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        rooms[b] = room - size
        if rooms[b]:
            open_bins[rooms[b]].append(b)
            used |= 1 << rooms[b]
    return bins, offsets, np.array(rooms, dtype=np.int64)


def _pack_partition(schema: pa.Schema, capacity: int, round_no: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=None) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table.column("length").to_numpy()
        bins, offsets, rooms = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        certified = len(rooms) == bound
        first = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        table = table.append_column("sequence_id", pa.array(bins + first, pa.int64()))
        table = table.append_column("offset", pa.array(offsets, pa.int64()))
        table = table.append_column("final", pa.array(certified | (rooms[bins] == 0), pa.bool_()))
        table = table.append_column("gap", pa.array(np.full(len(bins), len(rooms) - bound), pa.int64()))
        yield from table.cast(schema).to_batches()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
         text_col: str = "text", rows_per_partition: int = 200_000, max_rounds: int = 6) -> DataFrame:
    """One row per piece with its sequence and its place there.

    A partition holds about ``rows_per_partition`` short pieces (a few numbers each). After
    ``max_rounds`` exchanges the last packing stands.
    """
    cut = stored(pieces(narrow(docs, id_col, text_col), tokenizer, capacity, end_id))
    full = F.col("length") == capacity
    done = cut.filter(full).withColumns({
        "sequence_id": (F.lit(1 << 62) + F.monotonically_increasing_id()).cast("long"),
        "offset": F.lit(0).cast("long"), "gap": F.lit(0).cast("long")})
    columns = done.columns
    pool, size, open_bins, held = cut.filter(~full), None, None, None
    for round_no in range(max_rounds + 1):
        size = pool.count() if size is None else size
        parts = max(1, -(-size // rows_per_partition))
        mixed = pool.repartition(parts, F.xxhash64(F.lit(round_no), "doc_id", "ids_crc32", "piece"))
        out = StructType([*pool.schema.fields]).add("sequence_id", "long").add("offset", "long") \
            .add("final", "boolean").add("gap", "long")
        packed = stored(mixed.mapInArrow(_pack_partition(to_arrow_schema(out), capacity, round_no), out))
        used, size, now_open = packed.agg(
            F.count_distinct("sequence_id"), F.count_if(~F.col("final")),
            F.count_distinct(F.when(~F.col("final"), F.col("sequence_id")))).first()
        if held is not None and used >= open_bins:
            break  # the exchange saved nothing: the earlier packing of the pool stands
        done = done.union(packed.filter("final").select(columns))
        held, open_bins = packed.filter("not final"), now_open
        pool = held.select(cut.columns)
        if not size:
            break
    done = done.union(held.select(columns))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
