"""SimHash near-duplicates with pivot distance tables.

Each text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are the nodes; a table
holds their Hamming distances to ``PIVOTS`` reference fingerprints. Two fingerprints within ``max_bits``
agree on at least 3 of ``max_bits + 3`` bit blocks, so candidates share a block key. By the triangle
inequality a candidate pair whose pivot distances differ by more than ``max_bits`` in any coordinate is
discarded; survivors are verified by their exact distance.

A block key shared by more than ``bucket`` distinct fingerprints (a dense group of near copies) would give
quadratically many pairs. Its members are linked through their one-bit neighbours instead: two fingerprints
differ by at most 2 bits exactly if they share a fingerprint at distance 1 or less of both, and at most 65
fingerprints meet at one such point. This loses no link and emits 65 rows per member.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other;
rows with equal ids are kept; a null id does not count as the smallest; texts may be of any length; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytally.llm.common import components, map_texts, narrow, stored

PIVOTS = 12


def fingerprint(text: bytes, shingle: int = 3, chunk: int = 1 << 15) -> int:
    """SimHash of the lower-cased (A-Z) words' shingles, repeats included, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(grams), chunk):
        part = [xxhash.xxh64_intdigest(g, 42) for g in grams[i:i + chunk]]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(len(part), 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit numbers."""

    def batch(ids: list, texts: list[bytes]) -> dict:
        known: dict[bytes, int] = {}
        out = []
        for text in texts:
            if text not in known:
                known[text] = fingerprint(text, shingle)
            out.append(known[text])
        return {"doc_id": ids, "fp": np.array(out, dtype=np.uint64).view(np.int64)}

    return map_texts(docs, "doc_id; fp long", batch)


def reference_fingerprints(n: int = PIVOTS) -> list[int]:
    """Pivots: hashes of 0, 1, 2, ... as signed numbers."""
    raw = [xxhash.xxh64_intdigest(f"pivot {i}".encode(), 42) for i in range(n)]
    return np.array(raw, dtype=np.uint64).view(np.int64).tolist()


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _block_keys(fp: Column, max_bits: int) -> Column:
    """Array of (combination, bits kept) for all choices of 3 out of max_bits + 3 blocks."""
    n = max_bits + 3
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    signed = [np.array([reduce(int.__or__, (masks[i] for i in c))], dtype=np.uint64).view(np.int64)[0]
              for c in combinations(range(n), 3)]
    return F.array(*[F.struct(F.lit(i).alias("c"), fp.bitwiseAND(F.lit(int(m))).alias("k"))
                     for i, m in enumerate(signed)])


def links(nodes: DataFrame, max_bits: int = 2, bucket: int = 32) -> DataFrame:
    """Edges (a, b) whose components equal those of all pairs within ``max_bits`` bits.

    ``nodes`` holds distinct fingerprints in the column fp.
    """
    if max_bits != 2:
        raise ValueError("dense groups are linked through one-bit neighbours: max_bits must be 2")
    table = nodes.select("fp", *[_distance(F.col("fp"), F.lit(p)).cast("byte").alias(f"d{i}")
                                 for i, p in enumerate(reference_fingerprints())])
    pivots = [f"d{i}" for i in range(PIVOTS)]
    keyed = table.select("fp", *pivots, F.explode(_block_keys(F.col("fp"), max_bits)).alias("e")).select(
        "fp", *pivots, "e.c", "e.k")
    sizes = keyed.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = stored(keyed.join(sizes, ["c", "k"]))

    sparse = keyed.filter(F.col("n") <= bucket).drop("n")
    other = sparse.select("c", "k", F.col("fp").alias("fp2"), *[F.col(d).alias(f"{d}_2") for d in pivots])
    near = reduce(Column.__and__, [
        F.abs(F.col(d).cast("int") - F.col(f"{d}_2").cast("int")) <= max_bits for d in pivots])
    pairs = sparse.join(other, ["c", "k"]).filter(F.col("fp") < F.col("fp2")).filter(near).filter(
        _distance(F.col("fp"), F.col("fp2")) <= max_bits).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))

    dense = keyed.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    around = dense.select("fp", F.explode(flips).alias("v"))
    star = around.select("fp", F.min("fp").over(Window.partitionBy("v")).alias("m")).filter("fp != m")
    return pairs.union(star.select("fp", "m"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest id reachable)."""
    prints = stored(fingerprints(narrow(docs, id_col, text_col), shingle))
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(links(by_print.select("fp"), max_bits))
    nodes = by_print.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = stored(nodes.join(lowest, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
