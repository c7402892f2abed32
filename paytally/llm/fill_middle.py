"""Fill-in-the-middle transformation by repeated captures.

One ``fullmatch`` of ``(unit)*`` keeps every repetition of the group, so ``match.ends(1)`` gives the
number of units and, by index, the offsets of both cuts. ``unit`` is any pattern of the ``regex``
library: a code point, a word with its blanks, a line. A text of more than ``block`` characters is
matched block by block with the same pattern, each block starting at the last unit that the one
before may have cut short, so that a match never holds more than a block's captures; this needs a
unit whose match does not depend on text beyond its own end.

Cuts, form and order follow from the SHA-256 of ``1:`` and the id alone, so a lost task repeats its
rows exactly. There is no shuffle: one pass of Arrow batches, and rebuilding is a column expression.

Defined results: a null text is empty; an empty text, one that holds a sentinel, and one that the
unit does not tile (its n is null) are plain; a null id is hashed as no digits; rows that repeat are
transformed alike; texts may be of any length; an empty table gives no rows. Only the id and the text
column are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import map_texts, narrow

CODE_POINT = r"(?s:.)"

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

BLOCK = 1 << 18


@lru_cache
def _units(unit: str):
    import regex

    return regex.compile(f"({unit})*")


def unit_ends(text: str, unit: str = CODE_POINT, block: int = BLOCK) -> list[int] | array | None:
    """End offset of each unit, left to right; None if units do not tile the whole text."""
    pattern = _units(unit)
    if len(text) <= block:
        found = pattern.fullmatch(text)
        return None if found is None else found.ends(1)
    ends, at, size = array("q"), 0, block
    while True:
        stop = min(at + size, len(text))
        found = pattern.match(text, at, stop).ends(1)
        if stop == len(text):
            ends.extend(found)
            return ends if ends and ends[-1] == stop else None
        if len(found) < 2:  # a unit longer than the block, or no unit here
            size *= 2
            continue
        ends.extend(found[:-1])  # the end of the block may have cut the last one
        at, size = found[-2], block


def draws(doc_id) -> list[int]:
    """The first four 32-bit numbers of the row's hash."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def transform(doc_id, text: str, unit: str, plain_from: int, spm_below: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text, unit)
    if ends is None:
        return None, "plain", None, None, text
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id)
    if not n or h3 % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = ends[first - 1] if first else 0
    b = ends[second - 1] if second else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, plain_from: int = 90, spm_below: int = 20,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Of 100 documents ``100 - plain_from`` stay plain; of 100 others ``spm_below`` put the suffix first.
    """

    def per_batch(ids: list, texts: list[bytes]) -> dict:
        rows = [transform(i, t.decode("utf-8", "surrogateescape"), unit, plain_from, spm_below)
                for i, t in zip(ids, texts, strict=True)]
        n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
        return {"doc_id": ids, "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle,
                "output": [o.encode("utf-8", "surrogateescape") for o in output]}

    found = map_texts(narrow(docs, id_col, text_col),
                      "doc_id; n long; form string; prefix_chars long; middle_chars long; output binary", per_batch)
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that gave ``output``. The text holds no mark, so the three marks split it exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix = F.when(form == "spm", parts[2]).otherwise(parts[1])
    suffix = F.when(form == "spm", parts[1]).otherwise(parts[2])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def digest(found: DataFrame) -> DataFrame:
    """Digests of the transformed and of the rebuilt texts in place of the texts."""
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
