r"""Chat formatting: a hidden Markov model recovers the roles of a raw transcript.

A transcript comes as numbered lines. Each line is observed through its speaker marker (a leading label such
as ``User:``, ``### Assistant`` or ``<|system|>``, known or unknown) and line features: how long it is, a
question mark, a list or code look. States pair a role with its place in the turn (first line
or later line). Transition and emission probabilities are add-one estimates from labelled lines, gathered with
Spark; the tables are of fixed size. Viterbi then finds the most likely roles, and turns are rendered
canonically.

Viterbi runs in blocks of ``block`` lines: a block is one max-plus matrix (states x states); the short chain
of its transcript's matrices fixes the states at block borders, and each block is then decoded by itself. A
transcript with a third of all lines is so spread over many tasks. Equal scores go to the lower state number,
within blocks and across them. Sorted Arrow streams carry many blocks at a time, and all blocks of a stream's
chunk advance together, so short transcripts cost no more per line than long ones.

Defined results: null and empty lines are blank lines of the current turn; a transcript of blank lines is one
empty turn; repeated (transcript, line) rows follow each other in text order; lines without a number come
first, as number -1; lines may be of any length; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from paytally.llm.common import sliced, stored

ROLES = ["system", "user", "assistant", "tool"]
STATES = [(r, first) for r in range(len(ROLES)) for first in (True, False)]
# Speaker labels by role.
LABELS = {
    "system": ["system", "instruction", "instructions", "context"],
    "user": ["user", "human", "customer", "question", "q", "prompter"],
    "assistant": ["assistant", "ai", "bot", "agent", "answer", "a", "model", "gpt"],
    "tool": ["tool", "function", "observation", "result"],
}
#: A label at the start of a line with its decoration; group 1 is the label, group 2 what closes it.
MARKER = r"^\s{0,8}(?:#{1,6}\s*|\*\*|<\|?|\[)?\s{0,4}(\p{L}[\p{L}]{0,14})\s{0,4}(\|?>|\]\s*:?|\*\*\s*:|:\s*\*\*|:|$)"


def observations(lines: DataFrame) -> DataFrame:
    """Add ``_symbol`` (what the model sees), ``_body`` (the line without a known speaker label) and ``_opening``
    (without any label, for a line that turns out to begin a turn)."""
    label = F.lower(F.regexp_extract("_text", MARKER, 1))
    closed = F.regexp_extract("_text", MARKER, 2) != ""
    headed = F.col("_text").rlike(r"^\s{0,8}#{1,6}\s*\p{L}+\s*$")
    marker = F.lit("none")
    for role in reversed(ROLES):
        marker = F.when(label.isin(LABELS[role]) & (closed | headed), F.lit(role)).otherwise(marker)
    marker = F.when((marker == "none") & closed & (label != ""), F.lit("other")).otherwise(marker)
    length = F.char_length("_text")
    size = F.when(F.trim("_text") == "", "blank").when(length < 40, "short").when(length < 200, "middle").otherwise("long")
    shape = F.when(F.rtrim("_text").endswith("?"), "asks").when(
        F.col("_text").rlike(r"^\s*(?:[-*•]|\d{1,3}[.)]|```|    |\t)"), "list").otherwise("plain")
    bare = F.regexp_replace("_text", MARKER + r"[ \t]?", "")
    known = marker.isin(*ROLES)
    body = F.when(known, bare).otherwise(F.col("_text"))
    return lines.withColumns({
        "_marker": marker, "_symbol": F.concat_ws("|", marker, size, shape), "_body": body,
        "_opening": F.when(marker == "none", F.col("_text")).otherwise(bare)})


SYMBOLS = [f"{m}|{s}|{k}" for m in [*ROLES, "other", "none"] for s in ("blank", "short", "middle", "long")
           for k in ("asks", "list", "plain")]


class Model:
    """Log probabilities: start (states), step (states x states), emit (states x symbols)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit


def fit(lines: DataFrame) -> Model:
    """``lines`` has _symbol, _role, _first, _role_before, _first_before (null at a transcript's start)."""
    counts = lines.groupBy("_role", "_first", "_role_before", "_first_before", "_symbol").count().collect()
    number = {(ROLES[r], first): i for i, (r, first) in enumerate(STATES)}
    n, symbols = len(STATES), {s: i for i, s in enumerate(SYMBOLS)}
    start, step, emit = np.ones(n), np.ones((n, n)), np.full((n, len(SYMBOLS)), 0.01)
    for j, (r, first) in enumerate(STATES):
        if not first:
            start[j] = 1e-9
            for i, (q, _) in enumerate(STATES):
                if q != r:
                    step[i, j] = 1e-9  # a turn goes on only in its own role
        for m in ROLES:  # a known marker opens a turn of its role; weak prior evidence for unseen roles
            for s, k in symbols.items():
                if s.startswith(f"{m}|"):
                    emit[j, k] = 1.0 if first and ROLES[r] == m else 1e-4
    for row in counts:
        i = number.get((row._role, row._first))
        if i is None:
            continue
        emit[i, symbols[row._symbol]] += row["count"]
        before = number.get((row._role_before, row._first_before))
        if before is None:
            start[i] += row["count"]
        else:
            step[before, i] += row["count"]
    return Model(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)),
                 np.log(emit / emit.sum(axis=1, keepdims=True)))


def _padded(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of many blocks as one table, longest block first: order, lengths and (blocks x lines) symbols."""
    sizes = np.array([len(g) for g in groups])
    order = np.argsort(-sizes, kind="stable")
    table = np.zeros((len(groups), sizes.max(initial=0)), dtype=np.int64)
    for row, i in enumerate(order):
        table[row, :sizes[i]] = groups[i]
    return order, sizes[order], table


def block_scores(model: Model, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per block: the best log scores from each state before it to each state at its end, and those of a block
    that begins its transcript. All blocks advance together, a line at a time."""
    order, sizes, table = _padded(groups)
    n = len(STATES)
    inner = np.broadcast_to(np.where(np.eye(n, dtype=bool), 0.0, -np.inf), (len(groups), n, n)).copy()
    first = np.zeros((len(groups), n))
    for t in range(table.shape[1]):
        k = int(np.searchsorted(-sizes, -t, "left"))  # blocks with more than t lines
        emit = model.emit[:, table[:k, t]].T
        inner[:k] = (inner[:k, :, :, None] + model.step).max(axis=2) + emit[:, None, :]
        first[:k] = (model.start if t == 0 else (first[:k, :, None] + model.step).max(axis=1)) + emit
    back = np.argsort(order)
    return inner[back], first[back]


def decoded(model: Model, groups: list[np.ndarray], entry: np.ndarray, leave: np.ndarray) -> list[np.ndarray]:
    """States of blocks that are entered from ``entry`` (-1: transcript's start) and end in ``leave``."""
    order, sizes, table = _padded(groups)
    entry, state = entry[order], leave[order].copy()
    score = np.where((entry < 0)[:, None], model.start, model.step[np.maximum(entry, 0)])
    pointers = []
    for t in range(table.shape[1]):
        k = int(np.searchsorted(-sizes, -t, "left"))
        if t:
            paths = score[:k, :, None] + model.step
            pointers.append(paths.argmax(axis=1))
            score[:k] = paths.max(axis=1)
        score[:k] += model.emit[:, table[:k, t]].T
    states = np.zeros(table.shape, dtype=np.int64)
    for t in range(table.shape[1] - 1, -1, -1):
        k = int(np.searchsorted(-sizes, -t, "left"))
        states[:k, t] = state[:k]
        if t:
            state[:k] = pointers[t - 1][np.arange(k), state[:k]]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(groups)
    for row, i in enumerate(order):
        out[i] = states[row, :sizes[row]]
    return out


def borders(scores: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """States at the ends of a transcript's consecutive blocks."""
    score, back = scores[0][1], []
    for inner, _ in scores[1:]:
        paths = score[:, None] + inner
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0)
    ends = [int(score.argmax())]
    for pointers in reversed(back):
        ends.append(int(pointers[ends[-1]]))
    return ends[::-1]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal first ``keys`` columns, which follow each other."""
    key, held = (), []
    for batch in sliced(batches, 4_096):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != key:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def _chunks(runs: Iterator[tuple[tuple, list[tuple]]], rows: int = 20_000) -> Iterator[list[tuple[tuple, list[tuple]]]]:
    """Runs in lists of about ``rows`` rows."""
    held, n = [], 0
    for run in runs:
        held.append(run)
        n += len(run[1])
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def parse(lines: DataFrame, model: Model, id_col: str = "conv_id", line_col: str = "line", text_col: str = "text",
          block: int = 512) -> DataFrame:
    """One row per line: transcript id, line, role, first (begins a turn), body (text without marker).

    Lines without a number count as number -1 and so come first.
    """
    symbols = {s: i for i, s in enumerate(SYMBOLS)}
    seen = observations(lines.select(
        F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{line_col}`").cast("long"), F.lit(-1)).alias("_line"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")))
    number = F.create_map(*[F.lit(x) for s, i in symbols.items() for x in (s, i)])
    # Lines are numbered within their transcript, so blocks are ranges of the line number.
    seen = stored(seen.withColumns({"_s": number[F.col("_symbol")], "_block": F.floor(F.col("_line") / block)}))
    id_type = seen.schema["_id"].dataType.simpleString()
    key = ["_id", "_block"]

    def schema(ddl: str) -> tuple[StructType, pa.Schema]:
        kind = _parse_datatype_string(f"struct<_id:{id_type},{ddl}>")
        return kind, to_arrow_schema(kind)

    def columns(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    chain_kind, chain_arrow = schema("_block:bigint,_m:array<double>,_f:array<double>")
    ends_kind, ends_arrow = schema("_block:bigint,_entry:int,_leave:int")
    out_kind, out_arrow = schema("line:bigint,role:string,first:boolean,body:string")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(_runs(batches, 2)):
            inner, first = block_scores(model, [np.array([r[0] for r in rows]) for _, rows in chunk])
            yield columns([(*k, m.ravel().tolist(), f.tolist())
                           for (k, _), m, f in zip(chunk, inner, first, strict=True)], chain_arrow)

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States at block ends: one small matrix per block of a transcript."""
        n = len(STATES)
        for chunk in _chunks(_runs(batches, 1)):
            rows = []
            for (doc,), blocks in chunk:
                ends = borders([(np.array(m).reshape(n, n), np.array(f)) for _, m, f in blocks])
                rows += [(doc, b[0], entry, leave) for b, entry, leave in zip(blocks, [-1, *ends[:-1]], ends, strict=True)]
            yield columns(rows, ends_arrow)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(_runs(batches, 2)):  # the first row of a block has its border states
            states = decoded(model, [np.array([r[1] for r in rows[1:]]) for _, rows in chunk],
                             np.array([rows[0][4] for _, rows in chunk]), np.array([rows[0][5] for _, rows in chunk]))
            made = []
            for (k, rows), path in zip(chunk, states, strict=True):
                for (line, _, body, opening, *_), state in zip(rows[1:], path.tolist(), strict=True):
                    role, first = STATES[state]
                    made.append((k[0], line, ROLES[role], first, opening if first else body))
            yield columns(made, out_arrow)

    dealt = seen.select(*key, "_line", "_text", "_s").repartition(*key).sortWithinPartitions(*key, "_line", "_text")
    chain = dealt.select(*key, "_s").mapInArrow(score, chain_kind)
    ends = chain.repartition("_id").sortWithinPartitions(*key).mapInArrow(join_blocks, ends_kind)
    none = F.lit(None)
    lines_of = seen.select(*key, F.lit(1).alias("_kind"), "_line", "_text", "_s", "_body", "_opening",
                           none.cast("int").alias("_entry"), none.cast("int").alias("_leave"))
    heads = ends.select(*key, F.lit(0).alias("_kind"), none.cast("long").alias("_line"), none.cast("string").alias("_text"),
                        none.cast("int").alias("_s"), none.cast("string").alias("_body"),
                        none.cast("string").alias("_opening"), "_entry", "_leave")
    both = heads.unionByName(lines_of).repartition(*key).sortWithinPartitions(*key, "_kind", "_line", "_text")
    out = both.select(*key, "_line", "_s", "_body", "_opening", "_entry", "_leave").mapInArrow(decode, out_kind)
    return out.withColumnRenamed("_id", id_col)


#: Label styles of raw transcripts, as (user, assistant, system, tool).
STYLES = [("User: ", "Assistant: ", "System: ", "Tool: "), ("Human: ", "AI: ", "Instructions: ", "Function: "),
          ("### User\n", "### Assistant\n", "### System\n", "### Tool\n"),
          ("<|user|>\n", "<|assistant|>\n", "<|system|>\n", "<|tool|>\n"),
          ("**Question:** ", "**Answer:** ", "**Context:** ", "**Result:** "),
          ("[customer]: ", "[agent]: ", "[system]: ", "[tool]: ")]


def offsets(rows: DataFrame, key: str, order: list[str], size: str, block: int = 512) -> DataFrame:
    """Add ``_before``: the sum of ``size`` over the earlier rows of ``key``; exact without a window per key.

    ``order[0]`` is a number; its ranges of ``block`` are summed first, so a key is spread over its ranges.
    """
    rows = rows.withColumn("_range", F.floor(F.col(order[0]) / block))
    sums = rows.groupBy(key, "_range").agg(F.sum(size).alias("_size"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_o"))
    within = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_w", F.coalesce(F.sum(size).over(within), F.lit(0)))
    on = F.col(key).eqNullSafe(F.col("_k")) & F.col("_range").eqNullSafe(F.col("_r"))
    return rows.join(sums, on).withColumn("_before", F.col("_o") + F.col("_w")).drop("_range", "_k", "_r", "_o", "_w")


#: A style of labels that no list of the model holds.
UNSEEN = [("Caller: ", "Operator: ", "Setup: ", "Lookup: ")]


def raw_lines(conversations: DataFrame, styles: list[tuple] = STYLES, unlabelled: int = 0) -> DataFrame:
    """Numbered lines of a plain transcript per conversation, with the true role of each line.

    The label style follows the conversation's hash; one turn in ten gets a label that names no role
    and, of the others, one in ``unlabelled`` none at all (0: every turn has a label).
    """
    role = F.lower(F.coalesce(F.col("role").cast("string"), F.lit("user")))
    number = F.coalesce(*[F.when(role == r, i) for i, r in enumerate(("user", "assistant", "system", "tool"))], F.lit(0))
    style = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in styles]),
                         (F.pmod(F.xxhash64("conv_id"), F.lit(len(styles))) + 1).cast("int"))
    label = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) == 0, F.lit("Speaker: ")).otherwise(
        F.element_at(style, number + 1))
    if unlabelled:
        label = F.when(F.pmod(F.xxhash64("turn", "conv_id"), F.lit(unlabelled)) == 0, F.lit("")).otherwise(label)
    names = F.array(*map(F.lit, ("user", "assistant", "system", "tool")))
    rows = conversations.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.element_at(names, number + 1).alias("true_role"),
        F.split(F.concat(label, F.coalesce(F.col("text").cast("string"), F.lit(""))), "\n", -1).alias("_lines"))
    rows = offsets(rows.withColumn("_n", F.size("_lines")), "conv_id", ["turn", "true_role", "_lines"], "_n")
    return rows.select("conv_id", "turn", "true_role", "_before", F.posexplode("_lines").alias("_i", "text")).select(
        "conv_id", (F.col("_before") + F.col("_i")).alias("line"), "text", "true_role", (F.col("_i") == 0).alias("true_first"))


def held_out(conv_id: Column) -> Column:
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def recover(lines: DataFrame) -> DataFrame:
    """Learn from the labelled lines that are not held out, parse all of them, and render the turns."""
    lines = stored(lines)
    seen = observations(lines.withColumn("_text", F.col("text"))).filter(~held_out(F.col("conv_id")))
    before = seen.select(F.col("conv_id").alias("_k"), (F.col("line") + 1).alias("_l"),
                         F.col("true_role").alias("_role_before"), F.col("true_first").alias("_first_before"))
    pairs = seen.join(before, F.col("conv_id").eqNullSafe(F.col("_k")) & (F.col("line") == F.col("_l")), "left")
    model = fit(pairs.select("_symbol", F.col("true_role").alias("_role"), F.col("true_first").alias("_first"),
                             "_role_before", "_first_before"))
    parsed = stored(parse(lines, model))
    truth = lines.select(F.col("conv_id").alias("_k"), F.col("line").alias("_l"), "true_role", "true_first")
    checked = parsed.join(truth, F.col("conv_id").eqNullSafe(F.col("_k")) & (F.col("line") == F.col("_l"))).groupBy("conv_id").agg(
        F.avg(((F.col("role") == F.col("true_role")) & (F.col("first") == F.col("true_first"))).cast("double")).alias("line_accuracy"))
    checked = checked.withColumnRenamed("conv_id", "_k")
    return turns(parsed).join(checked, F.col("conv_id").eqNullSafe(F.col("_k"))).drop("_k").withColumn(
        "held_out", held_out(F.col("conv_id")))


def turns(parsed: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per recovered turn: id, turn (from 0), first line, role, text and its canonical rendering.

    The lines of one turn are gathered; a turn is one message.
    """
    rows = offsets(parsed.withColumn("_one", F.col("first").cast("int")), id_col, ["line", "body"], "_one")
    numbered = rows.withColumn("turn", F.greatest(F.col("_before") + F.col("_one") - 1, F.lit(0)))
    return numbered.groupBy(id_col, "turn").agg(
        F.min("line").alias("line"), F.first("role").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("text")
    ).withColumn("rendered", render(F.col("role"), F.trim("text")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>"))
