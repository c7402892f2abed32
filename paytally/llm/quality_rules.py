"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of each text are computed once. A forest of shallow trees is grown on labelled rows; every path
from a root to a node becomes a conjunctive rule. A lasso logistic regression over the rules drops most of
them, and the rest are compiled into one Spark column expression, which scores all documents without
Python.

``max_labelled`` bounds the labelled rows that train the model (a share of them drawn by id hash); scoring
covers every row. Labels, language, source and id are never inputs.

Defined results: null and empty texts have statistics of zero and get a score like any other; labels that
are null or whose document is missing are ignored; repeated rows get equal scores; without two classes
of labels, or with too few for a split, the score is the share of label 1 (0.5 without labels); a score
equal to the threshold predicts 1; texts of any length are read whole; an empty table gives no rows; only
the id and the text are read, so extra columns cannot clash. The forest draws rows by partition, so scores
may differ slightly between clusters of other sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import map_texts, narrow, stored

STATISTICS = ["log_bytes", "log_words", "word_length", "distinct_words", "top_word", "upper", "digits",
              "marks", "blanks", "other_bytes", "line_length", "repeated_lines", "marks_at_end",
              "repeat_next", "longest_word", "sentence_ends"]

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,")
_BLANKS = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))


def statistics(text: bytes) -> list[float]:
    """The values of STATISTICS for one text."""
    n = len(text)
    words = text.split()
    if not words:
        return [math.log1p(n)] + [0.0] * (len(STATISTICS) - 1)

    def share(chars: bytes) -> float:
        return (n - len(text.translate(None, chars))) / n

    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = Counter(w[-1:] for w in words)
    marked = sum(k for c, k in ends.items() if c in _MARKS)
    return [
        math.log1p(n), math.log1p(len(words)), (n - len(words)) / len(words), len(counts) / len(words),
        counts.most_common(1)[0][1] / len(words), share(_UPPER), share(_DIGITS), share(_MARKS),
        share(_BLANKS), share(_HIGH), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        marked / len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
        math.log1p(max(map(len, counts))), ends.get(b".", 0) / len(words)]


def with_statistics(docs: DataFrame) -> DataFrame:
    def batch(ids: list, texts: list[bytes]) -> dict:
        columns = zip(*map(statistics, texts), strict=True) if texts else [[]] * len(STATISTICS)
        keys = [hashlib.sha256(t).digest() for t in texts]
        return {"doc_id": ids, "text_key": keys} | dict(zip(STATISTICS, map(list, columns), strict=True))

    return map_texts(docs, "doc_id; text_key binary; " + "; ".join(f"{s} double" for s in STATISTICS), batch)


Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", threshold), all must hold


def _paths(node, names: list[str]) -> list[Rule]:
    """Rules of all nodes below the root of one tree."""
    found: list[Rule] = []

    def walk(node, path: dict) -> None:
        if path:
            found.append(tuple((f, op, t) for (f, op), t in sorted(path.items())))
        if node.numDescendants() == 0:
            return
        name, cut = names[node.split().featureIndex()], node.split().threshold()
        low, high = (name, "<="), (name, ">")
        walk(node.leftChild(), path | {low: min(cut, path.get(low, cut))})
        walk(node.rightChild(), path | {high: max(cut, path.get(high, cut))})

    walk(node, {})
    return found


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, cut in rule:
        out = out & (F.col(name) <= cut if op == "<=" else F.col(name) > cut)
    return out


class Ensemble:
    """Rules with weights; ``score`` is a column expression over the statistics."""

    def __init__(self, intercept: float, rules: dict[Rule, float]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules.items():
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, trees: int = 24, depth: int = 3, l1: float = 0.002, seed: int = 7) -> Ensemble:
    """Fit on rows with the statistics and ``quality`` (0 or 1)."""
    share = {r[0]: r[1] for r in labelled.groupBy("quality").count().collect()}
    n = sum(share.values())
    value = (share.get(1, 0) + 0.5) / (n + 1)
    constant = Ensemble(math.log(value / (1 - value)), {})
    if len(share) < 2:
        return constant
    rows = labelled.withColumn("_w", F.when(F.col("quality") == 1, n / (2 * share[1])).otherwise(n / (2 * share[0])))
    rows = VectorAssembler(inputCols=STATISTICS, outputCol="_x").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="quality", weightCol="_w", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="sqrt", subsamplingRate=0.7, minInstancesPerNode=5, seed=seed).fit(rows)
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._java_obj.rootNode(), STATISTICS)})
    if not rules:  # too few rows for a single split
        return constant
    table = labelled.select("quality", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_x").transform(table)
    lasso = LogisticRegression(featuresCol="_x", labelCol="quality", elasticNetParam=1.0, regParam=l1,
                               standardization=False, maxIter=60).fit(table.select("quality", "_x"))
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept),
                    {r: float(w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6})


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.7, max_labelled: int = 40_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return score_texts(docs, labels, id_col, text_col, threshold, max_labelled).drop("text_key")


def score_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = 0.7, max_labelled: int = 40_000) -> DataFrame:
    """``score_quality`` with ``text_key``, the SHA-256 of the text, which tells rows of one id apart."""
    stats = stored(with_statistics(narrow(docs, id_col, text_col)))
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("quality"))
    known = stored(stats.filter(~held_out(F.col("doc_id"))).join(marks, "doc_id"))
    n = known.count()
    if n > max_labelled:  # a hashed share of the rows, near max_labelled
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_labelled / n))
    model = fit(known)
    return stats.select("doc_id", "text_key", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score")).select(
        "*", (F.col("score") >= threshold).cast("int").alias("predicted"))
