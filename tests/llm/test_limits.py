"""Long entities, ids of any type, formats that run out, lines without numbers."""

import hashlib
import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from paytally.llm import context_tree, imatch, surrogates, transcripts


def test_a_long_entity_costs_no_more_per_character(spark, docs_of):
    def seconds(n):
        start = time.time()
        row = surrogates.report(docs_of([(1, "key " + "0123456789abcdef" * (n // 16) + " end"),
                                         (2, "z" * n + "_b@mail.example.com")]), "k").orderBy("doc_id").collect()
        assert len(row[0].text) == n + 8 and row[0].n_entities == 1 and "0123456789abcdef" not in row[0].text
        assert len(row[1].text) == n + 19 and row[1].text[n] == "_" and "zzzzzzzzzz" not in row[1].text
        return time.time() - start

    seconds(16_000)
    assert seconds(1 << 20) < 60


def test_formats_that_run_out_grow(spark):
    entities = spark.range(1_200).select(F.lit("ssn").alias("kind"), F.format_string("%03d-00-0000", F.col("id") % 1_000).alias("canon"),
                                         "id").filter("id < 1000").select("kind", "canon")
    short = spark.createDataFrame([("phone", f"+{i}") for i in range(10)], "kind string, canon string")
    got = surrogates.assign(entities.union(short), "k").collect()
    assert len(got) == 1_010 and len({(r.kind, r.surrogate) for r in got}) == 1_010
    assert not {r.surrogate for r in got} & {r.canon for r in got}


def plain_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] or ""))
    out = Counter()
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        t, after = t or "", after or ""
        k = len(t) // 4
        out[i, len(t), hashlib.sha256((t[:len(t) - k] + after[:k]).encode()).hexdigest()] += 1
    return out


def test_imatch_with_text_ids(spark):
    rows = [(f"doc-{i}", f"word{i} shared other{i % 4} words here {i}") for i in range(60)]
    rows += [(None, f"no id {i} " * 4) for i in range(30)] + [("doc-7", f"same id {i} " * 5) for i in range(30)] + [("doc-7", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    for buckets in (1, 7):
        got = imatch.fingerprint_documents(docs, low=0.02, high=0.5, buckets=buckets).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == plain_next(rows)
    words = imatch.lexicon(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 0.02, 0.5)
    subsets = imatch.Subsets(words)
    marks = {t: subsets.fingerprint(imatch.terms((t or "").encode())) for _, t in rows}
    by_text = {(r.doc_id, r.n_chars): r.fingerprint for r in got}
    assert all(by_text[i, len(t or "")] in {marks[u].astype(">u4").tobytes().hex() for j, u in rows if j == i} for i, t in rows)


def test_no_candidate_grows_with_the_tasks(spark):
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(50)) + " common") for i in range(400)]
    for parts in (1, 40):
        assert imatch.lexicon(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 0.01, 1.0) == [b"common"]


def test_lines_without_a_number_stay(spark):
    lines = spark.createDataFrame([("a", 0, "User: hi", "user", True), ("a", 1, "Assistant: hello", "assistant", True)],
                                  "conv_id string, line long, text string, true_role string, true_first boolean")
    seen = transcripts.observations(lines.withColumn("_text", F.col("text")))
    model = transcripts.fit(seen.select("_symbol", F.col("true_role").alias("_role"), F.col("true_first").alias("_first"),
                                        F.lit(None).cast("string").alias("_role_before"),
                                        F.lit(None).cast("boolean").alias("_first_before")))
    more = spark.createDataFrame([("a", None, "User: hi"), ("a", 0, "Assistant: yes"), (None, None, "User: x"), (None, 3, None)],
                                 "conv_id string, line long, text string")
    got = transcripts.parse(more, model).collect()
    assert Counter((r.conv_id, r.line) for r in got) == Counter([("a", -1), ("a", 0), (None, -1), (None, 3)])


def plain_viterbi(model, symbols):
    """Best path of one transcript; equal scores go to the lower state."""
    n = len(transcripts.STATES)
    score, back = [model.start[j] + model.emit[j, symbols[0]] for j in range(n)], []
    for s in symbols[1:]:
        came = [max(range(n), key=lambda i: (score[i] + model.step[i, j], -i)) for j in range(n)]
        score = [score[came[j]] + model.step[came[j], j] + model.emit[j, s] for j in range(n)]
        back.append(came)
    path = [max(range(n), key=lambda i: (score[i], -i))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_parsing_equals_plain_viterbi(spark):
    rng = random.Random(11)
    marks = ["User: ", "Assistant: ", "Caller: ", "", "", "System: ", "```", "- "]
    texts = [(f"c{c}" if c else None, i, rng.choice(marks) + "word " * rng.randint(0, 50) + rng.choice(["", "?"]))
             for c in range(60) for i in range(rng.choice([1, 2, 5, 40]))]
    lines = spark.createDataFrame(texts, "conv_id string, line long, text string").repartition(5)
    model = transcripts.fit(spark.createDataFrame(
        [("user", True, None, None, "user|short|plain"), ("user", False, "user", True, "none|long|plain"),
         ("assistant", True, "user", False, "assistant|middle|plain"), ("assistant", False, "assistant", True, "none|short|list")],
        "_role string, _first boolean, _role_before string, _first_before boolean, _symbol string"))
    symbols = {s: i for i, s in enumerate(transcripts.SYMBOLS)}
    seen = transcripts.observations(lines.withColumnRenamed("text", "_text")).collect()
    by_conv = {}
    for r in sorted(seen, key=lambda r: r.line):
        by_conv.setdefault(r.conv_id, []).append((r.line, symbols[r._symbol]))
    for block in (3, 512):
        got = {(r.conv_id, r.line): transcripts.STATES.index((transcripts.ROLES.index(r.role), r.first))
               for r in transcripts.parse(lines, model, block=block).collect()}
        assert len(got) == len(texts)
        for conv, listed in by_conv.items():
            path = [got[conv, line] for line, _ in listed]
            want = plain_viterbi(model, [s for _, s in listed])
            if block == 512:
                assert path == want
            total = [sum(model.emit[j, s] for j, (_, s) in zip(p, listed)) + model.start[p[0]]
                     + sum(model.step[i, j] for i, j in zip(p, p[1:])) for p in (path, want)]
            assert abs(total[0] - total[1]) < 1e-9
    assert transcripts.parse(lines.limit(0), model).count() == 0


def test_transcripts_with_unseen_and_missing_labels(spark):
    rng = random.Random(21)
    words = lambda n: " ".join(rng.choice(["what", "then", "more", "of", "it", "words"]) for _ in range(n))
    rows = [(c, t, ["user", "assistant"][t % 2], words(6) + "?" if t % 2 == 0 else "\n".join(words(30) for _ in range(3)))
            for c in range(80) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = transcripts.raw_lines(table, transcripts.STYLES + transcripts.UNSEEN, unlabelled=8)
    texts = [r.text for r in lines.filter("true_first").collect()]
    known = {label.split("\n")[0] for style in transcripts.STYLES for label in style}
    assert any(t.startswith(("Caller", "Operator")) for t in texts)
    assert 10 < sum(not t.startswith((*known, "Caller", "Operator", "Speaker")) for t in texts) < 120
    got = [r.line_accuracy for r in transcripts.recover(lines).filter("held_out").select("conv_id", "line_accuracy").distinct().collect()]
    assert sum(got) / len(got) > 0.8


def test_bits_per_byte(docs_of):
    rows = [(i, f"some text that repeats {i % 3}") for i in range(40)] + [(90, ""), (91, None)]
    got = {r.doc_id: r for r in context_tree.score(docs_of(rows), depth=2).collect()}
    assert got[90].bits_per_byte is None and got[91].bits_per_byte is None
    for i, t in rows[:40]:
        assert abs(got[i].bits_per_byte + got[i].score / math.log10(2) / len(t)) < 1e-9 and 0 < got[i].bits_per_byte < 8
