"""Collocations, archives and fill-in-the-middle against plain versions, on whole small tables and hard rows."""

import base64
import hashlib
import io
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paytally.llm import catalog, collocations, fill_middle, warc

from .conftest import HARD, SF

driver_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


# 11: collocations

def plain_collocations(rows, threshold, order, top, cover):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, order + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i:i + n])] += 1
    good = {k: a for k, a in counts.items() if a >= threshold and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, words), a in good.items():
        longer = [b for (other, w), b in good.items() if other == lang and len(w) > len(words)
                  and any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if any(100 * b >= cover * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        value, _, left, right = min(cuts)
        out[lang].append((-value, -a, " ".join(words).encode(), left, right))
    return {(lang, rank, phrase.decode(), -a, left, right, total[lang], -value) for lang, found in out.items()
            for rank, (value, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)}


def columns(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@driver_tables
def test_collocations_of_the_corpus(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert columns(catalog.op11_collocations(spark, SF)) == plain_collocations(rows, 30, 4, 2_000, 80)


def some_text(rng, n):
    words = ["The", "cat", "sat", "on", "mat", "Ünïcode", "ß", " x", "cat\x1csat"]
    return "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("partition_mass", [1 << 24, 40])
def test_collocations_of_hard_rows(spark, monkeypatch, partition_mass):
    rng = random.Random(3)
    rows = [(None, None), ("en", ""), ("en", " \t\n"), ("", "a b a b a b a b"), ("en", "!!!"), ("de", "word " * 400)]
    rows += [(rng.choice([None, "en", "de"]), some_text(rng, rng.randint(1, 60))) for _ in range(60)]
    rows += [rows[-1]] * 20
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, k int")
    counts = collocations.frequent(docs, 4, 5, partition_mass=partition_mass)
    for top, cover in ((2_000, 80), (3, 40)):
        assert columns(collocations.score(counts, 4, top, cover)) == plain_collocations(rows, 5, 4, top, cover)
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs.filter("text = ''")).count() == 0


@pytest.mark.parametrize("limit,ids", [(7, 4), (64, 21), (5, 3)])
def test_batches_carry_words_over(monkeypatch, limit, ids):
    """N-grams across the ends of batches, pieces of a text and a fresh numbering are counted once."""
    monkeypatch.setattr(collocations, "IDS", ids)
    rng = random.Random(limit)
    texts = [some_text(rng, rng.randint(0, 40)).encode() for _ in range(30)]
    want = Counter()
    for text in texts:
        for piece in b" ".join(w for part in collocations.words_of(text) for w in part).split(collocations.MARK):
            words = piece.split()
            for n in range(1, 5):
                want.update(b" ".join(words[i:i + n]) for i in range(len(words) - n + 1))
    got = Counter()

    def flush(new_ids, new, batch):
        for n, (_, valid) in enumerate(collocations.gram_hashes(new_ids, batch.hashes, 4), 1):
            for e in np.flatnonzero(valid):
                if e >= new:
                    got[b" ".join(batch.words[i] for i in new_ids[e - n + 1:e + 1])] += 1
        return iter(())

    held = collocations.Batch(4, flush, limit)
    original = collocations.words_of
    monkeypatch.setattr(collocations, "words_of", lambda text: original(text, 20))
    for text in texts:
        list(held.add("en", text))
    list(held.out())
    assert got == want


@settings(max_examples=60, deadline=None)
@given(parts=st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 400), max_size=30), max_size=12),
       capacity=st.integers(1, 20), threshold=st.integers(2, 50), pending=st.integers(0, 40))
def test_summaries_keep_what_is_frequent(parts, capacity, threshold, pending):
    summary, want = collocations.Summary(capacity, threshold, pending), Counter()
    for part in parts:
        keys = np.array(sorted(part), np.uint64) * np.uint64(987654321)
        counts = np.array([part[k] for k in sorted(part)], np.int64)
        summary.add(*collocations.unpack(*collocations.pack(keys, counts)))
        want.update(part)
    kept = set(summary.survivors().tolist())
    assert {k * 987654321 for k, c in want.items() if c >= threshold} <= kept
    assert summary.off < threshold and summary.mass == sum(want.values())
    assert len(summary.keys) <= summary.capacity
    if capacity > summary.mass / threshold:
        assert summary.capacity == capacity  # the promised size suffices


def test_summary_bitmap(spark):
    rng = random.Random(1)
    v = [rng.getrandbits(46) for _ in range(500)]
    for width in (15, 18):
        got = collocations.bitmap(spark.createDataFrame([(x,) for x in v], "v long"), width)
        bits = set(np.flatnonzero(np.unpackbits(got, bitorder="little")).tolist())
        assert bits == {x & ((1 << width) - 1) for x in v}


# 12: archives

PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "", ""), (5, "http://a/\r\nX: y", "same"),
         (None, "http://n", "same"), (None, None, "only"), (6, "u", "twice"), (6, "u", "twice"), (6, "u", "twice"),
         (6, "v", "twice"), (7, "http://ü/ß", "中文 текст"), (8, "u8", "a\r\n\r\nb\r\n\r\n"), (9, "u9", "x" * 300_000)]
SCHEMA = "page_id long, url string, html string, payload string, key int, h string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "h") for r in rows], SCHEMA)


def plain_records(rows, min_bytes=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row."""
    out, heads = Counter(), {}
    for i, (page, url, html) in enumerate(rows):
        data = (html or "").encode()
        rank = (page is not None, page or 0, url is not None, url or "", -i)
        if data not in heads or rank > heads[data][0]:
            heads[data] = (rank, i, page)
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        response = heads[data][1] == i or len(data) < min_bytes
        out[page, len(data), digest, "response" if response else "revisit", None if response else heads[data][2]] += 1
    return out


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives_of_hard_rows(spark, min_bytes):
    got = warc.round_trip(pages_of(spark, PAGES), min_bytes=min_bytes)
    assert Counter(map(tuple, got.collect())) == plain_records(PAGES, min_bytes)
    assert warc.round_trip(pages_of(spark, [])).count() == 0


@driver_tables
def test_archives_of_the_pages(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert Counter(map(tuple, catalog.op12_warc(spark, SF).collect())) == plain_records(rows)


def test_archives_hold_whole_records(spark, tmp_path):
    """Standard gzip reading, payloads, ids and references; small files; every range size gives the same records."""
    import gzip

    files = warc.write_warc(pages_of(spark, PAGES).repartition(3), f"{tmp_path}/w", max_file=600)
    assert files.count() > 3 and {r.path for r in files.collect()} == {f"{tmp_path}/w/{n}" for n in os.listdir(tmp_path / "w")}
    whole = warc.read_warc(files).collect()
    assert len(whole) == len(PAGES) and len({r.record_id for r in whole}) == len(PAGES)
    by_id = {r.record_id: r for r in whole}
    for r in whole:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert r.payload_digest == r.stated_digest == warc.base32_sha1(r.payload) and r.payload_bytes == len(r.payload)
        with open(r.path, "rb") as f:
            data = f.read()
        content = gzip.decompress(data[r.offset:r.offset + r.length])
        if r.record_type == "revisit":
            head = by_id[re.search(rb"WARC-Refers-To: (\S+)", content)[1].decode()]
            assert head.record_type == "response" and head.payload_digest == r.payload_digest
        assert content.count(b"\r\nX: y") == 0
    assert Counter(r.payload.decode() for r in whole if r.payload is not None) == Counter({h or "" for _, _, h in PAGES})
    for split in (1, 97, 5_000):
        again = warc.read_warc(files, split=split)
        assert Counter(again.collect()) == Counter(whole)
    assert warc.gaps(files, warc.read_warc(files)).filter("bytes <> covered").count() == 0
    assert warc.read_warc(warc.listed(spark, f"{tmp_path}/w")).count() == len(PAGES)


def read(data, start=0, stop=None, block=1 << 20):
    file = pa.PythonFile(io.BytesIO(data), "r")
    return list(warc.records_in(file, len(data), start, len(data) if stop is None else stop, block))


def a_record(payload, i=0):
    return warc.member(warc.record("response", warc.record_id(i), "u", str(i), "00" * 20, len(payload), payload, "d", None))


def test_no_record_inside_another():
    inner = a_record(b"inner")
    noise = random.Random(5).randbytes(70_000)
    data = a_record(noise + inner + noise + inner) + a_record(b"next", 1)
    assert len(read(data)) == 2
    for start in range(0, len(data), 3_001):
        assert all(o in (0, len(data) - len(a_record(b"next", 1))) for o, *_ in read(data, start))
    loose = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)  # an archive that stores bytes as they are
    outer = loose.compress(warc.record("response", "i", "u", "1", "00" * 20, 9, noise + inner + noise, "d", None)) + loose.flush()
    assert len(read(outer)) == 1 and read(outer)[0][1] == len(outer)


def test_damaged_and_foreign_bytes():
    good = [a_record(b"one"), a_record(b"two" * 1_000, 1), a_record(b"", 2)]
    import gzip

    other = gzip.compress(b"no record") + b"\x1f\x8b\x08" + b"rubbish" + gzip.compress(b"WARC/1.0 but no header")
    broken = bytearray(a_record(b"bad" * 100, 3))
    broken[-6] ^= 1
    data = good[0] + other + good[1] + bytes(broken) + good[2] + a_record(b"cut off", 4)[:-3]
    for block in (16, 64, 1 << 20):
        found = read(data, block=block)
        assert [f["page-id"] for _, _, f, _ in found] == ["0", "1", "2"]
    cuts = sorted(random.Random(2).sample(range(len(data)), 9)) + [len(data)]
    parts = [r for a, b in zip([0, *cuts], cuts) for r in read(data, a, b)]
    assert [o for o, *_ in parts] == [o for o, *_ in read(data)]


# 13: fill in the middle

def plain_fill(doc_id, text, plain_from=90, spm_below=20):
    text = text or ""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < spm_below:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@driver_tables
def test_fill_in_the_middle_of_the_corpus(spark):
    want = {r.doc_id: (r.text or "", plain_fill(r.doc_id, r.text))
            for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.op13_fill_middle(spark, SF).collect()
    assert len(got) == len(want) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text, (*parts, output) = want[r.doc_id]
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == parts
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_the_middle_of_hard_rows(spark, docs_of):
    rows = [*HARD, (20, "with <S> in it"), (21, "<P"), (22, "é \U0001f600\r\n\x00" * 9), (23, "long " * 120_000)]
    got = fill_middle.fill_in_middle(docs_of(rows, extra=True))
    back = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back) == \
        Counter((i, *plain_fill(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.back) for r in back) == Counter((i, t or "") for i, t in rows)
    assert fill_middle.fill_in_middle(docs_of([])).count() == 0


def test_other_units_and_ids(spark):
    docs = spark.createDataFrame([(f"id-{i}", "one two  three\nfour " * (i % 5)) for i in range(60)], "name string, body string")
    got = fill_middle.fill_in_middle(docs, unit=r"\S+\s*", id_col="name", text_col="body").collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        i = int(r.doc_id[3:])
        text = "one two  three\nfour " * (i % 5)
        assert r.n == 4 * (i % 5)
        if r.form != "plain":
            ends = [0] + [m.end() for m in re.finditer(r"\S+\s*", text)]
            assert r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends
    assert fill_middle.transform("a", "  starts blank", r"\S+\s*", 100, 0) == (None, "plain", None, None, "  starts blank")


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_units_in_blocks(block):
    rng = random.Random(block)
    for unit in (fill_middle.CODE_POINT, r"\S+\s*", r"[^\n]*\n"):
        for _ in range(40):
            text = "".join(rng.choice("ab \n中") for _ in range(rng.randint(0, 80)))
            whole = fill_middle.unit_ends(text, unit)
            parts = fill_middle.unit_ends(text, unit, block)
            assert (None if parts is None else list(parts)) == whole
