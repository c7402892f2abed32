"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

**Writing.** Rows with equal payloads form a group; the row with the largest id is written as a
``response`` record, every other one as a ``revisit`` record that names it and carries no payload.
Only responses move a payload, through one aggregation on the payload's SHA-256, and a hot payload is
combined map-side into one row per task. Revisits come from (digest, id, url) alone; repeated rows are
counted and dealt out again in blocks. Each task writes gzip files with one member per record, under
a name of its own; the manifest lists the files of the attempts that succeeded, so files of a lost
executor are never read.

**Reading.** A task gets a byte range of a file. It scans for the gzip magic, validates a candidate
by decoding the member and the WARC header in it, and owns exactly the records that start inside its
range, reading past the end for the last one. A candidate that does not decode to one whole record
is no record, and the scan goes on one byte further. The writer breaks up gzip magic inside payloads,
so that no record hides in another one; for archives from elsewhere ``gaps`` shows bytes that no
record or more than one covers.

Defined results: a null payload is empty; a null id is lower than any other and stays null; a null or
empty url is written as ``about:blank``; rows equal in id, url and payload give one response and
revisits of it; payloads may be of any length up to the 2 GB of a value; an empty table gives an
empty manifest and no records. Only the three named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from paytally.functions.ordered import scratch
from paytally.functions.skew import skewed_join
from paytally.llm.common import sliced, stored

MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"

#: Fixed by the format's standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = StructType([StructField("path", StringType()), StructField("length", LongType()),
                       StructField("n_records", LongType())])

RECORDS = StructType([
    StructField("path", StringType()), StructField("offset", LongType()), StructField("length", LongType()),
    StructField("record_type", StringType()), StructField("record_id", StringType()),
    StructField("target_uri", StringType()), StructField("warc_date", StringType()),
    StructField("page_id", StringType()), StructField("refers_to", StringType()),
    StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()),
    StructField("stated_digest", StringType()), StructField("payload", BinaryType())])


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file; a path without a scheme is local."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub(r"^file:", "", uri)


# --- records -----------------------------------------------------------------------------------


def _plain(value: str) -> str:
    """A header value without line breaks or other control characters."""
    return "".join(quote(c) if ord(c) < 33 or c in "%\x7f" else c for c in value)


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "") or "about:blank"


def record_id(*parts) -> str:
    """A name that follows from the parts."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, url: str | None, page_id: str | None, sha1: str, size: int,
           payload: bytes | None, date: str, refers: tuple[str, str | None] | None) -> bytes:
    """One uncompressed record; ``sha1`` is the payload's digest in hexadecimal."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {_uri(url)}",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if page_id is not None:
        lines.append(f"Page-Id: {_plain(page_id)}")
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers[0]}"]
        if refers[1] is not None:
            lines.append(f"Refers-To-Page-Id: {_plain(refers[1])}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(content: bytes, level: int = 6) -> bytes:
    """One gzip member. A flush inside every gzip magic of the content keeps stored bytes apart."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out, at = [], 0
    while (found := content.find(MAGIC, at)) >= 0:
        out += [packer.compress(content[at:found + 1]), packer.flush(zlib.Z_SYNC_FLUSH)]
        at = found + 1
    out += [packer.compress(content[at:]), packer.flush()]
    return b"".join(out)


def parse(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (names in lower case) and block of exactly one record, or None."""
    head, found, rest = content.partition(END)
    if not found or not head.startswith(b"WARC/"):
        return None
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded line
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon:
            return None
        fields[name] = value.strip()
    size = fields.get("content-length", "")
    if "warc-type" not in fields or not (size.isascii() and size.isdigit()) or rest[int(size):] != END:
        return None
    return fields, rest[:int(size)]


# --- writing -----------------------------------------------------------------------------------


def groups(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """The records to write: page_id, url, payload (null for a revisit), sha1, size, head_id, head_url."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = (pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                         payload.alias("payload"))
            .withColumn("size", F.octet_length("payload").cast("long")))
    none = F.lit(None)
    single = rows.filter(F.col("size") < min_bytes).select(
        "page_id", "url", "payload", F.sha1("payload").alias("sha1"), "size",
        none.cast(rows.schema["page_id"].dataType).alias("head_id"), none.cast("string").alias("head_url"),
        F.lit("").alias("key"))
    rows = rows.filter(F.col("size") >= min_bytes).withColumn("key", F.sha2("payload", 256))
    heads = rows.groupBy("key").agg(F.max(F.struct("page_id", "url", "payload")).alias("h"))
    responses = heads.select("h.page_id", "h.url", "h.payload", F.sha1("h.payload").alias("sha1"),
                             F.octet_length("h.payload").cast("long").alias("size"),
                             F.lit(None).cast(rows.schema["page_id"].dataType).alias("head_id"),
                             F.lit(None).cast("string").alias("head_url"), "key")
    rest = revisits(rows.select("key", "page_id", "url", F.sha1("payload").alias("sha1"), "size"))
    found = responses.unionByName(rest)
    return found.unionByName(single) if min_bytes > 0 else found


def revisits(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """Every row of ``rows`` (key, page_id, url, sha1, size) but one of each key's largest, without payloads."""
    kinds = rows.groupBy("key", "page_id", "url", "sha1", "size").agg(F.count(F.lit(1)).alias("n"))
    heads = (kinds.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("h"), F.sum("n").alias("all"))
             .filter("all > 1").select("key", "h"))
    found = skewed_join(kinds, heads, ["key"], spread=["page_id", "url"])
    is_head = F.struct("page_id", "url").eqNullSafe(F.col("h"))
    copies = found.withColumn("n", F.col("n") - is_head.cast("long")).filter("n > 0")
    blocks = copies.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))))
    dealt = blocks.repartition("key", "page_id", "url", "b")  # a row that repeats often becomes many blocks
    left = F.least(F.lit(block).cast("long"), F.col("n") - F.col("b") * block)
    return (dealt.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), left)))
            .select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha1", "size",
                    F.col("h.page_id").alias("head_id"), F.col("h.url").alias("head_url"), "key"))


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id",
               url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z",
               max_file: int = 1 << 30) -> DataFrame:
    """Write one record per row into ``folder`` and return the manifest (path, length, n_records).

    Payloads of at least ``min_bytes`` are stored once each. ``folder`` may be any address that
    pyarrow opens; without one, a new folder under the checkpoint folder is used and removed when the
    session ends. A file is closed once it holds ``max_file`` bytes.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc") if folder is None else folder
    found = groups(pages, min_bytes, id_col, url_col, payload_col)
    as_text = {c: F.col(c).cast("string") for c in ("page_id", "head_id")}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(folder)
        out, done, name, n = None, [], "", 0
        for batch in sliced(batches, 200):
            for row in batch.to_pylist():
                if out is None:
                    where.create_dir(base, recursive=True)
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                ident, payload = (row["page_id"], row["url"], row["key"]), row["payload"]
                if payload is not None and row["key"]:
                    kind, own, refers = "response", record_id(*ident), None
                elif payload is not None:
                    kind, own, refers = "response", record_id(*ident, name, n), None
                else:
                    head = record_id(row["head_id"], row["head_url"], row["key"])
                    kind, own, refers = "revisit", record_id(*ident, name, n), (head, row["head_id"])
                out.write(member(record(kind, own, row["url"], row["page_id"], row["sha1"], row["size"], payload,
                                        date, refers)))
                n += 1
                if out.tell() >= max_file:
                    done.append((f"{folder.rstrip('/')}/{name}", out.tell(), n))
                    out.close()
                    out = None
        if out is not None:
            done.append((f"{folder.rstrip('/')}/{name}", out.tell(), n))
            out.close()
        if done:
            path, length, count = zip(*done, strict=True)
            yield pa.RecordBatch.from_pydict({"path": path, "length": length, "n_records": count},
                                             pa.schema([("path", pa.string()), ("length", pa.int64()),
                                                        ("n_records", pa.int64())]))

    return stored(found.withColumns(as_text).mapInArrow(write, MANIFEST))


# --- reading -----------------------------------------------------------------------------------


class _Bytes:
    """Random access to a file through one cached block."""

    def __init__(self, file: pa.NativeFile, size: int, block: int):
        self.file, self.size, self.block, self.start, self.held = file, size, block, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if not self.start <= offset <= offset + n <= self.start + len(self.held):
            want = min(max(self.block, n), self.size - offset)
            self.start, self.held = offset, self.file.read_at(want, offset) if want > 0 else b""
        return self.held[offset - self.start:offset - self.start + n]

    def magic(self, offset: int, stop: int) -> int:
        """Offset of the first gzip magic that starts in [offset, stop), or -1."""
        while offset < stop:
            n = min(self.block, stop - offset + len(MAGIC) - 1, self.size - offset)
            found = self.at(offset, n).find(MAGIC)
            if found >= 0:
                return offset + found if offset + found < stop else -1
            if offset + n >= self.size:
                return -1
            offset += max(1, n - len(MAGIC) + 1)
        return -1

    def decoded(self, offset: int, piece: int = 1 << 14) -> tuple[bytes, int] | None:
        """Content and end of the gzip member at ``offset``; None if it is not a whole WARC record."""
        unpacker, out, at = zlib.decompressobj(31), [], offset
        try:
            while not unpacker.eof:
                data = self.at(at, min(piece, self.size - at))
                if not data:
                    return None
                at += len(data)
                out.append(unpacker.decompress(data))
                if len(out) == 1 and not b"WARC/".startswith(out[0][:5]):
                    return None
                piece = min(2 * piece, 1 << 20)
        except zlib.error:
            return None
        return b"".join(out), at - len(unpacker.unused_data)


def records_in(file: pa.NativeFile, size: int, start: int, stop: int,
               block: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, end, header fields, block) of the records of a file that start in [start, stop)."""
    data, at = _Bytes(file, size, block), start
    while (at := data.magic(at, stop)) >= 0:
        found = data.decoded(at)
        parsed = found and parse(found[0])
        if not parsed:
            at += 1
            continue
        yield at, found[1], *parsed
        at = found[1]


def _row(path: str, offset: int, end: int, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, payload = fields["warc-type"].lower(), block
    size = len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(END)
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        size = int(stated[1]) if stated else len(payload)
    stated = fields.get("warc-payload-digest")
    stated = stated and stated.partition(":")[2]
    page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
    revisit = kind == "revisit"
    return (path, offset, end - offset, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"),
            fields.get("warc-date"), page and unquote(page), refers and unquote(refers),
            size if revisit else len(payload), stated if revisit else base32_sha1(payload), stated,
            payload if payloads and not revisit else None)


def listed(spark, folder: str) -> DataFrame:
    """(path, length) of the archives in a folder that Spark can list."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path", "length")


def read_warc(files: DataFrame, split: int = 1 << 25, payloads: bool = True) -> DataFrame:
    """Records of the archives listed by ``files`` (path, length), one row each.

    Files are cut into ranges of ``split`` bytes, dealt evenly over tasks. page_id and refers_to are
    texts. payload_digest is computed from the payload where there is one, and is the stated one in
    a revisit; ``payloads=False`` leaves the payload null.
    """
    step = F.lit(split).cast("long")
    ranges = files.filter("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))
    n = files.filter("length > 0").agg(F.sum(F.expr(f"(length - 1) div {split} + 1"))).first()[0] or 1
    arrow = pa.schema([(f.name, pa.binary() if f.name == "payload" else
                        pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in RECORDS])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, type=f.type) for column, f in zip(zip(*rows, strict=True), arrow, strict=True)],
            schema=arrow)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                where, path = file_system(row["path"])
                held, weight = [], 0
                with where.open_input_file(path) as file:
                    stop = min(row["start"] + split, row["length"])
                    for found in records_in(file, row["length"], row["start"], stop):
                        held.append(_row(row["path"], *found, payloads))
                        weight += len(held[-1][-1] or b"") + 500
                        if weight > 1 << 23:
                            yield batch(held)
                            held, weight = [], 0
                if held:
                    yield batch(held)

    return ranges.repartition(min(n, 100_000)).mapInArrow(read, RECORDS)


def gaps(files: DataFrame, records: DataFrame) -> DataFrame:
    """Per file: bytes, n_records, covered (sum of record lengths). covered differs from bytes where an
    archive holds anything that is no record, or a record inside another one."""
    held = records.groupBy("path").agg(F.count(F.lit(1)).alias("n_records"), F.sum("length").alias("covered"))
    return files.select("path", F.col("length").alias("bytes")).join(held, "path", "left").select(
        "path", "bytes", F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.coalesce("covered", F.lit(0)).alias("covered"))


def round_trip(pages: DataFrame, min_bytes: int = 0, split: int = 1 << 25) -> DataFrame:
    """Write ``pages`` as archives and list what reading them gives, one row per record."""
    kind = pages.schema["page_id"].dataType
    found = read_warc(write_warc(pages, min_bytes=min_bytes), split, payloads=False)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
