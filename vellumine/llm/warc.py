"""WARC archives: a writer with revisit records, and a reader that splits gzip archives by byte ranges.

Writing goes through Spark's text sink, so archives land, with its commit protocol, on any store that
Spark can write: a binary row is written byte by byte with a one-byte separator behind it, and each
row is one gzip member without its last byte, zero, which the separator restores. (That byte is the top
of the member's length; members of 16 MiB and more are followed by an empty member, whose length is 0.)

Reading lists the files, cuts them into byte ranges and gives each range to one row of work. A task
looks for the gzip magic in its range, takes a candidate for a record only if its first bytes inflate
to a WARC version line, and reads every record that starts inside its range to its end, past the
range's if need be. No range depends on another, so lost tasks are simply run again.

A member that starts like a record but is cut off or does not inflate gives a row with its place and an
``error``, and the search goes on behind its start; ``archive_and_read`` raises that error.

Nulls as payload count as empty. A null page id orders after all others. Rows that repeat a page id
and payload are all ``response`` where their id is the smallest. Page ids of any type that casts to text
and back come back as they were. Empty tables give empty archives.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.store import cut, fresh_path, lookup_join, slices

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
EMPTY_MEMBER_FROM = 1 << 24
RANGE_BYTES = 32 << 20
BLOCK = 1 << 20
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100


# ---- writing ------------------------------------------------------------------------------------


def with_origins(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages as (page_id, url, payload, digest, refers_to): the smallest id with an equal payload, if another."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    slim = cut(rows.where(F.octet_length("payload") >= least).select("page_id", "digest"))
    total = slim.count()
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    traced = lookup_join(rows, firsts, ["digest"], "copies", total, F.coalesce(F.col("page_id").cast("string"), F.col("url")))
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return traced.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def urn(page_id) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One uncompressed WARC record: a response with its payload, or a revisit that names the response."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", urn(page_id)),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[4:4] = [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member that ends with a zero byte."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = squeeze.compress(data) + squeeze.flush()
    if out[-1]:
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += squeeze.compress(b"") + squeeze.flush()
    return out


def write(traced: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of the rows of ``with_origins``, one file a partition, a member a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                columns = [rows.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to")]
                members = [member(record(*(v.as_py() for v in row), date))[:-1] for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    stored = traced.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    stored.write.option("lineSep", "\x00").option("compression", "none").text(path)


# ---- reading ------------------------------------------------------------------------------------


def open_file(path: str):
    """A seekable file: local or shared folders directly, other stores through Arrow's file systems."""
    if path.startswith("file:"):
        return open(path[5:].replace("///", "/", 1) if path.startswith("file:///") else path[5:], "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class Window_:
    """Reads ahead in blocks from a position; bytes before ``drop`` are let go."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, b""
        file.seek(at)

    def grow(self) -> bool:
        more = self.file.read(BLOCK)
        self.data += more
        return bool(more)

    def drop(self, at: int) -> None:
        if at > self.base:
            self.data = self.data[at - self.base :]
            self.base = at


def starts_record(view: Window_, at: int) -> bool:
    """Whether the member at ``at`` inflates to the start of a WARC record."""
    while True:
        inflate = zlib.decompressobj(31)
        try:
            head = inflate.decompress(view.data[at - view.base : at - view.base + 4096], 64)
        except zlib.error:
            return False
        if len(head) >= len(VERSION) or inflate.eof:
            return head.startswith(VERSION)
        if len(view.data) - (at - view.base) >= 4096 or not view.grow():
            return False


def records(file, start: int, end: int) -> Iterator[tuple[int, bytes | str]]:
    """(offset, uncompressed record) of each record whose member starts in [start, end); for a damaged one, what is wrong."""
    view = Window_(file, start)
    at = start
    while at < end:
        found = view.data.find(MAGIC, at - view.base)
        if found < 0:
            at = max(at, view.base + len(view.data) - len(MAGIC) + 1)
            view.drop(at)
            if at >= end or not view.grow():
                return
            continue
        at = view.base + found
        if at >= end:
            return
        view.drop(at)
        if not starts_record(view, at):
            at += 1
            continue
        inflate, out, used = zlib.decompressobj(31), [], 0
        try:
            while not inflate.eof:
                if used == len(view.data) and not view.grow():
                    raise EOFError("the last record is cut off")
                out.append(inflate.decompress(view.data[used:]))
                used = len(view.data) - len(inflate.unused_data)
        except (zlib.error, EOFError) as damage:
            yield at, f"damaged record: {damage}"
            at += 1
            continue
        yield at, b"".join(out)
        at += used
        view.drop(at)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower case) of a record, and the payload of its HTTP block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields.get("content-type", "").startswith("application/http"):
        lines = dict(line.split(b":", 1) for line in http.split(b"\r\n")[1:] if b":" in line)
        fields["http-length"] = next((v.strip().decode() for k, v in lines.items() if k.lower() == b"content-length"), str(len(payload)))
        return fields, payload
    return fields, block


SCHEMA = "file string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def read(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES, opener: Callable = open_file) -> DataFrame:
    """One row a record of all archives under ``path``, however many ranges a file is cut into."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.select("path", F.explode(starts).alias("start")).withColumn("end", F.col("start") + range_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, held = [], 0
                with opener(name) as file:
                    for offset, data in records(file, start, end):
                        if isinstance(data, str):
                            rows.append((name, offset, *[None] * 7, data))
                            continue
                        fields, payload = parse(data)
                        revisit = fields.get("warc-type") == "revisit"
                        rows.append((name, offset, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), int(fields.get("http-length", len(payload))) if revisit else len(payload), None if revisit else payload, None))
                        held += len(payload)
                        if held > BLOCK * 8 or len(rows) == 5000:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return ranges.repartition(F.col("path"), F.col("start")).mapInArrow(run, SCHEMA)


def page_key(uri: Column, kind) -> Column:
    """The page id that ``urn`` wrote, as it was."""
    return F.when(uri.startswith("<urn:page:"), F.url_decode(F.regexp_extract(uri, "^<urn:page:(.*)>$", 1)).try_cast(kind))


def archive_and_read(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages to archives in the shared folder and returns what reading them gives, a row a page."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(with_origins(pages, id_col, url_col, html_col), path)
    found = read(spark, path)
    revisit = F.col("record_type") == "revisit"
    kind, broken = pages.schema[id_col].dataType, F.col("error").isNotNull()
    digest = F.when(broken, F.raise_error(F.col("error"))).when(revisit, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256))
    return found.select(page_key(F.col("record_id"), kind).alias(id_col), "payload_bytes", digest.alias("payload_digest"), "record_type", page_key(F.col("refers_to"), kind).alias("refers_to"))
