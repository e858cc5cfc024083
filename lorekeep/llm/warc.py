"""WARC archives: pages written as records, one gzip member each, and a sequential reader that checks what it reads.

Archives are a data source of their own (`warc`), so both directions are ordinary DataFrame reads and writes: tasks write archives that roll at a size, the commit writes the list of those that
count, a failed attempt's files are in no list, and each archive is one partition of the read.

The reader inflates a piece at a time, finds a record's block by its Content-Length, hashes the block and the payload (what follows the HTTP header) as they pass, and compares both with the digests that the
record states. A record that fails is a row with a `fault`, and reading goes on with the next member. Memory is a few pieces and, where payloads are asked for, one record.

Pages: the payload is the text in UTF-8; null is empty. Of equal payloads of at least `least` bytes the one with the smallest id is a response and the others revisit it, smaller ones are all responses. Rows without an id count
after those with one and have no id to be referred to by: where all copies lack it, all are responses. Repeated rows of the smallest id are all responses. Null addresses are empty; control characters, spaces and % in an
address are written as %XX and read back. An empty table gives an archive folder without records. Extra columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import cut, shared_dir, table

#: Bytes read, and bytes inflated, at a time.
PIECE = 1 << 20
#: An archive ends with the record that takes it over this size.
ROLL = 1 << 28
LIST = "_archives.json"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "record_id string, record_type string, uri string, date string, refers_to string, payload_bytes long, payload_digest string, payload binary"
READ = f"{WRITTEN}, fault string"
EMPTY = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("fault", pa.string())])


def folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


def escape(uri: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", uri)


def member(record: dict) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, which states the payload's length, and no payload."""
    payload = record["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record['payload_bytes']}\r\n\r\n".encode()
    block = http if record["record_type"] == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record['record_type']}", f"WARC-Record-ID: <{record['record_id']}>", f"WARC-Date: {record['date']}", f"WARC-Target-URI: {escape(record['uri'] or '')}"]
    if record["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{record['refers_to']}>"]
    head += [f"WARC-Payload-Digest: sha256:{record['payload_digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Members:
    """The members of a gzip stream, inflated a piece at a time."""

    def __init__(self, raw, piece: int = PIECE):
        self.raw, self.piece, self.rest = raw, piece, b""

    def open(self) -> bool:
        """Starts the next member; False at the end of the stream."""
        self.rest = self.rest or self.raw.read(self.piece)
        self.z, self.first = zlib.decompressobj(31), True
        return bool(self.rest)

    def read(self) -> bytes:
        """Some bytes of the member, none at its end."""
        while not self.z.eof:
            data = self.rest or self.raw.read(self.piece)
            if not data:
                raise EOFError("archive ends inside a member")
            self.rest = data  # where a fault is found, skip() looks on from here
            out = self.z.decompress(data, self.piece)
            self.rest, self.first = self.z.unused_data if self.z.eof else self.z.unconsumed_tail, False
            if out:
                return out
        return b""

    def skip(self) -> None:
        """After a fault: to the end of the member where it can be inflated, else on to what looks like the start of one."""
        try:
            while self.read():
                pass
            return
        except (EOFError, zlib.error):
            at = int(self.first)
        while True:
            at = self.rest.find(b"\x1f\x8b\x08", at)
            if at >= 0:
                self.rest = self.rest[at:]
                return
            more = self.raw.read(self.piece)
            if not more:
                self.rest = b""
                return
            self.rest, at = self.rest[-2:] + more, 0


class Feed:
    """Takes exact numbers of bytes out of a member."""

    def __init__(self, members: Members):
        self.members, self.held = members, b""

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            more = self.members.read()
            if not more:
                raise ValueError("header without end")
            self.held += more
        out, self.held = self.held[:found], self.held[found + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            self.held = self.held or self.members.read()
            if not self.held:
                raise ValueError("block shorter than its Content-Length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def done(self) -> bool:
        self.held = self.held or self.members.read()
        return not self.held


def fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields of a header, names in lower case; lines that start with white space go on with the one before."""
    first, *lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\n")
    return first.strip(), {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


class Check:
    """Compares bytes with a stated digest, in hex or base32."""

    def __init__(self, stated: str | None):
        name, _, self.value = (stated or "").partition(":")
        name = name.lower().replace("-", "")
        self.hash = hashlib.new(name) if self.value and name in hashlib.algorithms_guaranteed and not name.startswith("shake") else None

    def update(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def fails(self) -> bool:
        return bool(self.hash) and self.value.lower() != self.hash.hexdigest() and self.value.upper().rstrip("=") != base64.b32encode(self.hash.digest()).decode().rstrip("=")


def read_record(feed: Feed, keep: bool) -> dict:
    version, head = fields(feed.until(b"\r\n\r\n"))
    if not version.startswith("WARC/"):
        raise ValueError("no WARC header")
    if not head.get("content-length", "").isdecimal():
        raise ValueError("no Content-Length")
    kind, stated = head.get("warc-type"), head.get("warc-payload-digest")
    http = head.get("content-type", "").lower().startswith("application/http")
    block, payload, own = Check(head.get("warc-block-digest")), Check(None if kind == "revisit" else stated), hashlib.sha256()
    start, length, kept = b"" if http else None, 0, []
    for data in feed.take(int(head["content-length"])):
        block.update(data)
        if start is not None:  # still inside the HTTP header
            start += data
            at = start.find(b"\r\n\r\n")
            if at < 0:
                continue
            start, data, http_head = None, start[at + 4 :], start[:at]
            length_stated = fields(http_head)[1].get("content-length", "")
        length += len(data)
        own.update(data)
        payload.update(data)
        if keep:
            kept.append(data)
    if b"".join(feed.take(4)) != b"\r\n\r\n":
        raise ValueError("record runs on after its block")
    digest = own.hexdigest()
    if kind == "revisit":  # the payload is elsewhere: its length and digest are what the record states
        digest = stated.partition(":")[2] if stated else None
        length = int(length_stated) if http and start is None and length_stated.isdecimal() else None
    fault = "block digest differs" if block.fails() else "payload digest differs" if payload.fails() else None
    bare = lambda x: x and x.strip("<>")
    return {
        "record_id": bare(head.get("warc-record-id")), "record_type": kind, "uri": head.get("warc-target-uri") and unquote(head["warc-target-uri"]), "date": head.get("warc-date"), "refers_to": bare(head.get("warc-refers-to")),
        "payload_bytes": length, "payload_digest": digest, "payload": b"".join(kept) if keep and kind != "revisit" else None, "fault": fault,
    }


def read_archive(raw, keep: bool = True, piece: int = PIECE) -> Iterator[dict]:
    """All records of one archive in order. A broken member gives one row that holds only its fault."""
    members = Members(raw, piece)
    while members.open():
        try:
            feed = Feed(members)
            while not feed.done():
                yield read_record(feed, keep)
        except (ValueError, EOFError, zlib.error) as e:
            yield dict.fromkeys(EMPTY.names) | {"fault": str(e)}
            members.skip()


@dataclass
class Archive(InputPartition, WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.keep = options["path"], options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[Archive]:
        fs, root = folder(self.path)
        found = [f.path for f in fs.get_file_info(pa.fs.FileSelector(root))]
        if f"{root}/{LIST}" in found:
            with fs.open_input_stream(f"{root}/{LIST}") as f:
                return [Archive([name]) for name in json.loads(f.read())]
        return [Archive([p.rsplit("/", 1)[1]]) for p in sorted(found) if p.endswith(".warc.gz")]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        fs, root = folder(self.path)
        for name in partition.names:
            with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                held, size = [], 0
                for record in read_archive(raw, self.keep):
                    held.append(record)
                    size += len(record["payload"] or b"") + 500
                    if size > PIECE:
                        yield pa.RecordBatch.from_pylist(held, EMPTY)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, EMPTY)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.roll = options["path"], int(options.get("roll", ROLL))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        fs, root = folder(self.path)
        fs.create_dir(root, recursive=True)
        names, out = [], None
        try:
            for batch in iterator:
                for i in range(batch.num_rows):  # a record at a time, so that payloads are not held twice
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    data = member({k: batch.column(k)[i].as_py() for k in batch.schema.names})
                    out.write(data)
                    size += len(data)
                    if size >= self.roll:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Archive(names)

    def commit(self, messages: list[Archive | None]) -> None:
        fs, root = folder(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{LIST}") as f:
            f.write(json.dumps([name for m in messages if m for name in m.names]).encode())

    def abort(self, messages: list[Archive | None]) -> None:
        fs, root = folder(self.path)
        for name in (name for m in messages if m for name in m.names):
            fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """`spark.read.format("warc")` and `df.write.format("warc")`; options: payload ("false": leave payloads out), roll (bytes of an archive)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def records(pages: DataFrame, date: str, least: int = 100) -> DataFrame:
    """The rows to write (WRITTEN) of a table of pages (page_id, url, html).

    Who repeats whom is an aggregate of digests; only digests that occur twice or more are kept, and where they are few the planner broadcasts them by the size of their table. Digests of more than
    a thousandth of all copies (a thousand at most, hence broadcast) go another way than the rest, so that no key of the join is large."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    copies = cut(p.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null"), "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    often = copies.where(F.col("n") * 1000 > total)
    hot, rest = often.select("payload_digest", "first"), copies.where(F.col("n") * 1000 <= total).select("payload_digest", "first")
    out = p.join(rest, "payload_digest", "left") if not total else p.join(F.broadcast(hot), "payload_digest", "left_anti").join(rest, "payload_digest", "left").unionByName(p.join(F.broadcast(hot), "payload_digest"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return out.select(
        urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "uri", F.lit(date).alias("date"), F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload_bytes", "payload_digest", F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", roll: int = ROLL) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    records(pages, date).write.format("warc").option("roll", str(roll)).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    got = read_archives(spark, path, payload=False)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    whole = F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault"))).otherwise(F.col("payload_digest"))
    return got.select(number("record_id").alias("page_id"), "payload_bytes", whole.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
