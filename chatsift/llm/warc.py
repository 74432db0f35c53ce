"""Operator 1: WARC archives, one gzip member per record, written and read in sequence.

A record's payload is its body in UTF-8 (null: empty). Of the records with equal
payloads of at least ``min_payload`` bytes, the one with the smallest id is the
response and the others revisit it; smaller payloads are always responses. Rows
that share the smallest id, and rows without an id, are responses. A null address
leaves the header out; further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.config import scratch_path
from chatsift.llm.common import new_file, partitions, read, staged, store

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
END = b"\r\n\r\n"

CHUNK = 1 << 20
RECORDS = "record_id string, record_type string, refers_to string, uri string, digest string, payload_bytes long"


def roles(pages: DataFrame, min_payload: int) -> DataFrame:
    """(id, digest, refers_to) of the revisits: ids and digests travel, payloads don't."""
    narrow = pages.where(F.length("payload") >= min_payload).select("id", "digest")
    heads = (
        narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    return narrow.join(heads, "digest").where("id > refers_to").distinct()


def record(uid, uri, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, not compressed yet."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d%s" % (len(payload), END)
    block = http + (payload if refers_to is None else b"")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if uid is None else uid}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", HTTP_TYPE),
        ("Content-Length", str(len(block))),
    ]
    if uri is not None:
        head.append(("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + END


def write_archives(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html",
    min_payload: int = 100, max_file_bytes: int = 256 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row below ``folder``; returns the manifest (path, records, bytes) of finished files.

    Every task writes files of its own under names of its attempt, so a repeated
    task leaves only files that no manifest names.
    """
    base = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(F.col(body_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    rows = base.join(roles(base, min_payload), ["id", "digest"], "left").select("id", "uri", "digest", "refers_to", "payload")

    def write(batches):
        out = path = None
        number = records = size = 0
        done = []
        for batch in batches:
            for i in range(batch.num_rows):
                uid, uri, digest, ref, payload = (c[i].as_py() for c in batch.columns)
                if out is None:
                    path = new_file(folder, "pages", ".warc.gz", number)
                    fs, place = store(path)
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    out, records, size, number = fs.open_output_stream(place, compression=None), 0, 0, number + 1
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(uid, uri, payload, digest, ref, date)) + z.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= max_file_bytes:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), map(list, zip(*done)))))

    return staged(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class Member:
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, stream, left: bytes):
        self.stream, self.raw, self.buffer = stream, left, b""
        self.inflate = zlib.decompressobj(31)

    def fill(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                raise ValueError("archive ends inside a member")
        self.buffer += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.buffer:
            if not self.fill():
                raise ValueError("record without its blank line")
        head, _, self.buffer = self.buffer.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.buffer and not self.fill():
                raise ValueError("record shorter than its Content-Length")
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_archive(path: str, payloads: bool = True) -> Iterator[tuple]:
    """(header fields, payload or None, payload digest, payload length) of each record, in file order.

    Block and payload digests are checked as the bytes stream by; a mismatch, a
    wrong length or a cut-off file raises ValueError. Without ``payloads`` a
    record of any size is read in pieces.
    """
    fs, place = store(path)
    with fs.open_input_stream(place, compression=None) as stream:
        left = stream.read(CHUNK)
        while left:
            m = Member(stream, left)
            head = m.until(END)
            if not head.startswith(b"WARC/"):
                raise ValueError(f"{path}: not a WARC record")
            f = fields(head)
            length = int(f["content-length"])
            block, body = hashlib.sha256(), hashlib.sha256()
            http, kept, size = b"", [], 0
            in_body = not f.get("content-type", "").startswith("application/http")
            for piece in m.take(length):
                block.update(piece)
                if not in_body:
                    http += piece
                    if END not in http:
                        continue
                    piece, in_body = http.partition(END)[2], True
                body.update(piece)
                size += len(piece)
                if payloads:
                    kept.append(piece)
            if b"".join(m.take(len(END))) != END or m.fill() and m.buffer:
                raise ValueError(f"{path}: more than one record in a member")
            if f.get("warc-block-digest", "sha256:" + block.hexdigest()) != "sha256:" + block.hexdigest():
                raise ValueError(f"{path}: block digest of {f.get('warc-record-id')} differs")
            said = f.get("warc-payload-digest", "").removeprefix("sha256:")
            if f["warc-type"] != "revisit" and said and said != body.hexdigest():
                raise ValueError(f"{path}: payload digest of {f.get('warc-record-id')} differs")
            yield f, b"".join(kept) if payloads else None, said or body.hexdigest(), size
            left = m.raw or stream.read(CHUNK)


def read_archives(paths: DataFrame) -> DataFrame:
    """Headers, digests and lengths of all records of the files named in column ``path``."""

    def scan(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for f, _, digest, size in read_archive(path, payloads=False):
                    uid = lambda k: f[k].strip("<>").removeprefix("urn:page:") if k in f else None  # noqa: B023, E731
                    rows.append((uid("warc-record-id"), f["warc-type"], uid("warc-refers-to"), f.get("warc-target-uri"),
                                 digest, None if f["warc-type"] == "revisit" else size))
                    if len(rows) >= 4096:
                        yield records(rows)
                        rows = []
                if rows:
                    yield records(rows)

    def records(rows):
        names = ["record_id", "record_type", "refers_to", "uri", "digest", "payload_bytes"]
        types = [pa.string()] * 5 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = partitions(paths.sparkSession)
    return paths.select("path").repartition(n).mapInArrow(scan, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Give each revisit the length of the response it refers to; the digests of both must agree."""
    records = staged(records, "warc-records")
    whole = (
        records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "digest")
        .agg(F.max("payload_bytes").alias("whole_bytes"))
    )
    return records.join(whole, ["refers_to", "digest"], "left").select(
        F.when(F.col("record_id") != "", F.col("record_id").cast("long")).alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.coalesce("whole_bytes", F.raise_error(F.lit("revisit without its response"))))
        .otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), "uri",
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, written and read back."""
    folder = scratch_path(spark, "warc")
    manifest = write_archives(read(spark, sf_dir, "pages"), folder)
    return resolved(read_archives(manifest)).drop("uri")


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), h AS (
  SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > head THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""
