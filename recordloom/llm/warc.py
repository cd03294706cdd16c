"""WARC archives: monolithic gzip files rewritten as one gzip member per record, with a sidecar offset index.

write_archives() puts pages into WARC files, each a single gzip stream. normalise() inflates such a stream once from its
start, with one record in memory at a time, and writes every record as a member of its own beside an index of members'
offsets; records whose payload another record holds become revisits meanwhile. read_archives() fetches members by their
index. Files lie in the shared folder; a task writes under its own attempt's name, so a task that runs again harms nothing.

Defined results: null html is an empty payload; of equal payloads of at least MIN_REVISIT bytes the largest page_id is the
response (all rows that repeat that page_id are), rows without a page_id are responses; null urls have no target; record
ids hold a row's place beside its page_id, so rows that repeat have ids of their own; payloads of any length are written
whole; an empty table makes no archive; other columns are ignored. The shared folder must be of a scheme that Arrow opens
(file, hdfs, s3 and s3a, gs, abfs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, table, tuned

MIN_REVISIT = 1000
#: Inflated bytes after which a task begins its next archive.
ROLL = 256 << 20
READ = 1 << 18
#: Hadoop's names of stores that Arrow knows under another.
ALIASES = {"s3a": "s3", "s3n": "s3", "o3fs": "hdfs"}
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "archive string, ordinal long, serial string, page_id long, payload_bytes long, payload_digest string"
NORMAL = "archive string, sidecar string, records long"
READ_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _fs(uri: str):
    from pyarrow import fs

    scheme, sign, rest = uri.partition("://")
    return fs.FileSystem.from_uri(ALIASES.get(scheme, scheme) + sign + rest)


def _open(uri: str):
    fs, path = _fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def record(kind: str, page: int | None, serial: str, url: str | None, digest: str, size: int, payload: bytes = b"", refers_to: str | None = None) -> bytes:
    """A WARC record of an HTTP response, or of its revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page is None else page}:{serial}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%-._"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, and the payload behind the HTTP header."""
    head, _, block = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def records(stream) -> Iterator[bytes]:
    """Records of a gzip stream, inflated once from its start; members that follow are read on."""
    inflate, buffer = zlib.decompressobj(31), bytearray()
    while block := stream.read(READ):
        while block:
            buffer += inflate.decompress(block)
            block = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            while (end := buffer.find(b"\r\n\r\n")) >= 0:
                at = buffer.find(b"\r\nContent-Length: ", 0, end)
                size = end + 4 + int(buffer[at + 18 : (stop := buffer.find(b"\r\n", at + 2))]) + 4
                assert stop <= end
                if len(buffer) < size:
                    break
                yield bytes(buffer[:size])
                del buffer[:size]
    if buffer:
        raise ValueError("the archive ends inside a record")


def write_archives(pages: DataFrame, where: str, roll: int = ROLL) -> DataFrame:
    """Pages as response records in monolithic gzip archives under where: a row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, name, squeeze, size, ordinal, files = None, "", None, 0, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{where}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz"
                    out, squeeze, size, ordinal, files = _open(name), zlib.compressobj(1, wbits=31), 0, 0, files + 1
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                serial = f"{task.partitionId()}-{files}-{ordinal}"
                raw = record("response", page, serial, url, digest, len(payload), payload)
                out.write(squeeze.compress(raw))
                rows.append((name, ordinal, serial, page, len(payload), digest))
                size, ordinal = size + len(raw), ordinal + 1
                if size >= roll:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pylist([dict(zip(("archive", "ordinal", "serial", "page_id", "payload_bytes", "payload_digest"), r, strict=True)) for r in rows], schema=pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("serial", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))
        if out is not None:
            out.write(squeeze.flush())
            out.close()

    return cut(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, WRITTEN), "written")


def revisits(written: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(archive, ordinal, refers_to) of records whose payload a record of a larger page_id holds; refers_to ends that record's id."""
    big = written.where(F.col("payload_bytes") >= least)
    heads = big.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "serial")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    return big.join(heads, ["payload_digest", "payload_bytes"]).where("page_id < head.page_id").select("archive", "ordinal", F.concat_ws(":", F.col("head.page_id").cast("string"), "head.serial").alias("refers_to"))


def normalise(archives: DataFrame, where: str) -> DataFrame:
    """archives (archive, turned: array of (ordinal, refers_to)) rewritten under where: a row for each archive."""

    def one(archive: str, turned: dict[int, str]) -> tuple[str, str, int]:
        task = TaskContext.get()
        name = f"{where}/{archive.rpartition('/')[2].removesuffix('.warc.gz')}-{task.taskAttemptId()}.warc.gz"
        sidecar, at, n = name.removesuffix(".warc.gz") + ".index.jsonl", 0, 0
        fs, path = _fs(archive)
        with fs.open_input_stream(path, compression=None) as source, _open(name) as out, _open(sidecar) as index:
            for n, raw in enumerate(records(source), 1):
                headers, _ = head = parse(raw) if n - 1 in turned else ({}, b"")
                if head[0]:
                    page, _, serial = headers["WARC-Record-ID"][len("<urn:page:") : -1].partition(":")
                    digest = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                    raw = record("revisit", int(page), serial, headers.get("WARC-Target-URI"), digest, int(headers["Payload-Length"]), refers_to=turned[n - 1])
                squeeze = zlib.compressobj(6, wbits=31)
                member = squeeze.compress(raw) + squeeze.flush()
                out.write(member)
                index.write(json.dumps({"offset": at, "length": len(member)}).encode() + b"\n")
                at += len(member)
        return name, sidecar, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = one(row["archive"], {x["ordinal"]: x["refers_to"] for x in row["turned"] or ()})
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], names=["archive", "sidecar", "records"])

    return cut(archives.select("archive", "turned").mapInArrow(run, NORMAL), "normal")


def read_archives(normal: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of normalised archives, fetched by their index; digests and sizes of responses are taken from what is read."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows(archive: str, sidecar: str) -> Iterator[tuple]:
        fs, path = _fs(archive)
        with fs.open_input_file(path) as source, fs.open_input_stream(_fs(sidecar)[1], compression=None) as index:
            for line in index.read().splitlines():
                member = json.loads(line)
                headers, payload = parse(zlib.decompress(source.read_at(member["length"], member["offset"]), 31))
                page, refers = (headers.get(x, "")[len("<urn:page:") : -1].partition(":")[0] for x in ("WARC-Record-ID", "WARC-Refers-To"))
                kind = headers["WARC-Type"]
                digest = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                size = int(headers["Payload-Length"])
                if kind == "response" and (size, digest) != (len(payload), hashlib.sha1(payload).hexdigest()):
                    raise ValueError(f"{archive}: the payload at {member['offset']} differs from its record")
                yield (None if page == "none" else int(page)), size, digest, kind, int(refers) if refers else None, headers.get("WARC-Target-URI"), payload if payloads and kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held: list[tuple] = []
                size = 0
                for x in rows(row["archive"], row["sidecar"]):
                    held.append(x)
                    size += len(x[-1] or b"")
                    if len(held) >= 4096 or size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return normal.select("archive", "sidecar").mapInArrow(run, READ_BACK)


def archive_pages(pages: DataFrame, where: str | None = None, payloads: bool = False) -> DataFrame:
    """Pages written, normalised and read back; archives stay under where."""
    spark = tuned(pages.sparkSession)
    where = where or fresh_path(spark, "warc")
    written = write_archives(pages, f"{where}/raw")
    files = written.groupBy("archive").agg(F.count("*").alias("n"))
    turned = revisits(written).groupBy("archive").agg(F.collect_list(F.struct("ordinal", "refers_to")).alias("turned"))  # at most an archive's records
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    normal = normalise(files.join(turned, "archive", "left").repartition(parts), f"{where}/normal")
    return read_archives(normal.repartition(parts), payloads)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS head FROM s WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, s.payload_digest, CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < head THEN head END AS refers_to
FROM s LEFT JOIN m ON s.payload_digest = m.payload_digest AND payload_bytes >= 1000
"""
