"""WARC archives with revisit resolution.

Headers (id, digest, length) are shuffled by payload digest to find each
payload's original response, decisions are joined back by page id, and one
gzip member per record is written to archives in the shared folder. Reading
parses those archives by Content-Length and resolves revisits from fresh
headers.

Defined results: null html is an empty payload; of equal payloads the rows with
the smallest page id are responses (several if that id is repeated), all others
revisits; a null page id never is the original unless no other exists; an empty
table gives no archives and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickflow.llm.common import materialise, scratch_uri, ship

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, without leaving the JVM."""
    digest = F.sha1(payload)
    chars = []
    for k in range(4):  # 40 bits make 8 characters
        v = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")
        chars += [F.substring(F.lit(BASE32), (F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*chars)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers (page_id, payload_digest, payload_bytes) with record_type and refers_to.

    The minimum per digest is pre-aggregated before the shuffle; only digests
    with several ids are joined back, as a sort-merge join that AQE can split,
    since one payload may hold a third of all rows.
    """
    key = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("id"))
    first = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(key).alias("m"), F.count(F.lit(1)).alias("c"))
    first = first.filter("c > 1").select("payload_digest", F.col("m.id").alias("first_id"))
    met = headers.join(first, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= min_bytes)
    return met.select("page_id", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("first_id")).alias("refers_to"))


def _http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member, its length and digest made for this block."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _info(name: str, date: str) -> bytes:
    block = b"software: wickflow\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """A response with its HTTP message, or a revisit with the message's head alone."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", date),
              ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    block = _http_head(len(payload))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'null' if refers_to is None else refers_to}>"),
                   ("WARC-Refers-To-Date", date)]
    else:
        block += payload
    return _member(fields, block)


def _writer(uri: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(uri)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        out = tmp = None
        n = 0
        # Rows come sorted by id, so a retried task writes the same bytes under the same name.
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to"))):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    tmp = f"{root}/_{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp, compression=None)
                    out.write(_info(name, date))
                out.write(_record(*row, date))
                n += 1
        if out is not None:
            out.close()
            fs.move(tmp, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return write


def parse_archive(stream, chunk: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive of gzip members, read from a file object in chunks.

    Held are one record and one chunk, so the time is in proportion to the archive's length.
    """
    data = stream.read(chunk)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpack.decompress(data))
            if unpack.eof:
                data = unpack.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the archive ends within a record")
        record = b"".join(parts)
        end = record.index(b"\r\n\r\n")
        lines = record[:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = end + 4
        yield head, record[start:start + int(head["Content-Length"])]


def payload_of(block: bytes) -> tuple[int, bytes]:
    """(payload length by its HTTP head, payload) of a response's or revisit's block."""
    end = block.index(b"\r\n\r\n") + 4
    fields = dict(x.split(": ", 1) for x in block[:end - 4].decode().split("\r\n")[1:])
    return int(fields["Content-Length"]), block[end:]


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def _reader(uri: str, with_payload: bool):
    names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{os.path.basename(path)}", compression=None) as stream:
                    for head, block in parse_archive(stream):
                        kind, digest = head["WARC-Type"], head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                        if kind not in ("response", "revisit"):
                            continue
                        size, payload = payload_of(block)
                        if kind == "response":
                            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if own != digest or size != len(payload):
                                raise ValueError(f"payload of {head['WARC-Record-ID']} has digest {own} and {len(payload)} bytes, its headers say {digest} and {size}")
                        rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, size, digest,
                                     _page(head["WARC-Refers-To"]) if kind == "revisit" else None, payload if with_payload and kind == "response" else None))
                        held += len(block)
                        if len(rows) >= 4096 or with_payload and held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return read


def write_archives(pages: DataFrame, uri: str | None = None, min_bytes: int = 0) -> str:
    """Write deduplicated archives of ``pages`` (page_id, url, html); returns their folder.

    Each archive begins with a warcinfo record; the date of all records is that
    of the write, taken once, so that a retried task writes the same bytes.
    """
    spark = pages.sparkSession
    ship(spark)
    uri = uri or scratch_uri(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    heads = materialise(rows.select("page_id", base32_sha1(F.col("payload")).alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes")), "warc-headers")
    decided = materialise(resolve(heads, min_bytes), "warc-decisions")
    keyed = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    fates = decided.groupBy("page_id", "payload_digest").agg(F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"))
    ready = keyed.join(fates.withColumnRenamed("page_id", "f_id").withColumnRenamed("payload_digest", "f_digest"),
                       F.col("page_id").eqNullSafe(F.col("f_id")) & (F.col("payload_digest") == F.col("f_digest")))
    # The join's own partitions become archives: pages move once at most, and AQE sizes the partitions.
    ready = ready.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    done = ready.sortWithinPartitions("page_id", "payload_digest", "url").mapInArrow(_writer(uri, date), "file string, records long")
    materialise(done, "warc-manifest").count()
    return uri


def read_archives(spark: SparkSession, uri: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives in ``uri``; revisits carry their original's id.

    Only paths are planned by Spark: each task streams its archives from the
    shared folder, so no archive is ever held whole.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema(
        "path string, modificationTime timestamp, length long, content binary").load(uri)
    return files.select("path").mapInArrow(_reader(uri, with_payload), RECORD_SCHEMA)


def resolved_payloads(records: DataFrame) -> DataFrame:
    """(page_id, payload) of every record, each revisit's payload taken from its original response.

    Records repeat as they do in ``records``; a revisit whose original is missing
    has a null payload; an empty input gives an empty output.
    """
    originals = records.filter("record_type = 'response'").select(F.col("page_id").alias("o_id"), F.col("payload").alias("o_payload")).dropDuplicates(["o_id"])
    met = records.join(originals, F.col("refers_to") == F.col("o_id"), "left")
    return met.select("page_id", F.when(F.col("record_type") == "revisit", F.col("o_payload")).otherwise(F.col("payload")).alias("payload"))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    if pages.limit(1).count() == 0:
        records = spark.createDataFrame([], RECORD_SCHEMA)
    else:
        records = read_archives(spark, write_archives(pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_sql() -> str:
    """The same result for DuckDB over ``pages``."""
    chars = " || ".join(f"substr('{BASE32}', CAST(((v{k} >> {35 - 5 * i}) & 31) + 1 AS BIGINT), 1)" for k in range(4) for i in range(8))
    parts = ", ".join(f"CAST('0x' || substr(sha1(html), {10 * k + 1}, 10) AS BIGINT) AS v{k}" for k in range(4))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {parts} FROM p),
d AS (SELECT page_id, payload_bytes, {chars} AS payload_digest FROM h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
