"""WARC archives through a chunked record table.

Outside an archive a record is rows (record, chunk number, data): no one ever holds more of a
payload than a chunk. Writers stream chunk rows into gzip members, readers stream them out
again, and digests go along: a row to be written has its chunk's CRC-32 and the payload's length
up to its end, which the writer checks as it goes, with the whole payload's SHA-256 at the end; a
row that was read has the CRC-32 and the length of the payload up to its end, the last one also
its SHA-256.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, materialize, scratch_path

CHUNK = 1 << 20
#: Payloads from this size on are written once; equal ones revisit the first.
REVISIT_FROM = 100
#: Rows and bytes of a batch that a reader hands on.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
VERSION = b"WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("sha256", pa.string())])
CHUNKS_DDL = "record_id string, record_type string, target_uri string, refers_to string, chunk_no int, last boolean, data binary, bytes long, crc32 long, sha256 string"


def opened(uri: str):
    """(file system, path) of a file: or object-store address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, size, digest, payload): the records that pages become.

    The payload is the text in UTF-8, a null one is empty. Of equal payloads of at least
    revisit_from bytes the row with the smallest id is the response and the others revisit it;
    of rows with that same id one is (null ids come last). Sizes, digests and row numbers are
    written once beside the payload, so that both readings of them agree; only digests and ids
    are grouped. A payload moves only if there are too many repeated digests to broadcast, and
    then a frequent digest's rows can be split among tasks, as both sides of the join are scans.
    """
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("n", F.monotonically_increasing_id()).withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    own = Table(own, "payloads", "zstd").df
    at = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), F.col("n"))
    firsts = own.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("c")).where("c > 1")
    name = lambda null, i, n: F.concat(F.lit("urn:page:"), F.when(null, "null").otherwise(i.cast("string")), F.lit(":"), n.cast("string"))
    firsts = firsts.select(F.col("digest").alias("digest_"), "first", name(F.col("first.none"), F.col("first.id"), F.col("first.n")).alias("first_id"))
    firsts = materialize(firsts, "firsts")
    joined = own.join(firsts, (F.col("digest") == F.col("digest_")) & (F.col("size") >= revisit_from), "left")
    again = F.coalesce(F.col("first.n") != F.col("n"), F.lit(False))
    return joined.select(
        name(F.col("id").isNull(), F.col("id"), F.col("n")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, F.col("first_id")).alias("refers_to"),
        "size",
        "digest",
        "payload",
    )


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """records as chunk rows, in order; a revisit and an empty payload have one empty chunk."""
    sent = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("size"))
    last = F.greatest(F.ceil(sent / chunk) - 1, F.lit(0))
    numbered = rows.withColumn("sent", sent).select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk_no", "k"))
    data = F.when(F.col("sent") > 0, F.substring("payload", (F.col("k") * chunk + 1).cast("int"), F.lit(chunk))).otherwise(F.unhex(F.lit("")))
    numbered = numbered.select("record_id", "record_type", "target_uri", "refers_to", "size", "digest", "chunk_no", data.alias("data"), F.least(F.col("sent"), (F.col("k") + 1) * chunk).cast("long").alias("bytes"))
    return numbered.withColumn("crc32", F.crc32("data"))


def header(row: dict, date: str) -> bytes:
    """Header block of a record, with the HTTP header that a response's payload follows."""
    response = row["record_type"] == "response"
    http = HTTP.format(row["size"]) if response else ""
    lines = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['target_uri'], safe=_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha256:{row['digest']}")
    if not response:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (row['size'] if response else 0)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + http.encode()


#: Percent and what can't stand in a header line are written as percent codes, all else as it is.
_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def write_warc(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Streams chunk rows into folder, a gzip member for each record; returns (file, records, bytes), the archive's manifest.

    A task writes a file of its own name for each attempt and the manifest, written by Spark's
    committer, says which attempt counts: a lost executor or a second attempt leaves a file
    that no one reads. A record whose chunks don't add up to its size or digest raises.
    """

    def run(batches):
        context = TaskContext.get()
        uri = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        files, path = opened(uri)
        out, count, open_ = None, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                if row["chunk_no"] == 0:
                    if open_ is not None:
                        out.write(_closed(*open_))
                    open_ = (zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha256(), row, [0])
                    out.write(open_[0].compress(header(row, date)))
                    count += 1
                pack, sha, _, size = open_
                out.write(pack.compress(row["data"]))
                sha.update(row["data"])
                size[0] += len(row["data"])
                if size[0] != row["bytes"] or zlib.crc32(row["data"]) != row["crc32"]:
                    raise ValueError(f"{row['record_id']}: chunk {row['chunk_no']} isn't the one that was cut")
        if out is not None:
            out.write(_closed(*open_))
            bytes_ = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "records": [count], "bytes": [bytes_]})

    return materialize(chunks.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def _closed(pack, sha, row, size) -> bytes:
    if row["record_type"] == "response" and (size[0] != row["size"] or sha.hexdigest() != row["digest"]):
        raise ValueError(f"{row['record_id']}: its chunks aren't its payload")
    return pack.compress(b"\r\n\r\n") + pack.flush()


def parse(stream, chunk: int = CHUNK):
    """Chunk rows, as tuples in the order of CHUNKS, of an uncompressed archive stream."""
    while line := stream.readline():
        if line != VERSION:
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        left = int(fields["content-length"])
        type_, digest = fields["warc-type"], fields.get("warc-payload-digest", "").rpartition(":")[2]
        if type_ == "response":
            while True:
                line = stream.readline()
                left -= len(line)
                if line in (b"\r\n", b""):
                    break
        uri = fields.get("warc-target-uri")
        head = (fields["warc-record-id"].strip("<>"), type_, unquote(uri) if uri is not None else None, (fields.get("warc-refers-to") or "").strip("<>") or None)
        sha, crc, size, number = hashlib.sha256(), 0, 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError(f"{head[0]}: the archive ends in its payload")
            left -= len(data)
            sha.update(data)
            crc, size = zlib.crc32(data, crc), size + len(data)
            if not left and type_ == "response" and digest and sha.hexdigest() != digest:
                raise ValueError(f"{head[0]}: the payload isn't the one of its digest")
            yield (*head, number, not left, data, size, crc, (digest if type_ == "revisit" else sha.hexdigest()) if not left else None)
            number += 1
            if not left:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{head[0]}: no end of record")


def read_warc(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of the manifest's archives; a revisit's one row has its header's digest and no bytes."""

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = opened(uri)
                with files.open_input_stream(path, compression=None, buffer_size=1 << 18) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in parse(stream, chunk):
                        rows.append(row)
                        held += len(row[6])
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CHUNKS.types, strict=True)], schema=CHUNKS)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CHUNKS.types, strict=True)], schema=CHUNKS)

    files = manifest.select("file")
    return files.repartition(max(1, files.count())).mapInArrow(run, CHUNKS_DDL)


def archive(pages: DataFrame, folder: str | None = None, **named) -> DataFrame:
    """Writes pages as WARC archives into folder (a new one in the shared folder if none is given); returns the manifest."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return write_warc(chunked(records(pages, **named)), folder)


def page_id(record_id) -> F.Column:
    return F.regexp_extract(record_id, r"^urn:page:(-?[0-9]+|null):", 1).try_cast("long")


def contents(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record read back. An empty table gives no rows.

    A revisit's length and digest are its response's as read; both are of full payloads.
    """
    heads = read_warc(manifest).where("last").select("record_id", "record_type", "refers_to", "bytes", "sha256")
    heads = materialize(heads, "heads")
    first = heads.where("record_type = 'response'").select(F.col("record_id").alias("first_id"), F.col("bytes").alias("first_bytes"), F.col("sha256").alias("first_sha256"))
    both = heads.join(first, F.col("refers_to") == F.col("first_id"), "left")
    again = F.col("record_type") == "revisit"
    return both.select(
        page_id(F.col("record_id")).alias("page_id"),
        F.when(again, F.col("first_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(again, F.col("first_sha256")).otherwise(F.col("sha256")).alias("payload_digest"),
        "record_type",
        page_id(F.col("refers_to")).alias("refers_to"),
    )


def warc_sql() -> str:
    """What the query returns, in DuckDB SQL."""
    return f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_FROM} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN first <> page_id THEN first END AS refers_to FROM f
    """
