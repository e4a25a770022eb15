"""Deterministic sharded WARC writer and reader.

Records are sorted by page id and cut into shards of about ``shard_bytes`` payload bytes: the cuts come from an exact
prefix sum over the sorted ids, so they do not depend on sampling or on the order of the input. One task writes a
shard's records, each as its own gzip member with regenerated headers and digests, and starts a new file when the
compressed size reaches ``file_bytes``. A file is written under a temporary name and renamed when it is whole; what a
repeated task writes is byte for byte the same. The manifest is written last and makes the archive valid; readers open
only the files it lists.

Of records with equal payloads the one with the largest page id is the response, the others are revisits that refer to it;
payloads under ``least`` bytes are all responses. A null payload is empty. Repeated rows of the response's id are revisits
of it. A null id sorts first and is a response only when all ids of its payload are null. An empty table gives an
archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import shared_folder, stored, task_count

SHARD_BYTES, FILE_BYTES = 32 << 20, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard long, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, ordinal: int, url, payload: bytes, refers_to: tuple | None) -> bytes:
    """One record as a gzip member. ``refers_to`` holds the id a revisit refers to."""
    name = lambda i, n: f"<urn:page:{'null' if i is None else i}:{n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {name(page_id, ordinal)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if refers_to:
        head += [f"WARC-Refers-To: {name(refers_to[0], 0)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block + b"\r\n\r\n") + z.flush()


def info_bytes(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\n" \
           f"Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


class _Files:
    """The files of one task: written under temporary names, renamed when whole."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.shard, self.seq, self.out, self.rows = folder, limit, None, 0, None, []

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.system, root = _file_system(self.folder)
            self.name = f"shard-{shard:08d}-{self.seq:05d}.warc.gz"
            self.temporary, self.final = f"{root}/.{self.name}.{uuid.uuid4().hex}.tmp", f"{root}/{self.name}"
            self.out, self.hash, self.bytes, self.records = self.system.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
            self._write(info_bytes(self.name))
        self._write(member)
        self.records += 1
        if self.bytes >= self.limit:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.system.move(self.temporary, self.final)
        self.rows.append((self.name, self.shard, self.records, self.bytes, self.hash.hexdigest()))
        self.out, self.seq = None, self.seq + 1


def _writer(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, mark, ordinal = _Files(folder, limit), None, None, 0
        for batch in batches:
            shard, page, digest, tag, refers, url, html, large = (batch.column(i) for i in range(8))
            for i in range(batch.num_rows):
                now = (page[i].as_py(), digest[i].as_py())
                if now != key:
                    key, mark, ordinal = now, None, 0
                if tag[i].as_py() == 0:
                    mark = (refers[i].as_py(),)
                    continue
                to = mark or ((now[0],) if ordinal and large[i].as_py() else None)
                files.add(shard[i].as_py(), record_bytes(now[0], ordinal, url[i].as_py(), html[i].as_py() or b"", to))
                ordinal += 1
        files.close()
        columns = list(zip(*files.rows, strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["file", "shard", "records", "bytes", "sha256"])

    return run


def shard_cuts(slim: DataFrame, shard_bytes: int) -> np.ndarray:
    """First page id of every shard but the first: a number per shard comes to the driver."""
    order = [F.col("page_id").asc_nulls_first(), "n_bytes"]
    ranged = (slim.select("page_id", "n_bytes").repartitionByRange(task_count(slim.sparkSession, 2), order[0]).sortWithinPartitions(*order)
              .withColumn("part", F.spark_partition_id()))
    ranged = stored(ranged)
    parts = ranged.groupBy("part").agg(F.sum("n_bytes").alias("bytes")).withColumn(
        "before", F.coalesce(F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("page_id", "n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    at = ranged.withColumn("own", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))).join(F.broadcast(parts.select("part", "before")), "part")
    cuts = (at.withColumn("shard", F.floor((F.col("before") + F.col("own")) / shard_bytes)).groupBy("shard").agg(F.min("page_id").alias("first"))
            .where(F.col("shard") > 0).select("first").where(F.col("first").isNotNull()).distinct().orderBy("first"))
    return np.array([r["first"] for r in cuts.collect()], np.int64)


def write_archive(pages: DataFrame, folder: str | None = None, least: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
                  id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[str, DataFrame]:
    """Write all pages below ``folder`` (a new one in the shared folder, if not given). Returns it and its manifest."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b""))
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
            .withColumn("digest", F.sha1("html")).withColumn("n_bytes", F.length("html").cast("long")))
    slim = stored(rows.select("page_id", "digest", "n_bytes"))
    cuts = shard_cuts(slim, shard_bytes)

    @pandas_udf("long")
    def shard_of(ids):
        return ids.__class__(np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), side="right")).astype(np.int64))

    groups = stored(slim.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # both sides are tables, so a payload that many pages share is split by the skew join
    marks = (slim.where(F.col("n_bytes") >= least).join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("to")))
             .select("page_id", "digest", "to"))
    order = ["shard", F.col("page_id").asc_nulls_first(), "digest", "tag"]
    marked = marks.select("page_id", "digest", F.lit(0).alias("tag"), F.col("to").alias("refers_to"), F.lit(None).cast("string").alias("url"),
                          F.lit(None).cast("binary").alias("html"), F.lit(True).alias("large"))
    full = rows.select("page_id", "digest", F.lit(1).alias("tag"), F.lit(None).cast("long").alias("refers_to"), "url", "html",
                       (F.col("n_bytes") >= least).alias("large"))
    sorted_rows = (marked.union(full).withColumn("shard", shard_of("page_id")).repartition(min(len(cuts) + 1, 4 * task_count(spark, 2)), "shard")
                   .sortWithinPartitions(*order).select("shard", "page_id", "digest", "tag", "refers_to", "url", "html", "large"))
    sorted_rows.mapInArrow(_writer(folder, file_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of gzip members."""
    data, z, rest = b"", zlib.decompressobj(31), b""
    while True:
        piece = rest or stream.read(1 << 20)
        if not piece:
            break
        data += z.decompress(piece)
        rest = z.unused_data
        if z.eof:
            head, _, body = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, body[:int(fields["Content-Length"])]
            data, z = b"", zlib.decompressobj(31)
    if data:
        raise ValueError("truncated archive")


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        number = lambda name: None if ":null:" in name else int(name.split(":")[2])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    out = []
                    for head, block in records_of(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and (len(payload) != size or digest32(payload) != digest):
                            raise ValueError(f"{name}: damaged record {head['WARC-Record-ID']}")
                        out.append((number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], number(head["WARC-Refers-To"]) if revisit else None,
                                    head.get("WARC-Target-URI"), payload if with_payload and not revisit else None))
                        if len(out) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Records of the files that the manifest lists, one task or more per file."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = manifest.select("file").repartition(task_count(spark, 2) * 2, "file")
    return files.mapInArrow(_reader(folder, with_payload), RECORD)


RECORDS_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 (((('0x' || substr(x, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> ((3 - i % 4) * 5)::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM r"""
