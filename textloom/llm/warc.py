"""WARC archives as chunked record tables.

Writing: the digest of each payload is taken first; of equal payloads of at
least ``min_payload`` bytes the one with the largest id is a response record and the others
are revisit records that refer to it.  A payload is exploded to rows of record
id and chunk number; each row becomes one record, the first a ``response``, later
ones ``continuation`` segments, so no record is larger than a chunk.  Files take a bounded number of records.

Reading: files are parsed as they stream by, to the same chunk rows.  A record
of one chunk is finished in its task; chunks of longer ones are sorted by record
and number, and one running digest is carried along the rows.

Defined cases: a null payload is empty; empty payloads are responses without a
block; rows with equal ids are separate records, told apart by a number; a null id is written as an empty field and
read back as null, and such a row is always a response; of equal payloads under the largest id each is a response; payloads of any
length are written in chunks; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.cells import store
from textloom.session import ensure_checkpoint_dir

MIN_PAYLOAD = 1000
CHUNK = 1 << 18
FILE_RECORDS = 256
END = "\r\n\r\n"


def plan_records(pages: DataFrame, key: str = "page_id", payload: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``id, bytes, sha1, refers_to``: what kind of record each row becomes (``refers_to`` null: a response)."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("id"), F.octet_length(body).cast("long").alias("bytes"),
        F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256"),
    )
    rows = store(rows, "payloads")
    first = rows.where(F.col("bytes") >= min_payload).groupBy("sha256").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(first.where("n > 1").select("sha256", "first"), "sha256", "left")
    refers = F.when((F.col("bytes") >= min_payload) & (F.col("first") != F.col("id")), F.col("first"))
    return joined.select("id", "bytes", "sha1", refers.alias("refers_to"))


def chunk_rows(pages: DataFrame, plan: DataFrame, key: str, payload: str, url: str, chunk: int = CHUNK) -> DataFrame:
    """One row for each record to write: record id, chunk number, totals, and the bytes of the chunk (none for a revisit)."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(url, F.lit("")).alias("url"), body.alias("body"))
    marked = rows.join(plan.where("id is not null").dropDuplicates(["id", "sha1"]), (rows["id"] == plan["id"]) & (F.sha1("body") == plan["sha1"]), "left")
    marked = marked.select(rows["id"], "url", "body", F.sha1("body").alias("sha1"), "refers_to")
    sent = F.when(F.col("refers_to").isNull(), F.col("body")).otherwise(F.lit(b""))
    parts = F.greatest(F.ceil(F.octet_length(sent) / chunk), F.lit(1)).cast("int")
    numbered = marked.withColumn("record", F.expr("uuid()")).withColumn("parts", parts)
    return numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk")).withColumn(
        "data", F.when(F.col("refers_to").isNull(), F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    )


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url",
    min_payload: int = MIN_PAYLOAD, chunk: int = CHUNK, file_records: int = FILE_RECORDS,
) -> None:
    """Gzipped WARC files under ``path``, written by Spark's text sink (the record end is its line end)."""
    rows = chunk_rows(pages, plan_records(pages, key, payload, min_payload), key, payload, url, chunk)
    kind = F.when(F.col("chunk") > 0, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    name = F.concat(F.lit("<urn:uuid:"), F.col("record"), F.when(F.col("chunk") > 0, F.concat(F.lit("-"), "chunk")).otherwise(""), F.lit(">"))
    field = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", kind), field("WARC-Record-ID", name),
        field("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")), field("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        field("WARC-Page-ID", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.coalesce(field("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")), F.lit("")),
        field("WARC-Segment-Number", F.col("chunk") + 1), field("WARC-Segments", F.col("parts")),
        field("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:uuid:"), F.col("record"), F.lit(">"))),
        field("Content-Length", F.octet_length("data")), F.lit("\r\n"),
    )
    text = F.concat(head.cast("binary"), F.col("data")).cast("string").alias("value")
    rows.select(text).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


class _Inflate:
    """Reads of exact sizes from a gzip member, inflated as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 16):
        self.data, self.at, self.step = memoryview(data), 0, step
        self.unzip, self.held = zlib.decompressobj(31), bytearray()

    def fill(self) -> bool:
        if self.at >= len(self.data):
            return False
        self.held += self.unzip.decompress(self.data[self.at : self.at + self.step])
        self.at += self.step
        if self.at >= len(self.data):
            self.held += self.unzip.flush()
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.fill():
                return b""
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self.fill():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


RECORD = "record string, id long, kind string, refers_to long, digest string, chunk int, parts int, data binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            source, rows = _Inflate(content.as_py()), []
            while head := source.until(b"\r\n\r\n"):
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                data = source.take(int(fields["Content-Length"]))
                if source.take(4) != b"\r\n\r\n":
                    raise ValueError("a record does not end where its length says")
                number = lambda name: int(fields[name]) if fields.get(name) else None
                rows.append((
                    fields["WARC-Segment-Origin-ID"], number("WARC-Page-ID"), fields["WARC-Type"], number("WARC-Refers-To-Page-ID"),
                    fields["WARC-Payload-Digest"].removeprefix("sha1:"), number("WARC-Segment-Number") - 1, number("WARC-Segments"), data,
                ))
                if len(rows) >= 32:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of all archives under ``path``."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a record from its sorted chunks; the digest and the length run along."""
    now = sha = None
    size = 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["chunk"] == 0:
                now, sha, size = row, hashlib.sha1(), 0
                expected = 0
            if now is None or row["record"] != now["record"] or row["chunk"] != expected:
                raise ValueError("a segment is missing")
            sha.update(row["data"])
            size += len(row["data"])
            expected += 1
            if expected == row["parts"]:
                out.append((now["id"], now["kind"], now["refers_to"], now["digest"], sha.hexdigest(), size))
        columns = list(zip(*out)) or [()] * 6
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["id", "kind", "refers_to", "digest", "seen", "bytes"]
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``id, kind, refers_to, digest, seen, bytes`` of every record: the stated digest, and digest and length of what was read."""
    schema = "id long, kind string, refers_to long, digest string, seen string, bytes long"
    chunks = read_chunks(spark, path)
    whole = chunks.where("parts = 1").mapInArrow(_digest, schema)
    longer = chunks.where("parts > 1").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_digest, schema)
    return whole.unionByName(longer)


def archive_roundtrip(pages: DataFrame, path: str | None = None, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Pages written to archives and read back: ``id, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit record has no block, so its payload is that of the record it refers to; that record's
    digest, as read, must be the one the revisit states.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, key, payload, url)
    records = store(read_records(spark, path), "records")
    response = records.where("kind = 'response'").select(
        F.col("id").alias("at"), F.col("seen").alias("there"), F.col("bytes").alias("size")
    ).dropDuplicates(["at", "there"])
    own = records.join(response, (records["refers_to"] == response["at"]) & (records["digest"] == response["there"]), "left")
    revisit = F.col("kind") == "revisit"
    return own.select(
        "id", F.when(revisit, F.col("size")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("there")).otherwise(F.col("seen")).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
    )
