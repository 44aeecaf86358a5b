"""WARC archives as a table of chunks.

A record is written as rows (archive, record, chunk, last, data, digest): chunk 0 begins with the record's header,
its payload follows in chunks of `CHUNK` bytes, and each row carries the SHA-256 of the payload as far
as it goes. The `data` of an archive's rows, in the order of record and chunk, is a WARC file. Payloads are cut into
chunks by Spark: Python holds batches of `ROWS_AT_ONCE` chunks and a running digest, in the writer and in the reader,
whatever the length of a record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batch_rows, byte_view, counted, utf8, written

CHUNK = 1 << 16
#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 100
#: Chunks that come to Python in a batch, 64 MB of long payloads.
ROWS_AT_ONCE = 1_000
#: Chunks are handed on in batches of about so many bytes.
BATCH = 1 << 22
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
SCHEMA = "archive int, record bigint, chunk int, last boolean, data binary, digest binary"


def header(page: str | None, url: str | None, size: int, digest: str, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """Lines up to the empty one. Ids and addresses are escaped, so that no line can be broken."""
    safe = "!#$&'()*+,/:;=?@[]~%"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             "WARC-Record-ID: <urn:page:>" if page is None else f"WARC-Record-ID: <urn:page:id:{quote(page, safe='')}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=safe)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:id:{quote(refers_to, safe='')}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html",
              f"Content-Length: {0 if revisit else size}"]
    return "\r\n".join(lines).encode("ascii") + END


class Record:
    """Reads the chunks of a record one after the other."""

    def __init__(self, data: bytes):
        head, found, self.first = bytes(data).partition(END)
        lines = head.decode("ascii").split("\r\n")
        if not found or lines[0] != "WARC/1.1":
            raise ValueError("a chunk 0 without a record's header")
        self.fields = dict(line.split(": ", 1) for line in lines[1:])
        self.left = int(self.fields["Content-Length"])
        self.size, self.digest, self.chunk = self.left, hashlib.sha256(), 0

    def add(self, chunk: int, last: bool, data: bytes, digest: bytes) -> None:
        if chunk != self.chunk:
            raise ValueError(f"chunk {chunk} where {self.chunk} was due")
        part = self.first if chunk == 0 else data
        if last:
            if part[-len(END):] != END:
                raise ValueError("a record without an end")
            part = part[: -len(END)]
        self.digest.update(part)
        self.left -= len(part)
        self.chunk += 1
        if self.digest.digest() != digest or last and self.left:
            raise ValueError("a payload that is not what was written")

    def row(self) -> tuple[str | None, str, int, str, str | None]:
        """page, type, bytes and digest of the payload, page it refers to."""
        name = self.fields["WARC-Record-ID"][len("<urn:page:") : -1]
        kind, told = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and told != self.digest.hexdigest():
            raise ValueError("a payload that does not have its record's digest")
        to = self.fields.get("WARC-Refers-To")
        return (unquote(name.removeprefix("id:")) if name else None, kind, self.size, told,
                unquote(to[len("<urn:page:id:") : -1]) if to else None)


def write(pages: DataFrame, path: str, *, chunk_bytes: int = CHUNK, date: str = DATE, broadcast_rows: int = BROADCAST_ROWS,
          rows_at_once: int = ROWS_AT_ONCE) -> None:
    """Write a record for each row of `pages` (page_id, url, html) to the folder `path`, an archive for each task.

    The payload is the html in UTF-8; null is empty. Of equal payloads of at least 100 bytes, that with the smallest
    page_id is a response and the others are revisits of it; rows that repeat its id are responses as well, and so
    are all smaller payloads. Rows without an id are revisits of one with an id, or else responses. Payloads are
    equal if their SHA-256 is.
    """
    payload = utf8(F.col("html"))
    heads = pages.select("page_id", F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    long = heads.filter(F.octet_length("payload") >= LEAST_BYTES)
    first = written(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n"),
                    "responses")
    joined = heads.join(counted(first, broadcast_rows), "digest", "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    rows = joined.select(F.col("page_id").cast("string").alias("page"), "url", "digest", F.col("first").cast("string").alias("first"),
                         again.alias("again"), F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    # A record's chunks are numbered first and cut one at a time: they follow each other in one task.
    size = F.octet_length("payload")
    last = F.greatest(F.ceil(size / chunk_bytes), F.lit(1)) - 1
    numbered = rows.withColumns({"size": size, "end": last.cast("int")}).withColumn("chunk", F.explode(F.sequence(F.lit(0), "end")))
    part = F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    cut = numbered.select("page", "url", "digest", "first", "again", "size", "chunk", (F.col("chunk") == F.col("end")).alias("last"), part.alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record = TaskContext.get().partitionId(), -1
        sofar, out, held = hashlib.sha256(), [], 0
        for batch in batches:
            data, offsets = byte_view(batch.column(8))
            page, url, digest, first, again, size, chunk, last = (batch.column(i).to_pylist() for i in range(8))
            for i in range(batch.num_rows):
                content, head = memoryview(data[offsets[i] : offsets[i + 1]]), b""
                if chunk[i] == 0:
                    record, sofar = record + 1, hashlib.sha256()
                    head = header(page[i], url[i], size[i], digest[i], first[i], again[i], date)
                sofar.update(content)
                if last[i] and not again[i] and sofar.hexdigest() != digest[i]:
                    raise ValueError("chunks that do not make up the payload")
                out.append((archive, record, chunk[i], last[i], b"".join((head, content, END if last[i] else b"")), sofar.digest()))
                held += len(out[-1][4])
                if held > BATCH:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)

    with batch_rows(pages.sparkSession, rows_at_once):
        cut.mapInArrow(run, SCHEMA).write.parquet(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["archive", "record", "chunk", "last", "data", "digest"])


def read(spark: SparkSession, path: str, *, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """One row per record: page, record_type, payload_bytes, payload_digest, refers_to, with ids as strings.

    Every payload is read and its digest compared. A revisit has the size of the response that it refers to. A
    record of one chunk is read where it lies; the chunks of others are brought together, and read one by one.
    """
    table = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = None
        for batch in batches:
            chunk, last, data, digest = (batch.column(i) for i in range(2, 6))
            out = []
            for i in range(batch.num_rows):
                part, number = data[i].as_py(), chunk[i].as_py()
                if number == 0:
                    record = Record(part)
                record.add(number, last[i].as_py(), part, digest[i].as_py())
                record.first = b""
                if last[i].as_py():
                    out.append(record.row())
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = ["page", "record_type", "payload_bytes", "payload_digest", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    fields = "page string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"
    short = table.filter("chunk = 0 and last")
    rest = table.filter("not (chunk = 0 and last)").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    with batch_rows(spark, rows_at_once):
        records = written(short.mapInArrow(run, fields).unionByName(rest.mapInArrow(run, fields)), "records")
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'")
    sizes = responses.groupBy(F.col("page").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    needed = sizes.join(revisits.select("refers_to").distinct(), "refers_to", "left_semi")
    full = revisits.drop("payload_bytes").join(needed, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(full)


def export(spark: SparkSession, path: str, archive: int) -> Iterable[bytes]:
    """The bytes of an archive, chunk by chunk."""
    rows = spark.read.schema(SCHEMA).parquet(path).filter(F.col("archive") == archive).orderBy("record", "chunk")
    for row in rows.select("data").toLocalIterator():
        yield bytes(row.data)
