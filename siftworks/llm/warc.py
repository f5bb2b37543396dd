"""WARC archives as a PySpark Python data source, with payload dedup by revisit records.

Reading: the driver plans one partition a file (writers roll files at ``roll_bytes``, so partitions stay
bounded); equality, IN, null and range filters on header columns are pushed down; a record's headers are
parsed first, and the block of an unwanted record, or of any record when the payload column is not in the
schema, is skipped by a seek instead of being read and decoded.

Writing: each task writes files of its own; the commit lists them in a manifest, so files of failed or
repeated attempts are never read. Paths are URIs for pyarrow's file systems; on a cluster they lie in a
shared store.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ._stage import bounded_batches, stage, staged_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, record_date string, payload_digest string, "
    "refers_to string, payload_length long, content_length long, payload binary"
)
MANIFEST = "_manifest.json"
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
#: The table of repeated payloads is broadcast up to so many bytes; above, the join shuffles.
BROADCAST_BYTES = 4 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "record_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}


def file_system(path: str):
    """(file system, path in it) for a URI or an absolute path."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def record_bytes(r: dict) -> bytes:
    """One record: a response holds an HTTP head and the payload, a revisit the head alone."""
    block = b"" if r["record_type"] == "revisit" else r.get("payload") or b""
    if r["record_type"] in ("response", "revisit"):
        block = _HTTP + block
    lines = ["WARC/1.1"]
    for column, name in _HEADERS.items():
        value = r.get(column)
        if value is not None:
            lines.append(f"{name}: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value)))
    if r["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if r["record_type"] in ("response", "revisit"):
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream, wanted, with_payload: bool) -> Iterator[dict]:
    """Records of an open archive: ``wanted`` sees the parsed headers; only then a block is read."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and name:
                headers[name] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
        r = {c: headers.get(h.lower()) for c, h in _HEADERS.items()}
        r["payload_length"] = int(r["payload_length"]) if r["payload_length"] else None
        length = r["content_length"] = int(headers.get("content-length", 0))
        if not wanted(r):
            stream.seek(length, io.SEEK_CUR)
            continue
        r["payload"] = None
        if with_payload and r["record_type"] != "revisit":
            block = stream.read(length)
            if len(block) < length:
                raise ValueError("the archive ends inside a record")
            r["payload"] = block.partition(b"\r\n\r\n")[2] if r["record_type"] == "response" else block
        else:
            stream.seek(length, io.SEEK_CUR)
        yield r


def _opened(path: str):
    files, inner = file_system(path)
    source = files.open_input_file(inner)
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=source)
    return _Buffered(source)


class _Buffered(io.RawIOBase):
    """Lines and seeks over an Arrow file, through a buffer."""

    def __init__(self, source) -> None:
        self.source, self.buffer, self.at = source, b"", 0

    def _more(self, n: int = 1 << 16) -> bool:
        got = self.source.read(n)
        self.buffer = self.buffer[self.at :] + got
        self.at = 0
        return bool(got)

    def readline(self, size: int = -1) -> bytes:
        start = 0
        while (k := self.buffer.find(b"\n", self.at + start)) < 0:
            start = len(self.buffer) - self.at
            if not self._more():
                k = len(self.buffer) - 1
                break
        out, self.at = self.buffer[self.at : k + 1], k + 1
        return out

    def read(self, n: int = -1) -> bytes:
        have = len(self.buffer) - self.at
        if n > have:
            out = self.buffer[self.at :] + self.source.read(n - have)
            self.buffer, self.at = b"", 0
            return out
        out = self.buffer[self.at : self.at + n]
        self.at += n
        return out

    def seek(self, n: int, whence: int = io.SEEK_CUR) -> int:
        have = len(self.buffer) - self.at
        if n <= have:
            self.at += n
        else:
            self.source.seek(self.source.tell() + n - have)
            self.buffer, self.at = b"", 0
        return 0

    def close(self) -> None:
        self.source.close()


@dataclass
class WarcFile(InputPartition):
    path: str


_PLAIN = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    In: lambda x, v: x is not None and x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    IsNull: lambda x, v: x is None,
    IsNotNull: lambda x, v: x is not None,
}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns = path.rstrip("/"), schema.names
        self.schema_ = schema
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _PLAIN and len(f.attribute) == 1 and f.attribute[0] != "payload":
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, inner = file_system(self.path)
        info = files.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [WarcFile(self.path)]
        names = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File)
        if MANIFEST in names:
            with files.open_input_file(f"{inner}/{MANIFEST}") as f:
                names = json.loads(f.read())
        return [WarcFile(f"{self.path}/{x}") for x in names if x.endswith((".warc", ".warc.gz"))] or [WarcFile("")]

    def wanted(self, r: dict) -> bool:
        return all(_PLAIN[type(f)](r[f.attribute[0]], getattr(f, "value", None)) for f in self.pushed)

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        schema = to_arrow_schema(self.schema_)
        rows: list[dict] = []
        size = 0
        stream = _opened(partition.path)
        for r in records(stream, self.wanted, "payload" in self.columns):
            rows.append(r)
            size += len(r["payload"] or b"") + 500
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist([{c: x[c] for c in self.columns} for x in rows], schema)
                rows, size = [], 0
        stream.close()
        if rows:
            yield pa.RecordBatch.from_pylist([{c: x[c] for c in self.columns} for x in rows], schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, options: dict) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.zipped = options.get("compression", "none") == "gzip"
        self.roll = int(options.get("roll_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, inner = file_system(self.path)
        files.create_dir(inner, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped)
                    out, size = files.open_output_stream(f"{inner}/{names[-1]}", compression=None), 0
                data = record_bytes(r)
                out.write(gzip.compress(data, 6) if self.zipped else data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, inner = file_system(self.path)
        files.create_dir(inner, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        at = f"{inner}/{MANIFEST}"
        if not self.overwrite and files.get_file_info(at).type == fs.FileType.File:
            with files.open_input_file(at) as f:
                names = json.loads(f.read()) + names
        with files.open_output_stream(at) as f:
            f.write(json.dumps(sorted(names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, inner = file_system(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                files.delete_file(f"{inner}/{n}")


class WarcDataSource(DataSource):
    """``format("warc")``. Read options: path. Write options: path, compression (none or gzip, a member a record), roll_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """A WARC record for each page: among equal payloads of ``least`` bytes or more, that of the largest page_id is stored.

    A null html is an empty payload. Rows that repeat the largest page_id are the same record and all stored.
    Rows with a null page_id revisit the largest page_id that has their payload; if none has, they are stored.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html").cast("long")})
    again = (
        own.where(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and stored is not null")
        .select(F.col("digest").alias("_digest"), "stored")
    )
    again = stage(again, "warc-repeats")
    if again.count() * 64 <= BROADCAST_BYTES:
        again = F.broadcast(again)
    own = own.join(again, (F.col("digest") == F.col("_digest")) & (F.col("n") >= least), "left")
    revisit = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return own.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("record_date"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.when(revisit, urn(F.col("stored"))).alias("refers_to"),
        F.col("n").alias("payload_length"),
        F.lit(None).cast("long").alias("content_length"),
        F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
    )


def round_trip(pages: DataFrame, compression: str = "none") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives.

    Of stored payloads, length and digest are those of the bytes read; of revisits, those in the headers.
    Control characters in a url are percent-encoded. A null html is an empty payload, one of any length is a
    record, held whole by the task that writes or reads it; repeated rows are each written. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    bounded_batches(spark)
    path = staged_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").option("compression", compression).save(path)
    back = spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>", 1).try_cast("long")
    stored = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.expr("substring(payload_digest, 6)")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLE = r"""
with p as (
  select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, '')))::bigint n, sha1(coalesce(html, '')) d from pages),
m as (select d, max(page_id) stored from p where n >= 1000 group by d having count(*) > 1)
select page_id, n as payload_bytes, p.d as payload_digest,
  case when n >= 1000 and stored is not null and page_id is distinct from stored then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and stored is not null and page_id is distinct from stored then stored end as refers_to
from p left join m on p.d = m.d
"""
