"""WARC archives as a PySpark Python data source, and the archive of a table of pages.

`spark.read.format("warc").load(folder)` gives a row per record. Each committed file is an
input partition; the writer rolls to a new file at `max_bytes`. Headers are parsed first. Predicates on the
record type and on the other header columns are pushed down and decided there, and of a
record that they refuse the block is skipped by its length, neither read nor decoded. So is
every block with the option `payload` = `false`. Load the folder anew for each predicate: Spark
keeps what is pushed down with the load, and two filtered frames of one load would share it. Archives of other tools are read as well: all
`*.warc` and `*.warc.gz` files of a folder without a list of committed files.

`df.write.format("warc").mode("append").save(folder)` writes a record per row of RECORD.
A task writes files of its own name; on commit the driver writes one list of the files of
the tasks that succeeded. Readers go by these lists, so what a lost or repeated task left
behind is never read. A file system is found by the folder's scheme (pyarrow.fs).

A response or revisit carries an HTTP head; a response's body is gzip encoded when that is
smaller, and decoded only for rows that the predicates keep.

Archive of pages: of rows whose payloads (html in UTF-8) are equal and of at least 100
bytes, the one with the smallest page_id is a response, the others are revisits that refer to it
and hold no body; smaller payloads are all responses.

Defined cases: a NULL html is an empty payload; NULL page_ids come last and have no header.
Of repeated rows with the smallest page_id one is the response, the others refer to that
same page_id. A NULL url has no header; control characters in one are percent-encoded in the header. An empty table
writes no record and reads as no row. Extra columns are not read.
"""

from __future__ import annotations

import gzip
import io
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

from logweir.llm.common import checkpoint, shared_folder

#: The names of header fields, by column. Those with X are extensions.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to_id": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "WARC-X-Payload-Length",
    "page_id": "WARC-X-Page-ID",
    "refers_to": "WARC-X-Refers-To-Page-ID",
}
LONG = ("payload_bytes", "page_id", "refers_to")
RECORD = ", ".join(f"{c} {'bigint' if c in LONG else 'string'}" for c in HEADERS) + ", payload binary"
#: Least bytes of a payload that later records may refer to.
LEAST_SHARED = 100
#: Parts that rows of one payload are dealt to, so that a hot page is several tasks.
SALTS = 16
#: Copies of one row that a task writes at once.
PART = 10_000
_BY_FIELD = {field.lower(): column for column, field in HEADERS.items()}
_OTHERS = frozenset({EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNull, IsNotNull,
                     StringStartsWith, StringEndsWith, StringContains})


# --- records


def record_bytes(row: dict) -> bytes:
    """One record: header, HTTP head, body, and the two empty lines that end it."""
    kind, payload = row["record_type"], row["payload"] or b""
    head = b""
    if kind in ("response", "revisit"):
        fields = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
        if kind == "response":
            packed = gzip.compress(payload, 5, mtime=0) if len(payload) >= LEAST_SHARED else payload
            if len(packed) < len(payload):
                payload = packed
                fields.append("Content-Encoding: gzip")
        head = ("\r\n".join([*fields, f"Content-Length: {len(payload)}"]) + "\r\n\r\n").encode()
    lines = ["WARC/1.1"]
    for column, field in HEADERS.items():
        value = row.get(column)
        if value is not None:
            lines.append(f"{field}: {_one_line(str(value))}")
    if head:
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(head) + len(payload)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + head + payload + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), value)


def read_records(file, keep=None, payloads: bool = True) -> Iterator[dict]:
    """The records of an open archive whose headers `keep` accepts; other blocks are skipped unread."""
    while True:
        line = file.readline()
        while line in (b"\r\n", b"\n"):
            line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        fields = _fields(file)
        length = int(fields.get("content-length", 0))
        row = {column: fields.get(field) for field, column in _BY_FIELD.items()}
        for column in LONG:
            row[column] = int(row[column]) if row[column] is not None else None
        if (keep is None or keep(row)) and payloads:
            row["payload"] = _payload(file, length, fields.get("content-type", ""))
            yield row
        else:
            file.seek(length, io.SEEK_CUR)
            if keep is None or keep(row):
                yield row | {"payload": None}


def _fields(file) -> dict[str, str]:
    fields, last = {}, None
    while (line := file.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("an archive ends early, inside a header")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()  # a folded line
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields


def _payload(file, length: int, content_type: str) -> bytes:
    """The body of an HTTP message, decoded, or else the whole block."""
    block = file.read(length)
    if len(block) < length:
        raise ValueError(f"an archive ends {length - len(block)} bytes early")
    if not content_type.startswith("application/http"):
        return block
    http = io.BytesIO(block)
    http.readline()
    fields = _fields(http)
    body = http.read()
    return zlib.decompress(body, 47) if fields.get("content-encoding") == "gzip" else body


# --- data source


def _locate(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class ArchiveFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcSource(DataSource):
    """`format("warc")`; see the module's text. Options: path, payload, max_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are appended to, never overwritten")
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() != "false"
        self.names = names
        self.filters: list = []

    def pushFilters(self, filters: list) -> Iterator:
        """Keep what can be decided on headers; the rest goes back to Spark."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if type(inner) in _OTHERS and len(inner.attribute) == 1 and inner.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _locate(self.path)
        found = {i.base_name: i for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file}
        lists = [n for n in found if n.startswith("_committed-")]
        if lists:
            names = []
            for n in lists:
                with fs.open_input_stream(f"{root}/{n}") as f:
                    names += f.read().decode().split()
        else:
            names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        if missing := [n for n in names if n not in found]:
            raise FileNotFoundError(f"archive files are missing: {missing[:5]}")
        return [ArchiveFile(f"{root}/{n}") for n in sorted(names) if found[n].size] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _locate(self.path)
        keep = (lambda row: all(holds(f, row) for f in self.filters)) if self.filters else None
        with fs.open_input_file(partition.path) as raw:
            file = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            rows, held = [], 0
            for row in read_records(file, keep, self.payloads):
                rows.append(row)
                held += len(row["payload"] or b"")
                if held > 8_000_000 or len(rows) >= 2_000:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kind = lambda n: pa.binary() if n == "payload" else pa.int64() if n in LONG else pa.string()
        return pa.record_batch({n: pa.array([r[n] for r in rows], kind(n)) for n in self.names})


def holds(f, row: dict) -> bool:
    """Whether a header row satisfies a pushed predicate; what is unknown doesn't."""
    return _decided(f, row) is True


def _decided(f, row: dict) -> bool | None:
    if isinstance(f, Not):
        inner = _decided(f.child, row)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None or (not isinstance(f, In) and f.value is None):
        return None
    match f:
        case EqualTo():
            return value == f.value
        case In():
            return True if value in f.value else None if None in f.value else False
        case GreaterThan():
            return value > f.value
        case GreaterThanOrEqual():
            return value >= f.value
        case LessThan():
            return value < f.value
        case LessThanOrEqual():
            return value <= f.value
        case StringStartsWith():
            return value.startswith(f.value)
        case StringEndsWith():
            return value.endswith(f.value)
        case _:
            return f.value in value


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.max_bytes = int(options.get("max_bytes", 64 << 20))
        fs, root = _locate(self.path)
        fs.create_dir(root, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _locate(self.path)
        names, out, size = [], None, 0
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for row in batch.slice(at, 256).to_pylist():
                        if out is None or size >= self.max_bytes:
                            if out is not None:
                                out.close()
                            names.append(f"part-{uuid.uuid4().hex}.warc")
                            out, size = fs.open_output_stream(f"{root}/{names[-1]}", buffer_size=1 << 20), 0
                        data = record_bytes(row)
                        out.write(data)
                        size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, root = _locate(self.path)
        names = [n for m in messages if m is not None for n in m.names]
        # Written aside and renamed: readers see the whole list or none.
        aside = f"{root}/.list-{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write("\n".join(names).encode())
        fs.move(aside, f"{root}/_committed-{uuid.uuid4().hex}")

    def abort(self, messages: list) -> None:
        fs, root = _locate(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                fs.delete_file(f"{root}/{n}")


cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- the archive of a table of pages


def _urn(text: Column) -> Column:
    """A record id made from a hash of hexadecimal digits."""
    part = lambda a, n: F.substring(text, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def page_records(pages: DataFrame, date: str) -> DataFrame:
    """The rows of RECORD for `pages`: responses, and revisits of equal payloads.

    Who is a response is decided on rows without payloads; these travel once, to the decision
    on their row. Rows that are alike in all of this are merged before they travel; all but
    the first of them are added as rows without a payload of their own.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload")
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    alike = ["digest", "page_id", "target_uri", "payload_bytes"]
    large = F.col("payload_bytes") >= LEAST_SHARED
    repeats = checkpoint(
        rows.select(*alike, F.when(~large, F.col("payload")).alias("small")).groupBy(*alike, "small").agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("target_uri").isNull().alias("no_uri"), "target_uri")
    first = repeats.where(large).groupBy("digest").agg(F.min(rank).alias("first"), F.sum("n").alias("together")).where("together > 1")
    first = first.select(F.col("digest").alias("f_digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    salt = F.pmod(F.xxhash64("page_id", "target_uri"), F.lit(SALTS)).cast("int")
    met = repeats.where(large).withColumn("salt", salt).join(
        first, (F.col("digest") == F.col("f_digest")) & (F.col("salt") == F.col("f_salt"))
    )
    # One text per row; it tells NULLs from empty texts, so rows meet by a plain equality.
    text = lambda c: F.concat(F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(F.col(c).cast("string"), F.lit("")))
    key = F.concat("digest", text("page_id"), F.lit(" "), text("target_uri"))
    decided = met.select(
        key.alias("d_key"), F.col("first.page_id").alias("first_page"), F.col("first").eqNullSafe(rank).alias("is_first")
    )
    merged = rows.withColumn("key", key).groupBy("key").agg(
        *[F.first(c).alias(c) for c in alike], F.first("payload").alias("payload")
    )
    single = merged.join(decided, F.col("key") == F.col("d_key"), "left").select(
        *alike, "payload", F.coalesce("is_first", F.lit(True)).alias("is_first"), "first_page", F.col("d_key").isNotNull().alias("shared")
    )
    # Further copies of a row, in parts of PART, so that a row that stands very often is several tasks.
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 2) / PART)))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(PART), F.col("n") - 1 - F.col("part") * PART)))
    often = repeats.where("n > 1").withColumn("part", parts).withColumn("salt", salt)
    again = often.join(first, (F.col("digest") == F.col("f_digest")) & (F.col("salt") == F.col("f_salt")), "left")
    again = again.repartition("digest", "part").withColumn("copy", copies).select(
        *alike, F.col("small").alias("payload"), (~large).alias("is_first"), F.col("first.page_id").alias("first_page"), F.lit(False).alias("shared")
    )
    return single.unionByName(again).select(
        F.when(F.col("is_first"), "response").otherwise("revisit").alias("record_type"),
        F.when(F.col("is_first") & F.col("shared"), _urn(F.col("digest"))).otherwise(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).alias("record_id"),
        F.lit(date).alias("date"), "target_uri",
        F.when(~F.col("is_first"), _urn(F.col("digest"))).alias("refers_to_id"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), "payload_bytes", "page_id",
        F.when(~F.col("is_first"), F.col("first_page")).alias("refers_to"),
        F.when(F.col("is_first"), F.col("payload")).alias("payload"),
    )


def use_warc(spark: SparkSession) -> None:
    """Register the format and let Spark push predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    use_warc(pages.sparkSession)
    page_records(pages, date).write.format("warc").mode("append").save(folder)


def archived_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` to an archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of responses the figures are taken from the payload as it was read and checked against the
    header; revisits hold no payload, theirs are those of the header.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, folder)
    # Loaded for each predicate: Spark keeps what is pushed down with the load, so frames of one load would share it.
    loaded = lambda: spark.read.format("warc").load(folder)
    stated = F.substring_index("payload_digest", ":", -1)
    found = F.sha2("payload", 256)
    wrong = F.raise_error(F.concat(F.lit("payload and digest of a record differ: "), "record_id"))
    responses = loaded().where("record_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(found == stated, found).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to",
    )
    revisits = loaded().where("record_type = 'revisit'").select(
        "page_id", "payload_bytes", stated.alias("payload_digest"), "record_type", "refers_to"
    )
    return responses.unionByName(revisits)
