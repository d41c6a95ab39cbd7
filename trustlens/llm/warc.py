"""WARC archives as a PySpark data source (``format("warc")``).

Writing: each task rolls over files of about ``file_bytes``; only files of tasks that succeeded enter
the folder's list, so files of lost attempts are never read.

Reading: whole files are dealt into partitions of about ``split_bytes``. A record's headers are parsed
first; predicates on the record type and on header columns are pushed down and decided on
them, and an unwanted block is passed over by a seek. The payload is decoded only for records that
are wanted and only when option ``payload`` is true (the default).

A record: ``WARC/1.1``, headers, empty line, block, empty line. A response's block is an HTTP header
and the payload; a revisit has no block: ``WARC-Refers-To`` names the response with its payload.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from trustlens.llm.common import ready, scratch, source, written
from trustlens.llm.token_files import open_folder

#: payloads from this size on are written once
LEAST_BYTES = 100
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES = 64 << 20, 64 << 20, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_LIST = "_files"

SCHEMA = ("page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, "
          "payload binary")
_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
                    ("payload", pa.binary())])
_PUSHED = ("page_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode(row: dict) -> bytes:
    """One record."""
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    block = b""
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    else:
        payload = row["payload"] or b""
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


# ------------------------------------------------------------------ reading

def _number(urn: str | None) -> int | None:
    part = (urn or "").strip("<>").rpartition(":")[2]
    return int(part) if part.lstrip("-").isdigit() else None


def _columns(head: dict[str, str]) -> dict:
    return {"page_id": _number(head.get("warc-record-id")), "record_type": head.get("warc-type"),
            "target_uri": head.get("warc-target-uri"),
            "payload_digest": head["warc-payload-digest"].rpartition(":")[2].lower() if "warc-payload-digest" in head else None,
            "payload_bytes": int(head["x-payload-length"]) if "x-payload-length" in head else None,
            "refers_to": _number(head.get("warc-refers-to"))}


def _test(f, row: dict) -> bool:
    v = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None:
        return False
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, In):
        return v in f.value
    if isinstance(f, StringStartsWith):
        return v.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return v.endswith(f.value)
    return f.value in v if isinstance(f, StringContains) else True


def records(file, wanted, payload: bool):
    """(columns, payload or None) of the records of an open file that pass ``wanted``."""
    size, at, held, base = file.size(), 0, b"", 0

    def more(n: int) -> None:
        """Have n bytes from ``at`` on in ``held``."""
        nonlocal held, base
        if at < base or at + n > base + len(held):
            base, held = at, file.read_at(min(max(n, 1 << 16), size - at), at)

    while at < size:
        span = 1 << 12
        more(min(span, size - at))
        while (end := held.find(b"\r\n\r\n", at - base)) < 0 and at + span < size:
            span *= 2
            more(min(span, size - at))
        lines = held[at - base:end].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at, length = base + end + 4, int(head["content-length"])
        row = _columns(head)
        if wanted(row):
            body = None
            if payload and row["record_type"] == "response":
                more(length)
                block = held[at - base:at - base + length]
                body = block[block.index(b"\r\n\r\n") + 4:]
            yield row, body
        at += length + 4


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split_bytes: int):
        self.path, self.payload, self.split_bytes, self.filters = path, payload, split_bytes, []

    def pushFilters(self, filters):
        kinds = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
        for f in filters:
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        out, held = [], 0
        for path, size in listed(self.path):
            if not out or held + size > self.split_bytes:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out or [Files([])]

    def read(self, partition):
        for path in partition.paths:
            store, name = open_folder(path)
            rows, held = [], 0
            with store.open_input_file(name) as file:
                for row, body in records(file, lambda r: all(_test(f, r) for f in self.filters), self.payload):
                    rows.append(row | {"payload": body})
                    held += 300 + len(body or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of an archive folder: what its lists name; without lists, its *.warc files."""
    store, name = open_folder(path)
    found = store.get_file_info(fs.FileSelector(name))
    lists = sorted(f.path for f in found if f.base_name.startswith(_LIST))
    if not lists:
        return sorted((f"{path}/{f.base_name}", f.size) for f in found if f.base_name.endswith(".warc"))
    out = []
    for x in lists:
        with store.open_input_file(x) as f:
            out += [(f"{path}/{n}", s) for n, s in json.loads(f.read())]
    return out


# ------------------------------------------------------------------ writing

@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, overwrite: bool):
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, iterator):
        store, name = open_folder(self.path)
        store.create_dir(name, recursive=True)
        files, out, size, own = [], None, 0, ""
        for batch in iterator:
            for i in range(batch.num_rows):
                data = encode({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                if out is None:
                    own = f"part-{uuid.uuid4().hex}.warc"
                    out, size = store.open_output_stream(f"{name}/{own}"), 0
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    files.append((own, size))
                    out = None
        if out is not None:
            out.close()
            files.append((own, size))
        return Written(files)

    def commit(self, messages):
        store, name = open_folder(self.path)
        store.create_dir(name, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(name)) if f.base_name.startswith(_LIST)]
        with store.open_output_stream(f"{name}/{_LIST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        for x in old if self.overwrite else []:
            store.delete_file(x)

    def abort(self, messages):
        store, name = open_folder(self.path)
        for own, _ in (x for m in messages if m is not None for x in m.files):
            store.delete_file(f"{name}/{own}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("payload", "true").lower() == "true",
                      int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), overwrite)


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_rows(pages: DataFrame) -> DataFrame:
    """Rows for the writer: of pages with equal payloads of ``LEAST_BYTES`` or more, that with the least
    page_id is the response, the others revisit it. pages: page_id, url, html; further columns are
    ignored. A null html is an empty payload, a null url leaves its header out, a null page_id
    never is what others refer to; repeated rows of a response are responses too."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = written(rows.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy(F.col("payload_digest").alias("same"))
                     .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1 and refers_to is not null").select("same", "refers_to"), "payloads")
    first = F.col("refers_to").isNull() | F.coalesce(F.col("page_id") == F.col("refers_to"), F.lit(False))
    return (rows.join(groups, F.col("payload_digest") == F.col("same"), "left")
            .withColumn("record_type", F.when(first, "response").otherwise("revisit"))
            .withColumn("refers_to", F.when(~first, F.col("refers_to")))
            .withColumn("payload", F.when(first, F.col("payload")))
            .select("page_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records and read back."""
    register(spark)
    folder = f"{scratch(spark, 'warc')}"
    archive_rows(source(spark, sf_dir, "pages", "page_id", "url", "html")).write.format("warc").mode("append").save(folder)
    responses = (spark.read.format("warc").load(folder).filter("record_type = 'response'")
                 .select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                         F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to"))
    revisits = (spark.read.format("warc").option("payload", "false").load(folder).filter("record_type = 'revisit'")
                .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    return responses.unionByName(revisits)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM g
"""
