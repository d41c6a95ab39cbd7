"""Token ids in files of independent zstandard frames.

A file is a run of zstandard frames, each readable on its own, and two skippable frames:

    frame        := documents (u32), then for each: doc_id (i64), known id (u8), ids (u32);
                    then all ids (u32 each, little-endian)
    index        := skippable frame; for each frame: first and last doc_id (i64), documents (u32),
                    ids before it in the file (u64)
    seek table   := skippable frame of the public zstd seekable format: for each frame compressed
                    size, size and checksum (low 32 bits of the content's XXH64), u32 each; then
                    frames (u32), descriptor (u8), magic (u32)

A reader takes the file's tail, finds the frames that hold the requested documents, fetches and
decompresses only these, and holds each against its checksum. Files are written by one task
each, in ascending doc_id order within and across files; a manifest row per file comes only
from tasks that succeeded, so files of lost attempts are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trustlens.llm.common import ready, scratch, source
from trustlens.llm.subwords import Encoder, default_path

#: ids in a frame and bytes in a file at which the next one begins
FRAME_IDS = 1 << 16
FILE_BYTES = 128 << 20
_SKIP_INDEX, _SKIP_TABLE, _SEEKABLE = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
_INDEX = np.dtype([("first", "<i8"), ("last", "<i8"), ("docs", "<u4"), ("before", "<u8")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
_FOOTER = struct.Struct("<IBI")
#: a null doc_id sorts before all others
_NO_ID = -(1 << 63)

MANIFEST = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("number", T.IntegerType()),
                         T.StructField("path", T.StringType()), T.StructField("documents", T.LongType()),
                         T.StructField("ids", T.LongType())])


def _checksum(data: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def open_folder(path: str):
    """(file system, path there) of a local path or URI."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Writer:
    """One file. ``add`` documents in ascending order, then ``close``."""

    def __init__(self, path: str, level: int = 3):
        import zstandard
        store, self.name = open_folder(path)
        self.path, self.out = path, store.open_output_stream(self.name, compression=None)
        self.pack = zstandard.ZstdCompressor(level=level)
        self.seek, self.index, self.written, self.total, self.documents = [], [], 0, 0, 0
        self._begin()

    def _begin(self):
        self.ids, self.heads, self.held = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.heads.append((_NO_ID if doc_id is None else doc_id, doc_id is not None, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            self._frame()

    def _frame(self) -> None:
        if not self.heads:
            return
        keys, known, lens = zip(*self.heads, strict=True)
        data = b"".join([struct.pack("<I", len(keys)), np.array(keys, "<i8").tobytes(), np.array(known, "u1").tobytes(),
                         np.array(lens, "<u4").tobytes(), *(np.ascontiguousarray(x, "<u4").tobytes() for x in self.ids)])
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.seek.append((len(packed), len(data), _checksum(data)))
        self.index.append((keys[0], keys[-1], len(keys), self.total))
        self.written += len(packed)
        self.total += self.held
        self.documents += len(keys)
        self._begin()

    def close(self) -> None:
        self._frame()
        index = np.array(self.index, _INDEX).tobytes()
        table = np.array(self.seek, _SEEK).tobytes() + _FOOTER.pack(len(self.seek), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIP_INDEX, len(index)) + index)
        self.out.write(struct.pack("<II", _SKIP_TABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        import zstandard
        store, name = open_folder(path)
        self.file, self.unpack = store.open_input_file(name), zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, descriptor, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _SEEKABLE or not descriptor & 0x80:
            raise ValueError(f"{path}: no seek table")
        tail = frames * (_SEEK.itemsize + _INDEX.itemsize) + _FOOTER.size + 16
        data = self.file.read_at(tail, size - tail)
        self.index = np.frombuffer(data, _INDEX, frames, 8)
        self.seek = np.frombuffer(data, _SEEK, frames, 16 + frames * _INDEX.itemsize)
        self.at = np.concatenate([[0], np.cumsum(self.seek["packed"].astype(np.int64))])

    def frame(self, k: int):
        """(doc ids, whether known, ids per document, all ids) of frame k, verified."""
        data = self.unpack.decompress(self.file.read_at(int(self.seek["packed"][k]), int(self.at[k])),
                                      max_output_size=int(self.seek["size"][k]))
        if len(data) != self.seek["size"][k] or _checksum(data) != self.seek["checksum"][k]:
            raise ValueError(f"frame {k} is damaged")
        n = struct.unpack_from("<I", data)[0]
        return (np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "u1", n, 4 + 8 * n).astype(bool),
                np.frombuffer(data, "<u4", n, 4 + 9 * n), np.frombuffer(data, "<u4", -1, 4 + 13 * n))

    def frames_of(self, doc_ids) -> list[int]:
        """The frames that may hold some of these documents."""
        keys = np.sort(np.asarray(list(doc_ids), np.int64))
        low = np.searchsorted(keys, self.index["first"], "left")
        return np.flatnonzero(low < np.searchsorted(keys, self.index["last"], "right")).tolist()

    def documents(self, frames=None):
        """(doc_id or None, place of the first id in the file, ids) of the frames, or of all."""
        for k in range(len(self.seek)) if frames is None else frames:
            keys, known, lens, ids = self.frame(k)
            stop = np.cumsum(lens, dtype=np.int64)
            for i, (key, there) in enumerate(zip(keys.tolist(), known.tolist(), strict=True)):
                first = int(stop[i]) - int(lens[i])
                yield key if there else None, int(self.index["before"][k]) + first, ids[first:int(stop[i])]

    def close(self) -> None:
        self.file.close()


def _write(folder: str, tokenizer: str, file_bytes: int):
    def run(batches):
        from pyspark import TaskContext
        part, number, rows, writer = TaskContext.get().partitionId(), 0, [], None
        store, name = open_folder(folder)
        store.create_dir(name, recursive=True)

        def finish():
            writer.close()
            rows.append((part, number, writer.path, writer.documents, writer.total))

        encoder = Encoder.of(tokenizer)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for a, b, ids, bounds in encoder.documents(batch.column("text")):
                for i in range(b - a):
                    if writer is None:
                        writer = Writer(f"{folder}/ids-{part:06d}-{number:05d}-{uuid.uuid4().hex}.zst")
                    writer.add(keys[a + i], ids[bounds[i]:bounds[i + 1]])
                    if writer.written >= file_bytes:
                        finish()
                        writer, number = None, number + 1
        if writer is not None:
            finish()
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=MANIFEST.names)
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder``; returns the manifest, one row per
    file, with ``start``: the ids in all files before it."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write(f"{folder}/files", tokenizer, file_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # ids before a partition (a row per partition), then before a file in its partition
    before = (files.groupBy("partition").agg(F.sum("ids").alias("all"))
              .select("partition", (F.sum("all").over(Window.orderBy("partition")) - F.col("all")).alias("before")))
    own = F.sum("ids").over(Window.partitionBy("partition").orderBy("number")) - F.col("ids")
    return files.withColumn("own", own).join(before, "partition").withColumn("start", F.col("before") + F.col("own")).drop("own", "before")


def read_token_files(manifest: DataFrame, columns, make, schema: str) -> DataFrame:
    """One task per few files; ``make(reader, start)`` gives lists of columns of the schema's types."""
    n = manifest.count()
    if n == 0:
        return manifest.sparkSession.createDataFrame([], schema)
    tasks = min(n, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, -(-n // 16)))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(path)
                try:
                    for k in range(len(reader.seek)):
                        yield pa.RecordBatch.from_arrays(make(reader, k, start), names=columns)
                finally:
                    reader.close()
    return manifest.select("path", "start").repartition(tasks).mapInArrow(run, schema)


def _digest(reader: Reader, k: int, start: int) -> list:
    ids, starts, lens, sums = [], [], [], []
    for doc_id, at, own in reader.documents([k]):
        ids.append(doc_id)
        starts.append(start + at)
        lens.append(len(own))
        sums.append(zlib.crc32(own.tobytes()))
    return [pa.array(x, pa.int64()) for x in (ids, starts, lens, sums)]


def fetch_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a bounded list of requested documents; other frames are not decompressed."""
    wanted = sorted(set(doc_ids))

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                reader = Reader(path)
                got = [(d, x.tolist()) for d, _, x in reader.documents(reader.frames_of(wanted)) if d in set(wanted)]
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()),
                                                  pa.array([x for _, x in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])
    return manifest.select("path").mapInArrow(run, "doc_id long, ids array<long>")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all ``documents`` into token files, read them back: (doc_id, start, n_tokens, ids_crc32).

    A null text is empty (only the end id). Documents of one doc_id stay in the order of their
    texts; a null doc_id comes first. An empty table gives no files and no rows.
    """
    manifest = write_token_files(source(spark, sf_dir, "documents", "doc_id", "text"), scratch(spark, "token-files"), default_path())
    return read_token_files(manifest, ["doc_id", "start", "n_tokens", "ids_crc32"], _digest,
                            "doc_id long, start long, n_tokens long, ids_crc32 long")
