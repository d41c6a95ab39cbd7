"""Shared pieces: scratch tables in the shared folder, input columns, membership filters."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.words import mix
from trustlens.session import checkpoint_dir, ship_package

#: rows of a batch that goes to a Python worker
BATCH_ROWS = 2000
#: bits of a membership filter: a fixed size, whatever is put into it
FILTER_BITS = 1 << 23


_LOCAL = threading.local()


def made() -> list[str]:
    """Scratch paths in the order in which this thread made them."""
    if not hasattr(_LOCAL, "paths"):
        _LOCAL.paths = []
    return _LOCAL.paths


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    made().append(f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return made()[-1]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more, and let Spark drop the shuffles of finished
    jobs (it does when the driver collects its garbage)."""
    sc = spark.sparkContext
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    sc._jvm.System.gc()


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package to the Python workers, and send them smaller batches: texts are long, and a
    batch is held by the executor and by the worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, beside their executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def source(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A driver table, only the columns that are needed."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def _positions(key):
    """Three bit positions of a key column."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(FILTER_BITS)) for i in range(3)]


def membership_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bit filter over a long column: every key tests positive, others seldom. Built as a
    grouped OR on the executors; its size is fixed (1 MB), so it may be broadcast."""
    bits = keys.select(F.explode(F.array(*_positions(F.col(column)))).alias("bit"))
    words = (bits.groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["set"].to_numpy().view(np.uint64)
    return out


def filter_positions(column: str):
    """The bit positions of a column, for ``test_bits`` in a task."""
    return F.array(*_positions(F.col(column)))


def test_bits(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """positions: one row of three bit positions for each key."""
    hit = (bits[positions >> 6] >> (positions & 63).astype(np.uint64)) & np.uint64(1)
    return hit.all(axis=1)


def _hash_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of 64-bit hashes."""
    x, low = mix(hashes), np.uint64(FILTER_BITS - 1)
    return (x & low).astype(np.int64), ((x >> np.uint64(32)) & low).astype(np.int64)


def hash_filter(rows: DataFrame, column: str) -> np.ndarray:
    """Bit filter of fixed size over the hashes in an array<long> column, or-ed together on the
    executors; ``hashes_in`` tests it."""
    def places(batches):
        for batch in batches:
            hashes = batch.column(column).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate(_hash_places(hashes)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))],
                                             names=["word", "bit"])
    bits = rows.select(column).mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return out


def hashes_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the filter (all that are, and few others)."""
    hit = lambda at: ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    first, second = _hash_places(hashes)
    got = np.flatnonzero(hit(first))
    return got[hit(second[got])]
