"""Session and cluster-facing settings."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # one BLAS thread per Python worker: Spark already runs one worker per core
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                driver_memory: str = "16g", app: str = "trustlens") -> SparkSession:
    """A session for tests and local runs. On a cluster, pass the cluster's own session instead."""
    builder = SparkSession.builder.master(master).appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; a fresh local folder is only made when the
    setting is absent and driver and executors are one process (tests, local runs).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="trustlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialised(df, name: str, **options):
    """``df`` as a Parquet table in the shared folder, computed once: its size is known to whatever is planned on it, and
    its lineage is cut. ``options``: of the writer."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    drop_finished(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_finished(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of finished jobs: it does when the driver collects its garbage, which by itself may be
    long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``trustlens`` importable in the Python workers (once per application).

    Functions run by ``applyInPandas`` / ``mapInPandas`` are pickled by reference to
    their module, so executors need the package. The package is zipped on the driver
    and handed to ``addPyFile``; Spark distributes it to every executor.
    """
    import os
    import zipfile

    import trustlens

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(trustlens.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="trustlens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


class Caches:
    """Intermediate tables persisted by one job, in memory and on disk; ``release`` drops
    them, and no other job's, once the result that needed them has been written. A lost
    executor only costs a recomputation from lineage."""

    def __init__(self):
        self.tables: list = []

    def add(self, df):
        from pyspark import StorageLevel
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.tables.append(df)
        return df

    def release(self) -> None:
        while self.tables:
            self.tables.pop().unpersist()


_CURRENT: ContextVar[Caches] = ContextVar("caches", default=Caches())


def cached(df):
    """Persist ``df`` in the current job's caches."""
    return _CURRENT.get().add(df)


@contextmanager
def caching() -> Iterator[Caches]:
    """What is built inside is cached in its own handle, which the caller releases."""
    own = Caches()
    token = _CURRENT.set(own)
    try:
        yield own
    finally:
        _CURRENT.reset(token)


def release() -> None:
    """Drop the tables cached outside any ``caching`` block."""
    _CURRENT.get().release()
