"""Partitioning of a review batch."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from trustlens.session import materialised

#: files for each core that a dealt batch is written as, at least
FILES_PER_CORE = 2


def spread(docs: DataFrame) -> DataFrame:
    """Deal the rows out where the input has fewer files than the cluster has cores (one small
    file of one row group is one task); otherwise the scan's own splits stay, and no text
    moves. Parts are cut by the bytes that were dealt (``spark.sql.adaptive.advisoryPartitionSizeInBytes``
    at most, fewer while cores would idle), so a task's part does not grow with the input. Looks at the plan only, starts no job."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.isStreaming or not 0 < len(docs.inputFiles()) < cores:
        return docs
    return docs.hint("rebalance")


def dealt(docs: DataFrame, name: str = "batch") -> DataFrame:
    """``spread`` for a batch that several branches of a job read: where the input has fewer files than the cluster has
    cores, its rows are written once, as more files, and every branch scans these. (Dealt out in the plan, the text is
    shuffled anew for each branch and each job.) Its tasks cut their own rows into files, so nothing is shuffled here."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.isStreaming or not 0 < len(docs.inputFiles()) < cores:
        return docs
    rows = math.ceil(docs.count() / (FILES_PER_CORE * cores))
    return materialised(docs, name, maxRecordsPerFile=max(1, rows), compression="zstd")
