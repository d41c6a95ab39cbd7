"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.llm.common import written


def _with_min(e: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours; a hot u is pre-aggregated, and the
    join back can be split."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.join(least, "u")


def _state(e: DataFrame):
    """Number and hash of the edges: equal when a step has changed nothing."""
    return e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the component's least node.

    ``edges`` may hold repeats and loops; rows with a null end are no edges. Each step is
    written to the shared folder.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter("u is not null and v is not null and u > v").distinct())
    e = written(e, "edges")
    seen = _state(e)
    for _ in range(rounds if seen[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = written(small, "edges")
        seen, before = _state(e), seen
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
