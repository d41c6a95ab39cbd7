"""Sharding by a k-d tree over document metadata.

Every document is a point: size, language and source, each on a line of 2**20 places. The tree starts
with all documents; a node heavier than the target is split along the dimension in which it
is widest, at the weighted median (weight: bytes), until leaves have reached the target. Medians are
found together for all nodes of a level: weights are summed over 4096 intervals, then over 4096 parts of
the interval that holds the median, and so on. So each round sends the driver at most 4096 rows
per node, whatever the number of documents, and the cut is exact.

Behind a document's place on the line stands a hash, so a place that holds a third of all rows (a hot
source) can be cut too. Equal texts share one place and the leading bits of the hash, so that they lie
side by side on every line; a group of at most ``HEAVY`` of a leaf shares all bits and is never cut. A heavier one
goes on with hashes of its documents: it is cut only where a median falls into it.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlens.llm.common import source, written

SHARDS = 16
DIMENSIONS = ("size", "lang", "source")
#: share of a leaf up to which a group of equal texts is never cut (leaves are then off by less than that share)
HEAVY = 0.05
#: bits of a place, of a text's hash behind it and of what follows; of one round of the search, and rounds
PLACE_BITS, TEXT_BITS, DOC_BITS, ROUND_BITS, SEARCH = 20, 12, 16, 12, 4
HASH_BITS = TEXT_BITS + DOC_BITS
#: documents that are numbered together
SLOT_ROWS = 2000


def _place(column) -> "F.Column":
    """A name's place on its line."""
    return F.when(column.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(column), F.lit((1 << PLACE_BITS) - 1)) + 1)


def points(docs: DataFrame, leaf: float) -> DataFrame:
    """(doc_id, size, text_crc32, tie, p0, p1, p2): one narrow row per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("same"),
                       F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = written(rows, "metadata")
    # groups of equal texts: one language and source each; the heavy ones are few (their weights add up)
    groups = rows.groupBy("same", "size").agg(F.min("lang").alias("g_lang"), F.min("source").alias("g_source"),
                                              F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = written(groups.withColumn("heavy", F.col("n") * F.col("size") > HEAVY * leaf), "groups")
    rows = rows.join(groups, ["same", "size"], "left")
    top = lambda x, bits: F.shiftrightunsigned(x, 64 - bits)
    low = F.when(F.coalesce(F.col("heavy"), F.lit(False)), F.xxhash64("same", "doc_id")).otherwise(F.xxhash64("same", F.lit(2)))
    tie = F.shiftleft(top(F.xxhash64("same", F.lit(1)), TEXT_BITS), DOC_BITS) + top(low, DOC_BITS)
    shared = lambda c: F.when(F.col("n").isNotNull(), F.col(f"g_{c}")).otherwise(F.col(c))
    line = {"size": F.least(F.lit((1 << PLACE_BITS) - 1), F.floor(F.log2(F.col("size").cast("double")) * (1 << (PLACE_BITS - 6)))),
            "lang": _place(shared("lang")), "source": _place(shared("source"))}
    return rows.select("doc_id", "size", "text_crc32", tie.alias("tie"),
                       *[line[d].cast("long").alias(f"p{i}") for i, d in enumerate(DIMENSIONS)])


def _split(placed: DataFrame, cuts: dict[int, tuple[int, int]]) -> DataFrame:
    """``placed`` with its nodes (node -> dimension, cut) split; the root is 1, children 2n and 2n + 1."""
    node = F.col("node")
    for n, (d, cut) in cuts.items():
        node = F.when(F.col("node") == n, F.lit(2 * n) + (_coordinate(d) > F.lit(cut)).cast("int")).otherwise(node)
    return placed.withColumn("node", node)


def _coordinate(d: int):
    return F.shiftleft(F.col(f"p{d}"), HASH_BITS) + F.col("tie")


def _medians(rows: DataFrame, widest: dict[int, int], weight: dict[int, int]) -> dict[int, int]:
    """The weighted median of each node (rows: node, size, p*, tie) along its widest dimension."""
    bits = PLACE_BITS + HASH_BITS
    at = F.lit(None).cast("long")
    for n, d in widest.items():
        at = F.when(F.col("node") == n, _coordinate(d)).otherwise(at)
    rows = rows.select("node", "size", at.alias("at")).filter("at is not null")
    # leading bits of the cut, weight before them, weight of the part that they name
    found, below, last = (dict.fromkeys(widest, 0) for _ in range(3))
    for turn in range(SEARCH):
        shift = bits - ROUND_BITS * (turn + 1)
        inside = F.lit(False)
        for n in widest:
            inside = inside | ((F.col("node") == n) & (F.shiftright("at", shift + ROUND_BITS) == found[n]))
        sums = (rows.filter(inside).groupBy("node", F.shiftright("at", shift).alias("bin")).agg(F.sum("size").alias("w")).collect())
        for n in widest:
            before = below[n]
            for b, w in sorted((r["bin"], r["w"]) for r in sums if r["node"] == n):
                if 2 * (before + w) >= weight[n]:
                    break
                before += w
            below[n], found[n], last[n] = before, b, w
    # the part that holds the median goes to the side that this leaves nearer to half
    return {n: ((found[n] + (2 * below[n] + last[n] < weight[n])) << shift) - 1 for n in widest}


def kd_leaves(rows: DataFrame, target: float) -> DataFrame:
    """``rows`` with their leaves (``node``) in the tree for leaves of about ``target`` bytes (a power of two of
    them). The nodes of a level are written: a median's search reads them as a column."""
    edges = [f(F.col(f"p{i}")).alias(f"{f.__name__}{i}") for i in range(len(DIMENSIONS)) for f in (F.min, F.max)]
    placed, span, level = written(rows.withColumn("node", F.lit(1)), "nodes"), None, 0
    while True:
        nodes = placed.groupBy("node").agg(F.sum("size").alias("w"), *edges).collect()
        if not nodes:
            return placed
        if span is None:
            span = [max(1, nodes[0][f"max{i}"] - nodes[0][f"min{i}"]) for i in range(len(DIMENSIONS))]
            depth = max(0, round(log2(max(1.0, nodes[0]["w"] / target))))
        if level == depth:
            return placed
        widest = {r["node"]: max(range(len(span)), key=lambda i: ((r[f"max{i}"] - r[f"min{i}"]) / span[i], -i)) for r in nodes}  # noqa: B023
        cuts = _medians(placed, widest, {r["node"]: r["w"] for r in nodes})
        placed = written(_split(placed, {n: (widest[n], cuts[n]) for n in widest}), "nodes")
        level += 1


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    docs: doc_id, text, lang and source; further columns are ignored. ``shards`` is a power of two; leaves
    are numbered from the left. Nulls: an empty text of size 1, a language or source of its own, any
    doc_id. Repeated rows are rows of their own; an empty table gives no rows. The law is ``bytes``.
    """
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    text = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1
    total, n = docs.agg(F.sum(text), F.count(F.lit(1))).first()
    leaves = kd_leaves(points(docs, (total or 0) / shards), (total or 1) / shards)
    part = max(1, ceil((n or 0) / shards / SLOT_ROWS))
    # every row is in a node of the last level, whose leftmost node is ``shards``
    placed = (leaves.withColumn("shard", (F.col("node") - shards).cast("int"))
              .withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(part)).cast("int"))
              .select("doc_id", "size", "text_crc32", "shard", "part"))
    placed = written(placed, "placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return (placed.join(first, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + slot - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards of near equal bytes."""
    return kd_shards(source(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
