"""Corpus preparation: rating classes, split, class weights, rebalancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustlens import fixed_values as fv
from trustlens.functions.scores import rating_sentiment, sentiment_label


def with_sentiment(corpus: DataFrame, language: str | None = None) -> DataFrame:
    """Keep one language (optional) and non-null texts; add sentiment and its label."""
    df = corpus
    if language is not None:
        df = df.filter(F.col("language") == language)
    df = df.na.drop(subset=["text"])
    return (df.withColumn("sentiment", rating_sentiment("rating"))
            .withColumn("label", sentiment_label("sentiment")))


def polar(df: DataFrame) -> DataFrame:
    """Rows of the two polar classes only."""
    return df.filter(F.col("sentiment").isin("positive", "negative"))


def split_hash(id_col: str = "doc_id", seed: int = fv.SPLIT_SEED):
    """A portable 32-bit hash per row: the first 8 hex digits of md5('seed:id')."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10)
    return h.cast("long")


def assign_split(df: DataFrame, id_col: str = "doc_id", seed: int = fv.SPLIT_SEED, label_col: str = "label",
                 train: float = fv.TRAIN_SHARE, validation: float = fv.VALIDATION_SHARE) -> DataFrame:
    """``df`` with ``hash`` and ``split``: of each class the first 80 % in order of (hash, id) train,
    the next 10 % validate, to the row.

    No class is sorted: its hashes are counted in 65,536 bins, a running sum over the bins finds the
    two that hold the cuts, and only these bins' rows (about 1 / 65,536 of the class) are ranked.
    """
    df = df.withColumn("hash", split_hash(id_col, seed))
    bins = df.groupBy(F.col(label_col).alias("_y"), F.shiftright("hash", 16).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    by_class = Window.partitionBy("_y")
    bins = (bins.withColumn("_all", F.sum("_n").over(by_class))
            .withColumn("_upto", F.sum("_n").over(by_class.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))))
    # for a cut: its bin, and how many of the bin's rows lie before it
    def cut(share, name):
        want = F.floor(F.col("_all") * share + 0.5)
        holds = (F.col("_upto") >= want) & (F.col("_upto") - F.col("_n") < want)
        at = F.when(holds, F.struct(F.col("_b").alias("bin"), (want - F.col("_upto") + F.col("_n")).alias("rows")))
        return F.coalesce(F.max(at), F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("rows"))).alias(name)
    cuts = bins.groupBy("_y").agg(cut(train, "_t"), cut(train + validation, "_v"))  # a row per class
    rows = df.join(F.broadcast(cuts), F.col(label_col) == F.col("_y")).withColumn("_b", F.shiftright("hash", 16))
    edge = (F.col("_b") == F.col("_t.bin")) | (F.col("_b") == F.col("_v.bin"))
    rank = F.row_number().over(Window.partitionBy("_y", "_b").orderBy("hash", id_col))
    ranked = rows.filter(~edge).withColumn("_r", F.lit(0)).unionByName(rows.filter(edge).withColumn("_r", rank))
    before = lambda c: (F.col("_b") < F.col(f"{c}.bin")) | ((F.col("_b") == F.col(f"{c}.bin")) & (F.col("_r") <= F.col(f"{c}.rows")))
    split = F.when(before("_t"), "train").when(before("_v"), "validation").otherwise("test")
    return ranked.withColumn("split", split).select(*df.columns, "split")


def class_weights(train: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, weight = 1 / n) over the training rows."""
    return (train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("weight", 1.0 / F.col("n")))


def with_class_weight(train: DataFrame, label_col: str = "label") -> DataFrame:
    """Attach the inverse-frequency weight of each row's class (for ``weightCol``)."""
    w = F.broadcast(class_weights(train, label_col).select(label_col, "weight"))
    return train.join(w, label_col)


def class_units(train: DataFrame, label_col: str = "label") -> DataFrame:
    """``train`` with ``units``: the inverse frequency of the row's class as a whole number (2^40 / n), so that
    sums of weights are exact in any order."""
    sizes = F.broadcast(train.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n")))  # a row per class
    return train.join(sizes, label_col).withColumn("units", F.expr(f"{1 << 40} div _n")).drop("_n")


def weighted_draw(rows: DataFrame, n: int | None = None, id_col: str = "doc_id", units_col: str = "units",
                  seed: int = fv.SPLIT_SEED) -> DataFrame:
    """``n`` draws with replacement (default: as many as rows), a row with the chance of its share of all units:
    (draw, *columns of ``rows``), draw from 0 on.

    In order of (hash, id) the rows' units are intervals that cover [0, total); a draw is a hashed
    number in it and takes the row whose interval holds it. Running sums go over 65,536 hash bins and within each
    bin; numbers and intervals meet in cells of the mean units of a draw, of which a row has as many as it
    spans, so a heavy row is no hot key and no class is collected.
    """
    rows = rows.withColumn("_h", split_hash(id_col, seed)).withColumn("_b", F.shiftright("_h", 16))
    bins = rows.groupBy("_b").agg(F.sum(units_col).alias("_u"))
    bins = bins.select("_b", (F.sum("_u").over(Window.orderBy("_b")) - F.col("_u")).alias("_first"))  # at most 65,536 rows
    size, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(units_col), F.lit(0))).first()
    n = size if n is None else n
    cell = max(1, total // max(1, n))
    upto = F.sum(units_col).over(Window.partitionBy("_b").orderBy("_h", id_col).rowsBetween(Window.unboundedPreceding, 0))
    spans = (rows.withColumn("_upto", upto).join(F.broadcast(bins), "_b")
             .withColumn("_hi", F.col("_first") + F.col("_upto")).withColumn("_lo", F.col("_hi") - F.col(units_col))
             .filter(F.col(units_col) > 0)
             .withColumn("_cell", F.explode(F.expr(f"sequence(_lo div {cell}, (_hi - 1) div {cell})"))))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:draw:"), F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = (rows.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"))
             .withColumn("_at", F.pmod(number, F.lit(max(1, total)))).withColumn("_cell", F.expr(f"_at div {cell}")))
    hit = (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
    return draws.join(spans, "_cell").filter(hit).drop("_cell", "_at", "_lo", "_hi", "_first", "_upto", "_h", "_b")


def rebalance_sample(train: DataFrame, label_col: str = "label", seed: int = fv.SPLIT_SEED) -> DataFrame:
    """Draw with replacement so every class has the same expected count n/k."""
    counts = {r[label_col]: r["n"] for r in class_weights(train, label_col).collect()}  # a row per class
    total, k = sum(counts.values()), len(counts)
    parts = [train.filter(F.col(label_col) == c).sample(True, total / (k * n), seed)
             for c, n in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
