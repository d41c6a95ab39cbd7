"""Robust multivariate outliers among documents, with DataFrame functions only.

Each text gives four size-free statistics, transformed: log of the mean word length, log of the
symbols per hundred characters, and the arcsine roots of the shares of repeated lines and of words in
repeated three-word windows. Per language and source, the minimum covariance determinant
estimate of their centre and scatter is found by concentration steps from a median / MAD start:
take the ``SUBSET`` share of documents nearest to the centre, estimate again, repeat; then
reweight once. Documents whose squared Mahalanobis distance exceeds ``CUT`` are rejected.

Groups are estimated by grouped sums and percentile sketches (combined before the shuffle), so
a hot source costs a row per task. Groups of fewer than ``LEAST`` documents are pooled by
language, then altogether; where that pool is still smaller, its documents are held against the
estimate over all documents. Only a corpus whose estimate rests on fewer than ``LEAST`` / 2 documents rejects nothing.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.functions.text import let
from trustlens.llm.common import source, written

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: limits of the plain rules
LEAST_WORDS, MOST_REPEATED = 50, 50
#: share of a group in a concentration step, steps, least size of a group
SUBSET, STEPS, LEAST = 0.75, 4, 100
#: standard deviations that a statistic has at least (a constant one has none), from sampling errors: one symbol in 600
#: characters; 1 / (2 sqrt(n)) of a share among 11 lines, and among the 50 / 3 separate windows of the shortest text
FLOOR = {"x_len": 0.05, "x_sym": 0.15, "x_dup": 0.15, "x_rep": 0.12}
NAMES = list(FLOOR)
#: squared distance beyond which a document is rejected: chi-squared, 4 degrees, 0.9999
CUT = 23.513


def _repeated_words(words):
    """Words that lie in a three-word window found twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes):
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = let(placed, lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        steps = let(starts, lambda at: F.transform(at, lambda i, k: F.least(
            F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)

    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(some)


def text_statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = docs.select(*carry, F.struct(
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l")).alias("s"))
    return parts.select(*carry, "s.w.n_words", "s.w.word_chars", "s.n_symbols", "s.l.n_lines", "s.l.n_dup_lines",
                        "s.w.n_repeat_words")


def with_base(stats: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return stats.withColumn("base_failed", failed)


def transformed() -> dict:
    """The statistic vector's columns."""
    share = lambda a, b: F.asin(F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1))))
    return {"x_len": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "x_sym": F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            "x_dup": share("n_dup_lines", "n_lines"),
            "x_rep": share("n_repeat_words", "n_words")}


# ------------------------------------------------------------------ estimates

def _chi2(x: float, even: int) -> float:
    """Chi-squared distribution function, even degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, even // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def consistency(share: float, p: int = len(NAMES)) -> float:
    """Factor that makes the scatter of the nearest ``share`` of normal vectors that of all."""
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, p) < share else (low, mid)
    return share / _chi2(low, p + 2)


def group_names(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(k_lang, k_source, g): each language and source, and itself or the pool that stands in."""
    sizes = rows.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    small = (sizes.filter(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("pooled"))
             .withColumnRenamed("lang", "p_lang"))
    return (sizes.join(small, F.col("lang").eqNullSafe(F.col("p_lang")), "left")
            .select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"),
                    F.when(F.col("n") >= least, F.to_json(F.struct("lang", "source")))
                    .when(F.col("pooled") >= least, F.to_json(F.struct("lang"))).otherwise(F.lit("*")).alias("g")))


def with_groups(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` (lang, source, ...) with their group ``g``."""
    same = F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))
    return rows.join(named, same).drop("k_lang", "k_source")


def _factored(moments: DataFrame, scale: float) -> DataFrame:
    """(g, m_i, l_ij): centre and Cholesky factor of the scatter (with the floors) from sums."""
    p = len(NAMES)
    cov = lambda i, j: (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(p)})
    out = out.withColumns({f"c{i}{j}": F.greatest(cov(i, i), F.lit(0.0)) + FLOOR[NAMES[i]] ** 2 if i == j else cov(i, j)
                           for i in range(p) for j in range(i + 1)})
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[NAMES[i]] ** 2 / 100))) if i == j
                                 else rest / F.col(f"l{j}{j}"))
    return out.select("g", "n", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _moments(rows: DataFrame) -> DataFrame:
    p = len(NAMES)
    return rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(NAMES[i]).alias(f"s{i}") for i in range(p)],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)])


def with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with ``distance2``: squared Mahalanobis distance in its group (null without one)."""
    p, out, z = len(NAMES), rows.join(estimates.withColumnRenamed("n", "n_est"), "g", "left"), []
    for i in range(p):
        v = F.col(NAMES[i]) - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * F.col(f"_z{j}")
        out = out.withColumn(f"_z{i}", v / F.col(f"l{i}{i}"))
        z.append(F.col(f"_z{i}") * F.col(f"_z{i}"))
    drop = [f"m{i}" for i in range(p)] + [f"l{i}{j}" for i in range(p) for j in range(i + 1)] + [f"_z{i}" for i in range(p)]
    return out.withColumn("distance2", sum(z[1:], z[0])).drop(*drop)


def estimate(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimates by ``g``."""
    p, share = len(NAMES), consistency(SUBSET)
    # a row per group, written: joins with it then have no hot side to share a partitioning with
    half = written(rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(NAMES)]), "estimate")
    spread = rows.join(half, "g").groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[
        F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, x in enumerate(NAMES)])
    start = half.join(spread, "g")
    now = written(start.select("g", "n", *[f"m{i}" for i in range(p)], *[
        (F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + F.lit(FLOOR[NAMES[i]] ** 2)) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
        for i in range(p) for j in range(i + 1)]), "estimate")
    for _ in range(steps):
        near = with_distance(rows, now)
        cut = written(near.groupBy("g").agg(F.percentile_approx("distance2", SUBSET).alias("cut")), "estimate")
        now = written(_factored(_moments(near.join(cut, "g").filter("distance2 <= cut")), share), "estimate")
    kept = with_distance(rows, now).filter(F.col("distance2") <= 11.143)  # chi-squared, 4 degrees, 0.975
    return written(_factored(_moments(kept), consistency(0.975)), "estimate")


def judged(docs: DataFrame, *carry: str, least: int = LEAST, cut: float = CUT) -> DataFrame:
    """(carry..., statistics, base_failed, distance2, kept) of every row of ``docs``.

    ``docs`` has text, lang and source (nulls are values of their own); ``carry`` names columns
    to keep, of its others none matters. A null, empty or wordless text fails the plain rules. Very long texts are
    read whole, as any other, within their row. Repeated rows are judged alike, and so are rows with equal statistics in
    one group (a distance equal to ``cut`` is kept); an empty table gives an empty result.
    """
    keys = [c for c in ("lang", "source") if c not in carry]
    rows = written(with_base(text_statistics(docs, *carry, *keys)).withColumns(transformed()), "statistics")
    named = written(group_names(rows, least), "groups")
    usable = written(with_groups(rows.filter(~F.col("base_failed")).select("lang", "source", *NAMES), named).select("g", *NAMES), "usable")
    pool = usable.filter("g = '*'").agg(F.count(F.lit(1))).scalar()
    others = usable.filter(F.col("g") != "*").withColumn("g", F.lit("*")).filter((pool > 0) & (pool < least))
    usable = written(usable.unionByName(others), "usable")
    far = with_distance(with_groups(rows, named), estimate(usable))
    out = F.col("n_est").isNotNull() & (F.col("n_est") >= least // 2) & (F.col("distance2") > cut)
    return far.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(out, F.lit(False))).drop("n_est", "g", *NAMES, *keys)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = source(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return judged(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                         "base_failed", "kept", "distance2")
