"""Penalised logistic regression by Newton steps over grouped sums.

Features lie on a grid, so all reviews with equal features are one cell with two counts, and a fit reads cells
instead of reviews: at most (steps of the grid) ** (features) of them for each head, whatever the corpus. Fitting is a fixed
number of full Newton steps from zero, which any engine can repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.functions.scores import rnd

STEPS, PENALTY, GRID_DIGITS = 6, 1.0, 2


def cells(rows: DataFrame, features: list[str], heads: dict[str, str], digits: int = GRID_DIGITS) -> DataFrame:
    """(head, *features, positives, n): the reviews of each grid cell and head. ``heads``: name -> 0/1 column; a null label
    is none of that head, a review without a feature is in no cell."""
    on_grid = rows.select(*[rnd(f, digits).alias(f) for f in features], *heads.values()).na.drop(subset=features)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(c).cast("long").alias("y")) for h, c in heads.items()]))
    return (on_grid.select(*features, each.alias("e")).filter("e.y is not null").groupBy("e.head", *features)
            .agg(F.sum("e.y").alias("positives"), F.count(F.lit(1)).alias("n")))


def fit_cells(x: np.ndarray, positives: np.ndarray, n: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Weights (intercept first) of one head's cells."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (positives - n * p) - penalty * w)
    return w


def newton_heads(rows: DataFrame, features: list[str], heads: dict[str, str], steps: int = STEPS, penalty: float = PENALTY,
                 digits: int = GRID_DIGITS) -> DataFrame:
    """(head, n, positives, intercept, *weights) of every head that has a label, rounded to 6 digits."""
    spark, found = rows.sparkSession, cells(rows, features, heads, digits).toPandas()
    out = []
    for head, own in found.groupby("head"):
        w = fit_cells(own[features].to_numpy(float), own["positives"].to_numpy(float), own["n"].to_numpy(float), steps, penalty)
        out.append((head, int(own["n"].sum()), int(own["positives"].sum()), *map(float, w)))
    names = ["intercept", *[f"w_{f}" for f in features]]
    table = spark.createDataFrame(out, "head string, n long, positives long, " + ", ".join(f"{c} double" for c in names))
    return table.select("head", "n", "positives", *[rnd(c, 6).alias(c) for c in names])


def predicted(rows: DataFrame, weights: DataFrame, features: list[str], id_col: str = "doc_id", digits: int = GRID_DIGITS) -> DataFrame:
    """(id, head, p) of every review with features, for every head (a row per head, so the join is by broadcast)."""
    z = F.col("intercept") + sum(F.col(f"w_{f}") * rnd(f, digits) for f in features)
    return (rows.select(id_col, *features).na.drop(subset=features).join(F.broadcast(weights.drop("n", "positives")))
            .select(id_col, "head", (1 / (1 + F.exp(-z))).alias("p")))
