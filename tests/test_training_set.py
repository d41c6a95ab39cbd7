"""The drawn training set and the grouped Newton fit."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trustlens.operators.corpus import class_units, weighted_draw
from trustlens.operators.newton import cells, fit_cells, newton_heads, predicted
from trustlens.sources.fixtures import local_table


def test_draw_follows_the_weights(spark):
    rows = spark.createDataFrame([(i, 0 if i % 20 else 1) for i in range(2000)], "doc_id long, label int")
    drawn = weighted_draw(class_units(rows), 20_000).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(20_000))
    share = Counter(r["label"] for r in drawn)
    assert abs(share[1] / 20_000 - 0.5) < 0.02  # one row in twenty, half of the draws
    assert len({r["doc_id"] for r in drawn if r["label"] == 1}) == 100
    again = weighted_draw(class_units(rows.repartition(5)), 20_000).collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))


def test_one_row_holds_nearly_all_units(spark):
    rows = spark.createDataFrame([(i, 10**12 if i == 7 else 1) for i in range(500)] + [(999, 0)], "doc_id long, units long")
    drawn = weighted_draw(rows, 3000).collect()
    assert len(drawn) == 3000 and Counter(r["doc_id"] for r in drawn)[7] > 2990
    assert 999 not in {r["doc_id"] for r in drawn}


def test_draw_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, units long")
    assert weighted_draw(none).count() == 0 and weighted_draw(none, 5).count() == 0


def test_newton_finds_the_likelihoods_top(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((4000, 2)), 2)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(-1 + 3 * x[:, 0] - 2 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), 1 - int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "doc_id long, a double, b double, y int, z int")
    fitted = newton_heads(df, ["a", "b"], {"up": "y", "down": "z"})
    got = {r["head"]: r for r in fitted.collect()}
    w = np.array([got["up"][c] for c in ("intercept", "w_a", "w_b")])
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    gradient = np.hstack([np.ones((4000, 1)), x]).T @ (y - p) - w
    assert np.abs(gradient).max() < 0.01 and got["up"]["n"] == 4000 and got["up"]["positives"] == int(y.sum())
    assert np.allclose(w, [-got["down"][c] for c in ("intercept", "w_a", "w_b")], atol=2e-6)
    assert cells(df, ["a", "b"], {"up": "y"}).agg(F.sum("n")).first()[0] == 4000
    out = {(r["doc_id"], r["head"]): r["p"] for r in predicted(df, fitted, ["a", "b"]).collect()}
    assert np.allclose([out[i, "up"] for i in range(4000)], p, atol=1e-5)


def test_newton_with_missing_values_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, None, 1), (3, 0.25, None), (4, 0.75, 1)], "doc_id long, a double, y int")
    r = newton_heads(df, ["a"], {"h": "y"}).first()
    assert (r["n"], r["positives"]) == (2, 2) and r["intercept"] > 0
    assert newton_heads(df.limit(0), ["a"], {"h": "y"}).count() == 0
    assert np.isfinite(fit_cells(np.zeros((0, 1)), np.zeros(0), np.zeros(0))).all()


def test_parameter_tables_have_a_known_size(spark):
    rows = [("it's", 1, None), ('a "b" \\ c', 2, 0.5), (None, -3, 1e-9)]
    t = local_table(spark, rows, "s string, n int, x double")
    assert sorted(map(tuple, t.collect()), key=repr) == sorted(rows, key=repr)
    assert "LocalTableScan" in t._jdf.queryExecution().executedPlan().toString()
    assert local_table(spark, [], "s string").count() == 0
