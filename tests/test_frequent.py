"""Frequent terms from bounded summaries against plain counts."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trustlens.operators.frequent import _reduced, _sums, candidates, frequent_terms, frequent_vocabulary
from trustlens.operators.tfidf import doc_count, postings, vocabulary


def _top(counts, size):
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]


@pytest.fixture(scope="module")
def rows(spark):
    """Terms by a power law, all partitions alike, and one hot partition of terms of its own."""
    rng = np.random.default_rng(3)
    terms = [f"t{x}" for x in np.minimum(rng.zipf(1.3, 30_000), 9_000)] + [f"own{x}" for x in range(2_000)] * 2
    data = [(t, int(n)) for t, n in zip(terms, rng.integers(1, 4, len(terms)))]
    counts = Counter()
    for t, n in data:
        counts[t] += n
    return spark.createDataFrame(data, "term string, n long").repartition(6).persist(), counts


@pytest.mark.parametrize("size,slots,proven", [(10, None, True), (20, 300, True), (50, 60, False), (20_000, 30_000, True)])
def test_equals_plain_counts(rows, size, slots, proven):
    df, counts = rows
    assert (candidates(df, size, slots) is not None) == proven
    assert [(r["term"], r["n"]) for r in frequent_terms(df, size, slots).collect()] == _top(counts, size)


def test_candidates_are_few(rows):
    df, counts = rows
    some = {r["term"] for r in candidates(df, 20, 300).collect()}
    assert {t for t, _ in _top(counts, 20)} <= some and len(some) < 300


def test_bounds_of_a_summary():
    rng = np.random.default_rng(4)
    held, error, counts = [], 0, Counter()
    for _ in range(30):
        t = [f"w{x}" for x in rng.zipf(1.2, 500) % 1000]
        counts.update(t)
        table, cut = _reduced(_sums([*held, pa.table({"term": t, "n": pa.array([1] * len(t), pa.int64())})]), 40)
        held, error = [table], error + cut
        assert table.num_rows <= 40
    got = dict(zip(held[0]["term"].to_pylist(), held[0]["n"].to_pylist()))
    assert all(got.get(t, 0) <= n <= got.get(t, 0) + error for t, n in counts.items())


def test_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1), (None, 9), ("", 2), ("a", 0)], "term string, n long")
    assert [tuple(r) for r in frequent_terms(df, 2).collect()] == [("", 2), ("a", 2)]
    assert [tuple(r) for r in frequent_terms(df, 9).collect()] == [("", 2), ("a", 2), ("b", 2), ("c", 1)]
    assert frequent_terms(df.limit(0), 3).collect() == []


@pytest.mark.parametrize("slots", [None, 40, 6])
def test_vocabulary(spark, slots):
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * k) % 23}" for k in range(9)) + " common") for i in range(80)] + [(99, None), (100, "")],
                                 "doc_id long, text string").repartition(4)
    want = vocabulary(postings(docs), doc_count(docs), 12).orderBy("idx").collect()
    assert frequent_vocabulary(docs, 12, slots=slots).orderBy("idx").collect() == want
