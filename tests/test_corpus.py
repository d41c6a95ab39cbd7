"""The stratified split."""

import hashlib

import pytest

from trustlens.operators.corpus import assign_split


def by_hand(rows):
    out = {}
    for label in {y for _, y in rows}:
        own = sorted((int(hashlib.md5(f"42:{d}".encode()).hexdigest()[:8], 16), d) for d, y in rows if y == label)
        n = len(own)
        for i, (_, d) in enumerate(own):
            out[d] = "train" if i < int(n * 0.8 + 0.5) else "validation" if i < int(n * 0.9 + 0.5) else "test"
    return out


@pytest.mark.parametrize("sizes", [(1000, 70), (1, 2), (9, 300), (5,), (40_000, 3)])
def test_every_class_is_cut_to_the_row(spark, sizes):
    rows = [(i, y) for y, n in enumerate(sizes) for i in range(y * 10**6, y * 10**6 + n)]
    df = spark.createDataFrame(rows, "doc_id long, label int")
    out = assign_split(df)
    assert out.columns == ["doc_id", "label", "hash", "split"]
    assert {r["doc_id"]: r["split"] for r in out.collect()} == by_hand(rows)


def test_empty(spark):
    assert assign_split(spark.createDataFrame([], "doc_id long, label int")).count() == 0
