"""Small public helpers."""

from collections import Counter

from pyspark.sql import functions as F

from trustlens.functions import rnd, term_counts, vector_tokens
from trustlens.sources.writers import read_class_order, write_class_order

from small_tables import SF_SMALL


def test_term_counts_equal_counter(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", vector_tokens("text").alias("t"),
                       term_counts(vector_tokens("text")).alias("c")).collect()
    for r in rows:
        assert {x["term"]: x["tf"] for x in r["c"]} == dict(Counter(r["t"]))
    empty = spark.createDataFrame([([],)], "t array<string>").select(term_counts("t")).first()[0]
    assert empty == []


def test_half_up_rounding(spark):
    df = spark.createDataFrame([(51.25,), (56.25,), (0.05,), (12.34,), (0.0,)], "x double")
    got = [r[0] for r in df.select(rnd("x", 1)).collect()]
    assert got == [51.3, 56.3, 0.1, 12.3, 0.0]


def test_class_order_round_trip(spark, tmp_path):
    classes = ["качество", "цена", "доставка", "сервис", "соответствие", "другое"]
    write_class_order(spark, classes, str(tmp_path / "classes"))
    assert read_class_order(spark, str(tmp_path / "classes")) == classes


def test_rebalance_sample_evens_classes(spark):
    from trustlens.operators.corpus import rebalance_sample
    rows = [(i, 1 if i % 10 else 0) for i in range(2000)]   # 90 % / 10 %
    df = spark.createDataFrame(rows, "doc_id long, label int")
    counts = {r["label"]: r["count"] for r in rebalance_sample(df).groupBy("label").count().collect()}
    assert set(counts) == {0, 1}
    assert 0.75 < counts[0] / counts[1] < 1.33
