"""The batch scorer's parts, and the rows that a worker holds."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from trustlens.operators import linear_head, models
from trustlens.sources import fixtures as fx


def _scorer(tmp_path):
    cols = {k: [r[i] for r in fx.COEFS] for i, k in enumerate(("head", "class", "term", "coef"))}
    (tmp_path / "coefs").mkdir(exist_ok=True)
    pq.write_table(pa.table(cols), tmp_path / "coefs" / "a.parquet")
    return linear_head.batch_scorer(str(tmp_path / "coefs"), fx.SENTIMENT_CLASSES, fx.ASPECT_CLASSES, fx.ALPHABETS.score)


def test_parts_give_the_same_scores(tmp_path, monkeypatch):
    score = _scorer(tmp_path)
    texts = ["hehely the tion", "", "orre " * 300, "rewh ble", "x", "thatin worthless " * 90, ""] * 5
    batch = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    whole = score(batch)
    for size in (1, 7, 500):
        monkeypatch.setattr(linear_head, "PART_CHARS", size)
        pd.testing.assert_frame_equal(score(batch), whole)
    assert len(whole) == len(texts) and len(score(batch.iloc[:0])) == 0 and len(score(batch.iloc[1:2])) == 1


def test_a_worker_holds_bounded_batches(spark):
    rows = spark.range(5000).repartition(1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    make = lambda: lambda pdf: pd.DataFrame({"n": [len(pdf)]})
    sizes = [r["n"] for r in models.score_partitions(rows, make, "n long").collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 2000
