"""Streaming micro-batches and the trained-model round trip."""

import os
import tempfile

from pyspark.sql import functions as F

from trustlens.functions.text import LATIN_ALPHABETS as A
from trustlens.plans import catalog
from trustlens.sources import fixtures as fx
from trustlens.streaming import row_signals, score_stream

from small_tables import SF_SMALL


def test_stream_scores_every_row(spark):
    out = tempfile.mkdtemp(prefix="trustlens-stream-")
    src = (spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long")
           .option("pathGlobFilter", "documents.parquet").parquet(SF_SMALL))
    q = score_stream(src.select("doc_id", "text"), fx.lexicon(spark, SF_SMALL), catalog._predict(spark),
                     os.path.join(out, "sink"), os.path.join(out, "ckpt"), A)
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(out, "sink"))
    assert got.count() == 200
    batch = catalog.scored(spark, SF_SMALL)
    diff = got.drop("epoch").exceptAll(batch)
    assert diff.count() == 0


def test_row_signals_on_stream(spark):
    src = (spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long")
           .option("pathGlobFilter", "documents.parquet").parquet(SF_SMALL))
    q = row_signals(src, A).writeStream.format("memory").queryName("sig").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM sig").first()[0] == 200


def test_train_save_reload(spark):
    m = catalog.q_train_models(spark, "/root/testdata/sf0.01").collect()
    assert len(m) == 3
    chosen = [r for r in m if r["chosen"]]
    assert len(chosen) == 1
    assert chosen[0]["reloaded_f1_positive"] == chosen[0]["f1_positive"]
    best = max(r["f1_positive"] for r in m)
    assert chosen[0]["f1_positive"] == best
