"""Invariants: permutation and partitioning do not change results; tags never empty."""

from pyspark.sql import functions as F

from trustlens.plans import catalog, jobs
from trustlens.sources import fixtures as fx

from small_tables import SF_SMALL


def test_scored_batch_ignores_order_and_partitioning(spark):
    docs = fx.reviews(spark, SF_SMALL)
    lex = fx.lexicon(spark, SF_SMALL)
    a = jobs.analyze(docs, lex, catalog._predict(spark), fx.ALPHABETS)
    b = jobs.analyze(docs.repartition(5).orderBy(F.rand(11)), lex, catalog._predict(spark), fx.ALPHABETS)
    assert a.count() == b.count() == 200
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_tags_never_empty(spark):
    tags = catalog.q_aspect_tags(spark, SF_SMALL).collect()
    assert tags and all(r["tags"] for r in tags)


def test_scores_in_range(spark):
    t = catalog.q_trust_score(spark, SF_SMALL)
    bad = t.filter(~F.col("trust_score").between(0, 100)
                   | ~F.col("trust_similarity").between(0, 100)
                   | ~F.col("trust_emotion").between(0, 100)).count()
    assert bad == 0
