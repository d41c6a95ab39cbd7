"""Thresholds, bands, ties and empty batches of the report operators."""

from pyspark.sql import functions as F

from trustlens.operators.linear_head import linear_head_scores
from trustlens.plans import jobs

SCHEMA = ("doc_id long, text string, sentiment string, confidence_pct double, aspects string, "
          "trust_score double, trust_length double, trust_diversity double, trust_emotion double, "
          "trust_quality double, trust_similarity double")


def _scored(spark, rows):
    return spark.createDataFrame(
        [(i, "t", s, 90.0, a, t, 0.0, 0.0, 0.0, 0.0, 0.0) for i, (s, t, a) in enumerate(rows)], SCHEMA)


def test_suspicious_threshold(spark):
    df = _scored(spark, [("positive", 49.9, "—"), ("positive", 50.0, "—"), ("negative", 50.1, "—")])
    flags = [r["flag"] for r in jobs.detail(df).orderBy("doc_id").collect()]
    assert flags == ["suspicious", "ok", "ok"]
    k = jobs.report_kpis(df).first()
    assert (k["total"], k["positive"], k["negative"], k["suspicious"]) == (3, 2, 1, 1)
    assert [r["doc_id"] for r in jobs.suspicious(df).collect()] == [0]


def test_single_verdict(spark):
    """A review whose trust is exactly 50.0 is suspicious, just above it is safe."""
    from trustlens.functions.text import DEFAULT_ALPHABETS as A
    lex = spark.createDataFrame([], "pos long, term string, tag string, value double")

    def predict(docs):
        return docs.select("doc_id", F.lit("positive").alias("sentiment"), F.lit(0.9).alias("confidence"),
                           F.array().cast("array<string>").alias("aspect_list"))
    # length n/5, no diversity below three tokens, neutral emotion, letters' share of the characters
    texts = ["абвгд абвгд", "абвгд абвг1", "абвгд абвгд абвгд", "а"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in jobs.single_reviews(docs, lex, predict, A).collect()}
    assert out[0]["trust_score"] == 53.5 and out[0]["verdict"] == "safe"
    assert out[3]["verdict"] == "suspicious" and out[3]["trust_score"] < 50
    for r in out.values():
        assert r["trust_display"] == r["trust_score"]
        assert r["verdict"] == ("safe" if r["trust_score"] > 50.0 else "suspicious")


def test_verdict_at_fifty(spark, monkeypatch):
    scored = _scored(spark, [("positive", t, "—") for t in (49.9, 50.0, 50.1, 0.5, 0.51)])
    monkeypatch.setattr(jobs, "analyze", lambda *a, **k: scored)
    got = [(r["trust_display"], r["verdict"]) for r in jobs.single_reviews(None, None, None).collect()]
    assert got == [(49.9, "suspicious"), (50.0, "suspicious"), (50.1, "safe"), (50.0, "suspicious"), (51.0, "safe")]


def test_repeated_lexicon_terms_count_once(spark):
    from trustlens.functions.text import DEFAULT_ALPHABETS as A
    docs = spark.createDataFrame([(1, "супер супер супер плохо")], "doc_id long, text string")
    rows = [(0, "супер", "PSTV", 0.1), (1, "супер", "PSTV", 0.9), (2, "супер", "PSTV", 0.9), (0, "плохо", "NGTV", -1.0)]
    once = [(1, "супер", "PSTV", 0.9), (0, "плохо", "NGTV", -1.0)]
    make = lambda r: spark.createDataFrame(r, "pos long, term string, tag string, value double")
    a, b = (jobs.trust_signals(docs, make(r), A, with_similarity=False).first()["emotion"] for r in (rows, once))
    assert a == b


def test_report_reads_one_kept_batch(spark):
    r = jobs.report(_scored(spark, [("positive", 10.0, "a, b"), ("negative", 90.0, "a")]))
    assert len(r.caches.tables) == 1 and r.caches.tables[0].is_cached
    assert r.kpis.first()["total"] == 2 and r.detail.count() == 2 and r.suspicious.count() == 1
    assert {x["aspect"]: x["mentions"] for x in r.mentions.collect()} == {"a": 2, "b": 1}
    r.release()
    assert not r.caches.tables


def test_health_bands(spark):
    # 1000 rows with spam counts that give health 80.0, 79.9, 50.0, 49.9
    for spam, band in ((200, "no_spam"), (201, "moderate"), (500, "moderate"), (501, "high_spam")):
        rows = [("positive", 10.0 if i < spam else 90.0, "—") for i in range(1000)]
        h = jobs.health_kpis(_scored(spark, rows)).first()
        assert h["band"] == band, (spam, h["health_pct"])


def test_health_negative_is_total_minus_positive(spark):
    df = _scored(spark, [("positive", 90.0, "—"), ("neutral", 90.0, "—"), ("negative", 90.0, "—")])
    h = jobs.health_kpis(df).first()
    assert (h["positive"], h["negative"]) == (1, 2)
    assert h["dominant"] == "negative"


def test_empty_batch(spark):
    df = spark.createDataFrame([], SCHEMA)
    k = jobs.report_kpis(df).first()
    assert (k["total"], k["positive_pct"], k["mean_trust"]) == (0, 0.0, 0.0)
    h = jobs.health_kpis(df).first()
    assert (h["total"], h["pos_share"], h["spam_share"], h["health_pct"]) == (0, 0.0, 0.0, 100.0)
    assert jobs.aspect_mentions(df).count() == 0


def test_aspect_mentions_order(spark):
    df = _scored(spark, [("positive", 90.0, "b, a"), ("positive", 90.0, "a"), ("positive", 90.0, "—"),
                         ("positive", 90.0, "c, b")])
    got = [(r["aspect"], r["mentions"], r["rank"]) for r in jobs.aspect_mentions(df).orderBy("rank").collect()]
    assert got == [("a", 2, 1), ("b", 2, 2), ("c", 1, 3)]


def test_head_ties(spark):
    docs = spark.createDataFrame([(1, "nothing known here"), (2, "good")], "doc_id long, text string")
    coefs = spark.createDataFrame(
        [("sentiment", "negative", None, 0.0), ("sentiment", "positive", None, 0.0),
         ("sentiment", "positive", "good", 1.0),
         ("aspect", "a1", None, 0.0), ("aspect", "a2", None, -1.0), ("aspect", "other", None, 5.0),
         ("aspect", "a2", "good", 3.0)],
        "head string, class string, term string, coef double")
    out = {r["doc_id"]: r for r in linear_head_scores(docs, coefs, ["negative", "positive"],
                                                       ["a1", "a2", "other"], "a-z").collect()}
    # p(positive) exactly 0.5 -> negative with confidence 0.5; aspect p = 0.5 is not listed;
    # only "other" above the threshold -> no aspect
    assert out[1]["sentiment"] == "negative" and out[1]["confidence"] == 0.5
    assert out[1]["aspect_list"] == []
    assert out[2]["sentiment"] == "positive" and out[2]["aspect_list"] == ["a2"]


def test_tags_from_arrays(spark):
    from trustlens.operators.aspects import tags_from_arrays
    df = spark.createDataFrame([(["price", "box"],), (["nothing"],), (["late", "cost"],)], "l array<string>")
    d = {"quality": ["box"], "price": ["cost", "price"], "delivery": ["late"]}
    got = [r[0] for r in df.select(tags_from_arrays("l", d, "other")).collect()]
    assert got == [["quality", "price"], ["other"], ["price", "delivery"]]


def test_analyze_text_and_csv(spark, tmp_path):
    from trustlens.functions.text import DEFAULT_ALPHABETS as A
    lex = spark.createDataFrame([(0, "супер", "PSTV", 0.9)], "pos long, term string, tag string, value double")
    coefs = spark.createDataFrame([("sentiment", "negative", None, 0.0), ("sentiment", "positive", None, 0.0),
                                   ("sentiment", "positive", "супер", 1.0)],
                                  "head string, class string, term string, coef double")

    def predict(docs):
        return linear_head_scores(docs, coefs, ["negative", "positive"], ["a", "другое"], A.score)
    r = jobs.analyze_text(spark, "Отличный телефон, камера супер, доставили быстро!", lex, predict).first()
    assert r["sentiment"] == "positive" and r["verdict"] == "safe"
    src = tmp_path / "in.csv"
    src.write_text('text,other\n"супер, очень ""хорошо"" товар",1\n,2\nплохо плохо плохо плохо,3\n', encoding="utf-8")
    out = jobs.analyze_csv(spark, str(src), str(tmp_path / "out"), lex, predict).collect()
    assert len(out) == 2
    assert {r["text"] for r in out} == {'супер, очень "хорошо" товар', "плохо плохо плохо плохо"}


def test_analyze_empty_batch(spark):
    from trustlens.functions.text import DEFAULT_ALPHABETS as A
    docs = spark.createDataFrame([], "doc_id long, text string")
    lex = spark.createDataFrame([(0, "супер", "PSTV", 0.9)], "pos long, term string, tag string, value double")
    coefs = spark.createDataFrame([("sentiment", "negative", None, 0.0), ("sentiment", "positive", None, 0.0)],
                                  "head string, class string, term string, coef double")

    def predict(d):
        return linear_head_scores(d, coefs, ["negative", "positive"], ["a", "другое"], A.score)
    scored = jobs.analyze(docs, lex, predict, A)
    assert scored.columns == jobs.SCORED_COLUMNS
    assert scored.count() == 0
    h = jobs.health_kpis(scored).first()
    assert (h["total"], h["pos_share"], h["spam_share"]) == (0, 0.0, 0.0)


def test_health_rescale_option(spark):
    df = spark.createDataFrame([(1, "t", "positive", 0.9, "—", 80.0, 0.0, 0.0, 0.0, 0.0, 0.0)], SCHEMA)
    assert jobs.health_kpis(df).first()["avg_confidence_pct"] == 0.9
    assert jobs.health_kpis(df, rescale_fractions=True).first()["avg_confidence_pct"] == 90.0
