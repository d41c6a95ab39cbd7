"""Registered queries over the driver's tables: (spark, sf_dir) -> DataFrame.

Every query reads whole tables (``documents``, ``labels``) or tables Spark derives
from them; the small parameter tables come from ``sources.fixtures``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens import fixed_values as fv
from trustlens.functions.scores import (
    diversity_score, emotion_score, length_score, quality_score, rnd,
)
from trustlens.operators import aspects as asp
from trustlens.operators.corpus import assign_split, class_units, class_weights, polar, weighted_draw, with_sentiment
from trustlens.operators.frequent import frequent_terms, frequent_vocabulary
from trustlens.operators.lemmas import clean_lemmas, suffix_rules
from trustlens.operators.lexicon import dedup_lexicon, emotion_stats, lexicon_from_labels
from trustlens.operators.linear_head import aspects_text, linear_head_scores
from trustlens.operators.newton import newton_heads
from trustlens.operators.near_vectors import approximate_scores, recall
from trustlens.operators.similarity import similarity_scores
from trustlens.operators.tfidf import doc_count, postings, tfidf_weights, vocabulary
from trustlens.functions.text import letter_tokens
from trustlens.plans import jobs
from trustlens.operators.partitioning import spread
from trustlens.session import cached, checkpoint_dir, materialised
from trustlens.sources import fixtures as fx
from trustlens.sources import readers as rd
from trustlens.sources.writers import read_class_order, write_class_order, write_csv, write_marked_csv, write_parquet

A = fx.ALPHABETS


# ---------------------------------------------------------------- corpus preparation

def q_rating_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    c = with_sentiment(fx.corpus(spark, sf))
    return c.select("doc_id", "language", "rating", "sentiment", "label")


def _polar_split(spark, sf):
    return assign_split(polar(with_sentiment(fx.corpus(spark, sf), fx.LANGUAGE)))


def q_split_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _polar_split(spark, sf).select("doc_id", "label", "hash", "split")


def q_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    train = _polar_split(spark, sf).filter(F.col("split") == "train")
    return class_weights(train).select("label", "n", rnd("weight", 9).alias("weight"))


def q_train_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with the inverse-frequency weight of their class (ML-2 as weightCol)."""
    from trustlens.operators.corpus import with_class_weight
    train = _polar_split(spark, sf).filter(F.col("split") == "train")
    return with_class_weight(train).select("doc_id", "label", rnd("weight", 9).alias("weight"))


def _lemmas(spark, sf):
    c = with_sentiment(fx.corpus(spark, sf, spread), fx.LANGUAGE)
    return c, clean_lemmas(c, fx.stopwords(spark), fx.form_lemma(spark), A.lemma, carry=("sentiment",))


def q_clean_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    return _lemmas(spark, sf)[1].select("doc_id", "pos", "lemma")


def q_lemma_counts_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return asp.lemma_counts_by_class(asp.lemma_counts(_lemmas(spark, sf)[1]))


def q_candidate_terms(spark: SparkSession, sf: str) -> DataFrame:
    return asp.candidate_terms(q_lemma_counts_by_class(spark, sf))


def q_frequent_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """AG-1, AG-2, TOP-1 from summaries of bounded size and a second count of the candidates."""
    lem = _lemmas(spark, sf)[1].filter(F.col("sentiment").isin("positive", "negative"))
    rows = lem.select(F.col("lemma").alias("term"), F.lit(1).alias("n"))
    return frequent_terms(rows, fv.CANDIDATE_POOL_SIZE).select(F.col("term").alias("lemma"), "n")


def _weak(spark, sf):
    c, lem = _lemmas(spark, sf)
    return asp.weak_aspect_labels(c, asp.lemma_counts(lem), fx.aspect_seeds(spark), fx.ASPECT_CLASSES)


def q_aspect_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return _weak(spark, sf)[0]


def q_aspect_dictionary_full(spark: SparkSession, sf: str) -> DataFrame:
    """JN-3 with every lemma of the polar classes as a candidate."""
    pool = q_lemma_counts_by_class(spark, sf).select("lemma").distinct()
    return asp.expand_aspects(fx.aspect_seeds(spark), pool)


def q_learned_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """JN-6 where the form table does not know a form: lemmas by suffix rules learned from the table."""
    c = with_sentiment(fx.corpus(spark, sf, spread), fx.LANGUAGE)
    known = fx.form_lemma(spark)
    return clean_lemmas(c, fx.stopwords(spark), known, A.lemma, rules=materialised(suffix_rules(known), "rules")).select("doc_id", "pos", "lemma")


def q_aspect_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _weak(spark, sf)[1].select("doc_id", F.array_join("tags", ",").alias("tags"))


def q_aspect_multihot(spark: SparkSession, sf: str) -> DataFrame:
    lab = _weak(spark, sf)[1]
    return lab.select("doc_id", *[F.col("aspect_labels")[i].alias(f"y{i}")
                                  for i in range(len(fx.ASPECT_CLASSES))])


# ---------------------------------------------------------------- lexicon

def q_lexicon_table(spark: SparkSession, sf: str) -> DataFrame:
    return fx.lexicon(spark, sf).select("term", "tag", "value")


def _raw_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon with repeated terms: the label lexicon (pos 0) followed by toxicity
    corrections (pos 1) for terms seen in >= 2 toxic documents; the later row wins."""
    docs, labels = fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels")
    base = lexicon_from_labels(docs, labels, A.lexicon)
    tox = (docs.filter(F.col("text").isNotNull()).join(labels.filter(F.col("toxic") == 1), "doc_id")
           .select(F.explode(F.array_distinct(letter_tokens("text", A.lexicon))).alias("term"))
           .groupBy("term").agg(F.count(F.lit(1)).alias("t")).filter(F.col("t") >= 2))
    fixes = (base.select("term").join(tox, "term")
             .select(F.lit(1).cast("long").alias("pos"), "term", F.lit("NGTV").alias("tag"),
                     (-F.col("t") / (F.col("t") + 1.0)).alias("value")))
    return base.unionByName(fixes)


def q_lexicon_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_lexicon(_raw_lexicon(spark, sf))


# ---------------------------------------------------------------- trust signals

def _rows(spark, sf):
    """The reviews for light row-local signals: no exchange."""
    return fx.reviews(spark, sf).na.drop(subset=["text"])


def _docs(spark, sf):
    """The review batch for work that is heavy per byte of text."""
    return fx.batch(spark, sf).na.drop(subset=["text"])


def _dealt(spark, sf):
    """``_docs`` for a job that reads the texts several times."""
    return fx.dealt_batch(spark, sf).na.drop(subset=["text"])


def q_score_length(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("doc_id", rnd(length_score("text"), 9).alias("length"))


def q_score_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", rnd(diversity_score("text", A.score), 9).alias("diversity"))


def q_score_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("doc_id", rnd(quality_score("text", A.quality, A.capitals), 9)
                                   .alias("quality"))


def q_score_emotion(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf)
    st = emotion_stats(d, fx.lexicon(spark, sf, d), A.lexicon)
    return (d.select("doc_id").join(st, "doc_id", "left")
            .select("doc_id", F.coalesce("hits", F.lit(0)).alias("hits"),
                    rnd(emotion_score("hits", "mean", "std"), 9).alias("emotion")))


def q_tfidf_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    v = vocabulary(postings(d), doc_count(d))
    return v.select("term", "idx", "cf", "df", rnd("idf", 9).alias("idf"))


def q_frequent_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """AG-10, TOP-2 from summaries of bounded size and a second count of the candidates."""
    v = frequent_vocabulary(_docs(spark, sf))
    return v.select("term", "idx", "cf", "df", rnd("idf", 9).alias("idf"))


def q_tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf)
    post = cached(postings(d))
    w = tfidf_weights(post, vocabulary(post, doc_count(d)))
    return w.select("doc_id", "term", rnd("weight", 9).alias("weight"))


def q_similarity_score(spark: SparkSession, sf: str) -> DataFrame:
    return similarity_scores(_dealt(spark, sf))


def q_similarity_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """The near-duplicate signal with partners from the approximate search."""
    return approximate_scores(_dealt(spark, sf))


def q_similarity_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate signal against the exact one: reviews with a near partner, whether nine in ten of them are found,
    and whether none has a larger similarity than the exact one."""
    d = _dealt(spark, sf)
    r = recall(similarity_scores(d), approximate_scores(d))
    return r.select("near", (10 * F.col("found") >= 9 * F.col("near")).alias("recall_enough"), (F.col("beyond") == 0).alias("none_beyond"))


# ---------------------------------------------------------------- scoring and jobs

def _predict(spark):
    coefs = fx.coefs(spark)

    def predict(docs):
        return linear_head_scores(docs, coefs, fx.SENTIMENT_CLASSES, fx.ASPECT_CLASSES, A.score)
    return predict


def q_linear_head_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = _predict(spark)(_docs(spark, sf))
    return s.select("doc_id", "sentiment", "p_positive",
                    rnd(F.col("confidence") * 100, 1).alias("confidence_pct"),
                    aspects_text("aspect_list").alias("aspects"))


def q_trust_score(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf)
    t = jobs.with_trust(jobs.trust_signals(d, fx.lexicon(spark, sf, d), A))
    return t.select("doc_id", "trust_score", "trust_length", "trust_diversity", "trust_emotion",
                    "trust_quality", "trust_similarity")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf)
    return jobs.analyze(d, fx.lexicon(spark, sf, d), _predict(spark), A)


def q_scored_batch(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf)


def q_single_review(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf)
    return jobs.single_reviews(d, fx.lexicon(spark, sf, d), _predict(spark), A)


def q_report_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.report_kpis(scored(spark, sf))


def q_aspect_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """From the predictions alone: counting aspects needs no trust signal."""
    s = _predict(spark)(_docs(spark, sf))
    return jobs.aspect_mentions(s.select(aspects_text("aspect_list").alias("aspects")))


def q_report(spark: SparkSession, sf: str) -> DataFrame:
    """The four sections of JOB-2 from one scored batch, as (section, item, value)."""
    r = jobs.report(scored(spark, sf))
    long = lambda df, section, pairs: df.select(F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), i.alias("item"), v.cast("double").alias("value")) for i, v in pairs])).alias("x")).select("x.*")
    kpis = long(r.kpis, "kpis", [(F.lit(c), F.col(c)) for c in r.kpis.columns])
    mentions = long(r.mentions, "mentions", [(F.col("aspect"), F.col("mentions"))])
    low = long(r.suspicious, "suspicious", [(F.col("doc_id").cast("string"), F.col("trust_score"))])
    flags = r.detail.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return kpis.unionByName(mentions).unionByName(low).unionByName(long(flags, "detail", [(F.col("flag"), F.col("n"))]))


def q_suspicious(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.suspicious(scored(spark, sf))


def q_detail(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.detail(scored(spark, sf))


def q_health_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.health_kpis(scored(spark, sf))


def q_map_scored(spark: SparkSession, sf: str) -> DataFrame:
    """The head applied by a caller-supplied batch scorer; each partition reads the model once."""
    from trustlens.operators.linear_head import SCORE_SCHEMA, batch_scorer
    from trustlens.operators.models import score_partitions
    path = _folder(spark, "coefs")
    write_parquet(fx.coefs(spark), path)
    letters = A.score
    make = lambda: batch_scorer(path, fx.SENTIMENT_CLASSES, fx.ASPECT_CLASSES, letters)
    return score_partitions(_docs(spark, sf), make, SCORE_SCHEMA)


def _evaluated(spark, sf, coefs) -> DataFrame:
    """Figures of one coefficient table against rating labels and weak aspect tags (polar rows)."""
    from trustlens.operators.models import evaluation_table
    c, lem = _lemmas(spark, sf)
    _, tags = asp.weak_aspect_labels(c, asp.lemma_counts(lem), fx.aspect_seeds(spark), fx.ASPECT_CLASSES)
    rows = polar(c).select("doc_id", "text", "label")
    pred = linear_head_scores(rows, coefs, fx.SENTIMENT_CLASSES, fx.ASPECT_CLASSES, A.score)
    pred = pred.join(rows.select("doc_id", "label"), "doc_id").join(tags, "doc_id")
    return evaluation_table(pred.withColumn("pred", (F.col("sentiment") == "positive").cast("int")), len(fx.ASPECT_CLASSES))


def q_eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, fx.coefs(spark))


def q_model_selection(spark: SparkSession, sf: str) -> DataFrame:
    """AG-16 over three coefficient tables: the first with the strictly highest F1 of the positive class."""
    from trustlens.operators.models import first_best
    rows = [_evaluated(spark, sf, fx.coefs(spark, v)).select(F.lit(v).alias("candidate"), "f1_positive", "accuracy")
            for v in range(len(fx.VARIANTS))]
    return first_best(rows[0].unionByName(rows[1]).unionByName(rows[2]), "candidate", "f1_positive")


def q_train_models(spark: SparkSession, sf: str) -> DataFrame:
    """Train candidate models on the corpus, keep the best, save and reload it."""
    return _train(spark, sf).metrics


def _train(spark, sf):
    from trustlens.plans.training import train
    return train(fx.corpus(spark, sf), _raw_lexicon(spark, sf), fx.stopwords(spark), fx.form_lemma(spark),
                 fx.aspect_seeds(spark), fx.ASPECT_CLASSES, _folder(spark, "train"), fx.LANGUAGE, A)


def q_train_contract(spark: SparkSession, sf: str) -> DataFrame:
    """What training must keep to, by class: row counts of its parts, and whether the confusion
    counts add up, the first best candidate is chosen, and the reloaded model predicts the same."""
    from trustlens.operators.models import first_best, load_model
    from trustlens.plans.training import predictions
    t = _train(spark, sf)
    val = t.rows.filter(F.col("split") == "validation")
    one, two = (predictions(m, val, fx.ASPECT_CLASSES).select("doc_id", "p_positive", "aspect_pred") for m in (t.model, load_model(t.path)))
    same = one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    figures = t.metrics.withColumn("candidate", F.monotonically_increasing_id())
    best = first_best(figures, "candidate", "f1_positive").select("candidate", F.col("chosen").alias("best"))
    checks = figures.join(best, "candidate").agg(
        F.count(F.lit(1)).alias("candidates"), F.bool_and(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") == F.col("n")).alias("counts_add_up"),
        F.bool_and(F.col("best") == F.col("chosen")).alias("first_best_chosen"))
    parts = t.rows.groupBy("label").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "validation", "test")])
    c = checks.first()
    return parts.select("*", F.lit(c["candidates"]).alias("candidates"), F.lit(c["counts_add_up"]).alias("counts_add_up"),
                        F.lit(c["first_best_chosen"]).alias("first_best_chosen"), F.lit(same).alias("reloaded_same"))


def q_drawn_training_set(spark: SparkSession, sf: str) -> DataFrame:
    """ML-2 as it is drawn: as many rows as the training split has, with replacement, by inverse class frequency."""
    train = _polar_split(spark, sf).filter(F.col("split") == "train")
    return weighted_draw(class_units(train.select("doc_id", "label"))).select("draw", "doc_id", "label")


NEWTON_FEATURES = ["diversity", "quality"]


def _newton_rows(spark, sf):
    """Labelled reviews of the training split with two row signals and a label for each head."""
    train = _polar_split(spark, sf).filter(F.col("split") == "train")
    signals = train.select("doc_id", "label", rnd(diversity_score("text", A.score), 9).alias("diversity"),
                           rnd(quality_score("text", A.quality, A.capitals), 9).alias("quality"))
    return signals.join(q_aspect_multihot(spark, sf), "doc_id")


def q_newton_heads(spark: SparkSession, sf: str) -> DataFrame:
    """ML-3, ML-4 in a form that can be repeated: the sentiment head and a head for each aspect, fitted by Newton steps."""
    heads = {"sentiment": "label", **{a: f"y{i}" for i, a in enumerate(fx.ASPECT_CLASSES)}}
    return newton_heads(_newton_rows(spark, sf), NEWTON_FEATURES, heads)


def q_shown_trust(spark: SparkSession, sf: str) -> DataFrame:
    """SCR-7 for a batch: the trust scores as shown, and as shown of the same scores given as fractions."""
    s = cached(scored(spark, sf).select("doc_id", "trust_score", rnd(F.col("trust_score") / 100, 6).alias("fraction")))
    shown = jobs.shown_trust(jobs.shown_trust(s, to="shown"), "fraction", "of_fractions")
    return shown.select("doc_id", "shown", rnd("of_fractions", 6).alias("shown_of_fractions"))


def q_aspect_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """SET-2: tags from each review's array of lemmas, where it overlaps an aspect's list of seeds."""
    c, lem = _lemmas(spark, sf)
    arrays = lem.groupBy("doc_id").agg(F.collect_set("lemma").alias("lemmas"))
    rows = c.select("doc_id").join(arrays, "doc_id", "left").withColumn("lemmas", F.coalesce("lemmas", F.array().cast("array<string>")))
    return rows.select("doc_id", F.array_join(asp.tags_from_arrays("lemmas", dict(fx.ASPECT_SEEDS), fx.ASPECT_CLASSES[-1]), ",").alias("tags"))


def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write the scored batch as CSV to the shared folder and read it back."""
    path, rows = _folder(spark, "scored"), cached(scored(spark, sf))
    write_csv(_with_empty(rows.withColumn("text", _awkward())), path)
    return rd.read_scored_csv(spark, path)


def q_marked_csv(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1 as one file: the scored batch in order of doc_id, with mark and header, and read back."""
    folder, rows = _folder(spark, "marked"), scored(spark, sf).withColumn("text", _awkward())
    write_marked_csv(_with_empty(cached(rows)).orderBy("doc_id"), f"{folder}.csv")
    return rd.read_scored_csv(spark, f"{folder}.csv")


# ---------------------------------------------------------------- sources and sinks

def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _awkward():
    """Whole texts with what a CSV file can spoil: outer blanks, quotes, newlines, separators."""
    t, k = F.col("text"), F.pmod("doc_id", F.lit(8))
    return (F.when(k == 0, F.concat(F.lit("  "), t)).when(k == 1, F.concat(t, F.lit("  "))).when(k == 2, F.concat(F.lit('"'), t, F.lit('"')))
            .when(k == 3, F.concat(F.lit("\n"), t, F.lit("\n"))).when(k == 5, F.concat(F.lit(",;\t"), t)).otherwise(t))


def _with_empty(rows: DataFrame) -> DataFrame:
    """``rows`` and, under a doc_id of its own, a row with an empty text for each of every eighth of them."""
    more = rows.filter(F.pmod("doc_id", F.lit(8)) == 4).withColumn("doc_id", -1 - F.col("doc_id")).withColumn("text", F.lit(""))
    return rows.unionByName(more)


def q_reviews_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1, CHK-1: reviews with awkward texts, from CSV."""
    path = _folder(spark, "reviews")
    write_csv(_with_empty(fx.reviews(spark, sf).select("doc_id", _awkward().alias("text"))), path)
    return rd.read_reviews_csv(spark, path)


def q_reviews_by_place(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-2, JN-7: reviews from CSV files without an id column, numbered by their places. The files hold the documents in
    order of doc_id, null texts (one more row for each of every eighth document) among them."""
    path, docs = _folder(spark, "places"), fx.reviews(spark, sf).select("doc_id", _awkward().alias("text"))
    nulls = docs.filter(F.pmod("doc_id", F.lit(8)) == 5).withColumn("text", F.lit(None).cast("string"))
    write_csv(docs.unionByName(nulls).orderBy("doc_id").select(F.lit("x").alias("mark"), "text"), path)
    return rd.read_reviews_by_place(spark, path).select("doc_id", "text")


def q_corpus_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2: the labelled corpus, from CSV."""
    path = _folder(spark, "corpus")
    write_csv(fx.corpus(spark, sf), path)
    return rd.read_corpus_csv(spark, path)


def q_lexicon_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-3, AG-3, SNK-2, SRC-5: a lexicon of two files, the second's rows win; deduplicated, persisted, reloaded."""
    raw, folder = _raw_lexicon(spark, sf), _folder(spark, "lexicon")
    for pos in (0, 1):
        write_csv(raw.filter(F.col("pos") == pos).select("term", "tag", "value"), f"{folder}/{pos}", sep=";")
    write_parquet(dedup_lexicon(rd.read_lexicon_csv(spark, [f"{folder}/0", f"{folder}/1"])), f"{folder}/table")
    return rd.read_table(spark, f"{folder}/table")


def q_class_order_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-3: the languages, most documents first, as a persisted class order."""
    n = fx.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    path = _folder(spark, "classes")
    write_class_order(spark, [r["lang"] for r in n.orderBy(F.desc("n"), "lang").collect()], path)
    return spark.createDataFrame(list(enumerate(read_class_order(spark, path))), "class_pos int, class string")


QUERIES = {
    "rating_sentiment": q_rating_sentiment,
    "split_assignment": q_split_assignment,
    "class_counts": q_class_counts,
    "train_weights": q_train_weights,
    "clean_lemmas": q_clean_lemmas,
    "lemma_counts_by_class": q_lemma_counts_by_class,
    "candidate_terms": q_candidate_terms,
    "frequent_lemmas": q_frequent_lemmas,
    "aspect_dictionary": q_aspect_dictionary,
    "aspect_dictionary_full": q_aspect_dictionary_full,
    "learned_lemmas": q_learned_lemmas,
    "aspect_tags": q_aspect_tags,
    "aspect_multihot": q_aspect_multihot,
    "lexicon_table": q_lexicon_table,
    "lexicon_dedup": q_lexicon_dedup,
    "score_length": q_score_length,
    "score_diversity": q_score_diversity,
    "score_quality": q_score_quality,
    "score_emotion": q_score_emotion,
    "tfidf_vocabulary": q_tfidf_vocabulary,
    "frequent_vocabulary": q_frequent_vocabulary,
    "tfidf_weights": q_tfidf_weights,
    "similarity_score": q_similarity_score,
    "similarity_approximate": q_similarity_approximate,
    "similarity_recall": q_similarity_recall,
    "linear_head_scores": q_linear_head_scores,
    "trust_score": q_trust_score,
    "scored_batch": q_scored_batch,
    "single_review": q_single_review,
    "report_kpis": q_report_kpis,
    "aspect_mentions": q_aspect_mentions,
    "suspicious": q_suspicious,
    "detail": q_detail,
    "health_kpis": q_health_kpis,
    "map_scored": q_map_scored,
    "eval_metrics": q_eval_metrics,
    "train_models": q_train_models,
    "drawn_training_set": q_drawn_training_set,
    "newton_heads": q_newton_heads,
    "shown_trust": q_shown_trust,
    "aspect_overlap": q_aspect_overlap,
    "csv_roundtrip": q_csv_roundtrip,
    "marked_csv": q_marked_csv,
    "report": q_report,
    "model_selection": q_model_selection,
    "train_contract": q_train_contract,
    "reviews_csv_scan": q_reviews_csv_scan,
    "reviews_by_place": q_reviews_by_place,
    "corpus_csv_scan": q_corpus_csv_scan,
    "lexicon_roundtrip": q_lexicon_roundtrip,
    "class_order_roundtrip": q_class_order_roundtrip,
}
