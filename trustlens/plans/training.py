"""Prepare and train (JOB-5): lexicon, weak aspect labels, split, weights, candidate
models, validation, best-model choice, and the persisted artefacts."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.functions.text import Alphabets, DEFAULT_ALPHABETS
from trustlens.operators import models as M
from trustlens.operators.aspects import lemma_counts, weak_aspect_labels
from trustlens.operators.corpus import assign_split, polar, with_class_weight, with_sentiment
from trustlens.operators.lemmas import clean_lemmas
from trustlens.operators.lexicon import dedup_lexicon
from trustlens.sources.writers import write_class_order, write_parquet


@dataclass
class Trained:
    """The chosen model, its folder, the candidates' figures, and the prepared rows."""
    model: object
    metrics: DataFrame
    rows: DataFrame
    path: str


def evaluate(model, rows: DataFrame, classes: list[str]) -> dict:
    """Validation figures of one model on labelled rows (label, aspect_labels)."""
    return M.evaluation_table(predictions(model, rows, classes), len(classes)).first().asDict()


def predictions(model, rows: DataFrame, classes: list[str]) -> DataFrame:
    """Predictions of one model beside the labels of the rows."""
    pred = M.predict(model, rows, classes, carry=("label", "aspect_labels"))
    return pred.withColumn("pred", (F.col("sentiment") == "positive").cast("int"))


def prepare(corpus: DataFrame, stopwords: DataFrame, form_lemma: DataFrame, seeds: DataFrame,
            classes: list[str], language: str | None, alphabets: Alphabets) -> DataFrame:
    """Polar, labelled, split rows: (doc_id, text, label, aspect_labels, split)."""
    c = with_sentiment(corpus, language)
    lem = clean_lemmas(c, stopwords, form_lemma, alphabets.lemma, carry=("sentiment",))
    _, tags = weak_aspect_labels(c, lemma_counts(lem), seeds, classes)
    data = polar(c).select("doc_id", "text", "label").join(tags, "doc_id")
    return assign_split(data)


def train(corpus: DataFrame, lexicon_raw: DataFrame | None, stopwords: DataFrame,
          form_lemma: DataFrame, seeds: DataFrame, classes: list[str], out_dir: str,
          language: str | None = None, alphabets: Alphabets = DEFAULT_ALPHABETS,
          cfg: M.TrainConfig | None = None) -> "Trained":
    """Train candidate models, keep the best by validation F1 of the positive class.

    Writes ``lexicon`` (deduplicated), ``classes`` (label order) and ``model`` under
    ``out_dir`` (a shared folder).
    """
    spark = corpus.sparkSession
    cfg = cfg or M.TrainConfig(letters=alphabets.score)
    if lexicon_raw is not None:
        write_parquet(dedup_lexicon(lexicon_raw), os.path.join(out_dir, "lexicon"))
    write_class_order(spark, classes, os.path.join(out_dir, "classes"))
    data = prepare(corpus, stopwords, form_lemma, seeds, classes, language, alphabets)
    # cut the lineage of the prepared rows: the candidates below all re-read them
    data = data.checkpoint()
    train_rows = with_class_weight(data.filter(F.col("split") == "train")).persist()
    val_rows = data.filter(F.col("split") == "validation").persist()
    feats = M.featurizer(cfg.letters, cfg.num_features).fit(train_rows)
    ft = M.featurize(feats, train_rows, len(classes)).persist()
    # the choice is made on sentiment F1 only, so the aspect heads are shared
    aspect_heads = M.fit_aspect_heads(ft, len(classes), cfg.aspect_reg, cfg)
    sentiment_heads = M.fit_all([M._sentiment_lr(reg, cfg) for reg in cfg.reg_params], ft, cfg.parallelism)
    results, cands = [], []
    for reg, head in zip(cfg.reg_params, sentiment_heads):
        model = M.assemble(feats, head, aspect_heads)
        m = evaluate(model, val_rows, classes)
        cands.append((reg, model, m["f1_positive"]))
        results.append(dict(reg_param=float(reg), **m))
    best_reg, best_model, _ = M.select_best(cands)
    path = os.path.join(out_dir, "model")
    M.save_model(best_model, path)
    reloaded = evaluate(M.load_model(path), val_rows, classes)
    names = ["n", "tp", "fp", "fn", "tn", "f1_positive", "f1_negative", "accuracy", "aspect_micro_f1"]
    rows = [(r["reg_param"], *(r[c] for c in names), r["reg_param"] == best_reg,
             reloaded["f1_positive"] if r["reg_param"] == best_reg else None) for r in results]
    kinds = ["long"] * 5 + ["double"] * 4
    metrics = spark.createDataFrame(rows, "reg_param double, " + ", ".join(f"{c} {k}" for c, k in zip(names, kinds))
                                    + ", chosen boolean, reloaded_f1_positive double")
    ft.unpersist()
    train_rows.unpersist()
    return Trained(best_model, metrics, data, path)
