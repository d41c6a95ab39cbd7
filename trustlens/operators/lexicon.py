"""Lexicon tables and the emotion signal (lexicon join + per-review statistics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.functions.text import letter_tokens


def dedup_lexicon(raw: DataFrame) -> DataFrame:
    """(pos, term, tag, value) -> (term, tag, value); the row with the highest pos wins."""
    best = F.max_by(F.struct("tag", "value"), "pos")
    return (raw.groupBy("term").agg(best.alias("b"))
            .select("term", F.col("b.tag").alias("tag"), F.col("b.value").alias("value")))


def one_value_per_term(lexicon: DataFrame) -> DataFrame:
    """(term, value) with each term once: of repeated rows the last by ``pos``, or without that
    column the largest value."""
    if "pos" in lexicon.columns:
        return dedup_lexicon(lexicon).select("term", "value")
    return lexicon.groupBy("term").agg(F.max("value").alias("value"))


def emotion_stats(docs: DataFrame, lexicon: DataFrame, letters: str,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per review with at least one hit: hits, mean and population std of the values.

    Every token occurrence counts (raw lower-case forms). Tokens of one review sit in one
    partition, so the partial aggregate leaves one row per review before the shuffle.
    """
    lex = one_value_per_term(lexicon)
    toks = docs.select(F.col(id_col).alias("doc_id"),
                       F.explode(letter_tokens(text_col, letters)).alias("term"))
    return (toks.join(lex, "term")
            .groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("hits"), F.avg("value").alias("mean"),
                 F.stddev_pop("value").alias("std")))


def lexicon_from_labels(docs: DataFrame, labels: DataFrame, letters: str,
                        min_docs: int = 5) -> DataFrame:
    """Build a lexicon from quality labels: for each term, p / n = labelled documents of
    quality 1 / 0 that contain it; keep p + n >= min_docs;
    value = (p/P - n/N) / (p/P + n/N) with P, N the class sizes; tag = sign of value.
    """
    lab = (docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
           .join(labels.select("doc_id", "quality"), "doc_id"))
    # class sizes as scalar subqueries: no driver round trip
    P = lab.select(F.count_if(F.col("quality") == 1)).scalar()
    N = lab.select(F.count_if(F.col("quality") == 0)).scalar()
    terms = (lab.select("doc_id", "quality",
                        F.explode(F.array_distinct(letter_tokens("text", letters))).alias("term")))
    counts = (terms.groupBy("term")
              .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("p"),
                   F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("n"))
              .filter(F.col("p") + F.col("n") >= min_docs))
    pr, nr = F.col("p") / P, F.col("n") / N
    # a class without documents gives no lexicon (the ratio is undefined)
    value = F.when((P > 0) & (N > 0), (pr - nr) / (pr + nr))
    counts = counts.filter((P > 0) & (N > 0))
    return counts.select(
        F.lit(0).cast("long").alias("pos"), "term",
        F.when(value > 0, "PSTV").when(value < 0, "NGTV").otherwise("NEUT").alias("tag"),
        value.alias("value"))
