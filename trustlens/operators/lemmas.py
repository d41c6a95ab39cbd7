"""Lemma cleaning: tokens -> length/stop-word filter -> form->lemma join -> filter again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustlens import fixed_values as fv
from trustlens.functions.text import lemma_forms


def suffix_rules(form_lemma: DataFrame, most: int = 4, least: int = 1) -> DataFrame:
    """(suffix, ending, n): what a form's last 1 to ``most`` characters become in its lemma, learned from a form table.

    A pair teaches each suffix shorter than the form before which form and lemma agree. Of a suffix's endings the one
    that most forms take wins, ties to the smaller ending; one that fewer than ``least`` forms take is no rule. Nulls and
    repeated forms teach nothing more (one lemma per form, as the look-up has).
    """
    pairs = form_lemma.select("form", "lemma").dropna().dropDuplicates(["form"])
    cut = F.length("form") - F.col("k")
    taught = (pairs.select("form", "lemma", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
              .filter((cut > 0) & (F.length("lemma") >= cut) & F.expr("left(form, length(form) - k) = left(lemma, length(form) - k)"))
              .select(F.expr("right(form, k)").alias("suffix"), F.expr("substring(lemma, length(form) - k + 1)").alias("ending")))
    counts = taught.groupBy("suffix", "ending").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    first = F.row_number().over(Window.partitionBy("suffix").orderBy(F.desc("n"), "ending"))
    return counts.withColumn("_r", first).filter(F.col("_r") == 1).drop("_r")


def with_learned_lemmas(forms: DataFrame, rules: DataFrame, most: int = 4) -> DataFrame:
    """``forms`` (form, lemma, ...) where a null lemma is filled by the rule of the form's longest known suffix.

    One left equi-join for each suffix length, longest first: rows keep their number and order, nothing is
    exploded, and rules that fit ``spark.sql.autoBroadcastJoinThreshold`` move no token. A suffix is shorter than its form;
    a form without a rule keeps its null.
    """
    for k in range(most, 0, -1):
        of_length = rules.filter(F.length("suffix") == k).select(F.col("suffix").alias("_s"), F.col("ending").alias("_e"))
        open_ = F.when(F.col("lemma").isNull() & (F.length("form") > k), F.expr(f"right(form, {k})"))
        joined = forms.withColumn("_k", open_).join(of_length, F.col("_k") == F.col("_s"), "left")
        filled = F.concat(F.expr(f"left(form, length(form) - {k})"), F.col("_e"))
        forms = joined.withColumn("lemma", F.coalesce("lemma", filled)).drop("_k", "_s", "_e")
    return forms


def clean_lemmas(docs: DataFrame, stopwords: DataFrame, form_lemma: DataFrame, letters: str,
                 id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = fv.MIN_LEMMA_CHARS, carry: tuple = (), rules: DataFrame | None = None) -> DataFrame:
    """Long table (doc_id, *carry, pos, lemma): pos is the token's place in the cleaned text.

    Forms shorter than ``min_chars`` or in ``stopwords`` are dropped, the rest are
    mapped through ``form_lemma`` and filtered again. An unknown form keeps itself, or with ``rules``
    (``suffix_rules``) takes the lemma that they give.
    """
    stop = stopwords.select(F.col("token").alias("w")).distinct()
    lem = form_lemma.select("form", "lemma").dropDuplicates(["form"])
    forms = (docs.select(F.col(id_col).alias("doc_id"), *carry,
                         F.posexplode(lemma_forms(text_col, letters)).alias("pos", "form"))
             .filter(F.length("form") >= min_chars))
    forms = forms.join(stop, forms["form"] == stop["w"], "left_anti")
    known = forms.join(lem, "form", "left")
    out = ((known if rules is None else with_learned_lemmas(known, rules))
           .select("doc_id", *carry, "pos", F.coalesce(F.col("lemma"), F.col("form")).alias("lemma"))
           .filter(F.length("lemma") >= min_chars))
    return out.join(stop, out["lemma"] == stop["w"], "left_anti")
