"""Aspect dictionary expansion and weak aspect labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens import fixed_values as fv
from trustlens.operators.broadcast import small_by_construction
from trustlens.session import cached


def lemma_counts(lemmas: DataFrame) -> DataFrame:
    """(doc_id, sentiment, pos, lemma) -> (doc_id, sentiment, lemma, n): what counting and tagging read."""
    return lemmas.groupBy("doc_id", "sentiment", "lemma").agg(F.count(F.lit(1)).alias("n"))


def lemma_counts_by_class(counts: DataFrame) -> DataFrame:
    """(doc_id, sentiment, lemma, n) -> (sentiment, lemma, n) for positive and negative only."""
    return (counts.filter(F.col("sentiment").isin("positive", "negative"))
            .groupBy("sentiment", "lemma").agg(F.sum("n").alias("n")))


def candidate_terms(counts: DataFrame, k: int = fv.CANDIDATE_POOL_SIZE) -> DataFrame:
    """The k lemmas most frequent over both classes; ties by lemma. (lemma, n)."""
    total = counts.groupBy("lemma").agg(F.sum("n").cast("long").alias("n"))
    return total.orderBy(F.desc("n"), F.asc("lemma")).limit(k)


def grams(term_col, most: int) -> F.Column:
    """The distinct runs of 0 to ``most`` characters of a term (null: none)."""
    term = F.col(term_col) if isinstance(term_col, str) else term_col
    n = F.length(term)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                 lambda p: F.transform(F.sequence(F.lit(0), F.least(F.lit(most), n - p + 1)),
                                                       lambda k: F.substring(term, p, k))))
    return F.array_distinct(runs)


def expand_aspects(seeds: DataFrame, candidates: DataFrame,
                   root_chars: int = fv.SEED_ROOT_CHARS) -> DataFrame:
    """Seeds plus every candidate that contains the first ``root_chars`` chars of a seed
    anywhere. (aspect_pos, aspect, term), distinct.

    A candidate's runs of up to ``root_chars`` characters meet the seeds' roots in an equi-join, so a pool of any
    size is matched without comparing it with each seed. A root that is shorter than ``root_chars`` is a run of
    its own length; an empty one is in every candidate; a null seed matches nothing.
    """
    roots = seeds.select("aspect_pos", "aspect", F.substring("seed", 1, root_chars).alias("gram"))
    runs = candidates.select(F.col("lemma").alias("term"), F.explode(grams("lemma", root_chars)).alias("gram"))
    matched = runs.join(roots, "gram").select("aspect_pos", "aspect", "term")
    own = seeds.select("aspect_pos", "aspect", F.col("seed").alias("term"))
    return own.unionByName(matched).distinct()


def tag_aspects(docs: DataFrame, lemmas: DataFrame, dictionary: DataFrame,
                other: str = fv.OTHER_ASPECT) -> DataFrame:
    """(doc_id, tags array<string>): aspects whose words meet the review's lemmas, in
    aspect order; ``[other]`` when none does."""
    dic = dictionary.select("aspect_pos", "aspect", F.col("term").alias("lemma"))
    hits = (lemmas.select("doc_id", "lemma").join(dic, "lemma")
            .groupBy("doc_id")
            .agg(F.array_sort(F.collect_set(F.struct("aspect_pos", "aspect"))).alias("a")))
    tags = F.transform(F.col("a"), lambda x: x["aspect"])
    return (docs.select("doc_id").join(hits, "doc_id", "left")
            .select("doc_id", F.when(F.col("a").isNull(), F.array(F.lit(other))).otherwise(tags)
                    .alias("tags")))


def multi_hot(tags_col, classes: list[str]):
    """array<string> tags -> array<int> in the fixed class order."""
    return F.array(*[F.array_contains(tags_col, c).cast("int") for c in classes])


def weak_aspect_labels(corpus: DataFrame, counts: DataFrame, seeds: DataFrame,
                       classes: list[str], other: str | None = None,
                       k: int = fv.CANDIDATE_POOL_SIZE) -> tuple[DataFrame, DataFrame]:
    """lemma counts per review (``lemma_counts``, read twice: cached) -> candidate pool -> expanded
    dictionary -> tags -> multi-hot labels.

    Returns (dictionary, labels) where labels is (doc_id, tags, aspect_labels).
    """
    other = other or classes[-1]
    counts = cached(counts)
    pool = small_by_construction(candidate_terms(lemma_counts_by_class(counts), k))
    dictionary = expand_aspects(seeds, pool)
    tags = tag_aspects(corpus, counts, dictionary, other)
    return dictionary, tags.withColumn("aspect_labels", multi_hot(F.col("tags"), classes))


def tags_from_arrays(lemmas_col, dictionary: dict[str, list[str]], other: str = fv.OTHER_ASPECT):
    """Array form of tagging for a small in-memory dictionary (aspect -> words, in aspect
    order): aspects whose word list overlaps the lemma array, else ``[other]``.

    For dictionaries that are tables, use ``tag_aspects`` (a broadcast join).
    """
    lem = F.col(lemmas_col) if isinstance(lemmas_col, str) else lemmas_col
    hits = F.array(*[F.when(F.arrays_overlap(lem, F.array(*[F.lit(w) for w in words])), F.lit(a))
                     for a, words in dictionary.items()])
    found = F.filter(hits, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))
