"""The most frequent terms, exact, without a shuffle of the vocabulary.

Every task sums up its terms in a summary of bounded size: when it holds too many, the count of the first
one beyond the bound is taken from all, what is left of none is dropped, and the sum of what was taken is
kept as the summary's error. Summaries are merged by adding counts and errors. A term's total then
lies between its merged count and that plus the errors' sum, so a term of the ``size`` most frequent has a
count within the errors of the ``size``-th largest one: these candidates are counted again over
the whole input. Where the errors reach the ``size``-th count nothing is proven, and all terms are counted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens import fixed_values as fv
from trustlens.functions.text import term_counts, vector_tokens
from trustlens.operators.tfidf import doc_count, vocabulary_of
from trustlens.session import cached, ship_package

#: entries of a task's summary for each term that is wanted
SLOTS = 50
_SCHEMA = pa.schema([("term", pa.string()), ("n", pa.int64())])


def _sums(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum")])
    return pa.table([t["term"], t["n_sum"]], schema=_SCHEMA)


def _reduced(held: pa.Table, slots: int) -> tuple[pa.Table, int]:
    """At most ``slots`` entries, and what was taken from each."""
    if held.num_rows <= slots:
        return held, 0
    n = held["n"].to_numpy()
    at = n.argsort()[::-1]
    cut = int(n[at[slots]])
    keep = at[:slots][n[at[:slots]] > cut]
    return pa.table([held["term"].take(pa.array(keep)), pa.array(n[keep] - cut)], schema=_SCHEMA), cut


def _summary(slots: int):
    def run(batches):
        held, rows, error = [], 0, 0
        for batch in batches:
            held.append(pa.table(batch.columns, schema=_SCHEMA))
            rows += batch.num_rows
            if rows > 8 * slots:
                table, cut = _reduced(_sums(held), slots)
                held, rows, error = [table], table.num_rows, error + cut
        if held:
            table, cut = _reduced(_sums(held), slots)
            yield from table.to_batches()
            # the error's row has no term
            yield pa.RecordBatch.from_pylist([{"term": None, "n": error + cut}], schema=_SCHEMA)
    return run


def candidates(rows: DataFrame, size: int, slots: int | None = None) -> DataFrame | None:
    """(term) that may be among the ``size`` terms of largest sums of n, ties included, of ``rows`` (term string, n long > 0;
    rows without a term don't count); None where the summaries' errors prove nothing.

    One row (the errors and the ``size``-th count) meets the driver. The candidates are at most the entries of all summaries."""
    ship_package(rows.sparkSession)
    slots = SLOTS * size if slots is None else slots
    rows = rows.select(F.col("term").cast("string"), F.col("n").cast("long")).filter("term is not null")
    merged = cached(rows.mapInArrow(_summary(slots), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    seen = merged.filter("term is not null")
    top = seen.orderBy(F.desc("n")).limit(size).agg(F.count(F.lit(1)).alias("have"), F.min("n").alias("least"))
    r = top.select("have", "least", merged.filter("term is null").select(F.max("n")).scalar().alias("error")).first()
    error = r["error"] or 0
    if error and (r["have"] < size or r["least"] <= error):
        return None
    least = r["least"] if r["have"] == size else 0
    return seen.filter(F.col("n") + error >= (least or 0)).select("term")


def counted_again(rows: DataFrame, size: int, slots: int | None, *sums: F.Column) -> DataFrame:
    """(term, *sums) of the candidates among ``rows``, or of all terms where there is no proof."""
    some = candidates(rows, size, slots)
    own = rows.filter("term is not null") if some is None else rows.join(some, "term", "left_semi")
    return own.groupBy("term").agg(*sums)


def frequent_terms(rows: DataFrame, size: int, slots: int | None = None) -> DataFrame:
    """(term, n): the ``size`` terms of largest sums, ties by term, of ``rows`` (term, n)."""
    sums = counted_again(rows, size, slots, F.sum("n").cast("long").alias("n"))
    return sums.orderBy(F.desc("n"), F.asc("term")).limit(size)


def frequent_vocabulary(docs: DataFrame, size: int = fv.VOCABULARY_SIZE, text_col: str = "text", slots: int | None = None) -> DataFrame:
    """``tfidf.vocabulary`` of the reviews: (term, idx, cf, df, idf). A review's terms are counted in its row."""
    rows = (docs.select(F.explode(term_counts(vector_tokens(text_col))).alias("x"))
            .select("x.term", F.col("x.tf").cast("long").alias("n")))
    stats = counted_again(rows, size, slots, F.sum("n").cast("long").alias("cf"), F.count(F.lit(1)).alias("df"))
    return vocabulary_of(stats, doc_count(docs), size)
