"""Registered queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from small_tables import SF_SMALL

FAST = ["rating_sentiment", "split_assignment", "class_counts", "train_weights", "clean_lemmas", "candidate_terms",
        "aspect_dictionary", "aspect_tags", "aspect_multihot", "lexicon_dedup", "score_length",
        "score_diversity", "score_quality", "score_emotion", "tfidf_vocabulary", "similarity_score",
        "linear_head_scores", "map_scored", "scored_batch", "single_review", "report_kpis",
        "aspect_mentions", "health_kpis", "eval_metrics", "trust_score", "tfidf_weights", "lexicon_table",
        "lemma_counts_by_class", "detail", "suspicious", "csv_roundtrip", "marked_csv", "report", "reviews_csv_scan",
        "corpus_csv_scan", "aspect_dictionary_full", "learned_lemmas", "reviews_by_place", "drawn_training_set", "newton_heads", "shown_trust", "aspect_overlap", "lexicon_roundtrip", "class_order_roundtrip", "model_selection"]


def _con(sf):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.fixture
def con():
    # a fresh database per query: an internal error invalidates the connection
    return _con(SF_SMALL)


def _rows(df):
    cols = sorted(df.columns)
    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.to_dict("records")), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    sf = SF_SMALL
    try:
        want = _rows(con.execute(E.oracle_sql()[name]).df())
    except (duckdb.InternalException, duckdb.FatalException):
        # DuckDB 2.0 trips an internal assertion ("dict-surviving join") on a few of
        # these plans over the sf0.001 files only; the same SQL runs on sf0.01
        sf = "/root/testdata/sf0.01"
        want = _rows(_con(sf).execute(E.oracle_sql()[name]).df())
    got = _rows(E.queries()[name](spark, sf).toPandas())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total"] == 200
