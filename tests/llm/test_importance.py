import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
from helpers import SF, lower, no_docs, odd_docs

from trustlens.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, size):
    w = WORD.findall(lower(text))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % im.BUCKETS for k in range(1, size + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, size=1, least=20, share=10):
    """[(doc_id, n_words, n_features, weight, score, rank)] in the order of ``docs``."""
    own = [features(t, size) for _, t in docs]
    s, t = (Counter(f for x in rows for f in x) for rows in ([f for _, f in own], [features(x, size)[1] for x in target]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for (d, _), (n, f) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((i for i, r in enumerate(rows) if r[1] >= least), key=lambda i: (-rows[i][4], rows[i][0] is not None, rows[i][0] or 0))
    rank = {i: k + 1 for k, i in enumerate(fit[:share * len(fit) // 100])}
    return [(*r, rank.get(i)) for i, r in enumerate(rows)]


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def tables():
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    return docs, [t for t, in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]


def test_query_against_brute_force(spark):
    docs, target = tables()
    want = {r[0]: r[2:] for r in brute(docs, target)}
    rows = im.op11_importance(spark, SF).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in rows} == want and len(rows) == len(want)
    ranks = sorted(r["rank"] for r in rows if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_longer_features_cross_lines(spark):
    docs, target = tables()
    docs = docs[:60] + [(1000 + i, "one two\nthree\n\nfour five six\none two\n" * 3) for i in range(5)]
    read = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    for size in (2, 3):
        assert got(im.importance_draw(*read, size=size)) == Counter(brute(docs, target, size))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    target = spark.createDataFrame([("The quick brown fox", 1), (None, 2), ("", 3)], "text string, weight long")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], least=5, share=50)
    assert got(im.importance_draw(docs, target, least_words=5, per_cent=50)) == Counter(want)
    assert im.importance_draw(no_docs(spark), target).count() == 0
    none = target.limit(0)
    assert got(im.importance_draw(docs, none)) == Counter(brute([(r.doc_id, r.text) for r in docs.collect()], []))


def test_distinct_lines_once(spark):
    docs = spark.createDataFrame([(i, "a shared line\nline %d" % (i % 7)) for i in range(100)], "doc_id long, text string")
    lines = im.line_table(docs).collect()
    assert sorted(r.n for r in lines) == sorted([100] + [len(range(k, 100, 7)) for k in range(7)])
