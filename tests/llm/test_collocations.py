import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import SF, lower, no_docs, odd_docs

from trustlens.llm import collocations as co
from trustlens.llm.suffixes import equal_parts


def brute(docs, words=(2, 3), least=10, top=2000, held=(50, 100)):
    """{(lang, rank, phrase, a, l, r, n, score)} of (text, lang) rows."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words[1] + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if max(2, words[0]) <= len(p) and a >= least}
        gone = set()
        for p, a in cand.items():
            for m in range(2, len(p)):
                gone |= {s for s in (p[i:i + m] for i in range(len(p) - m + 1)) if held[1] * a >= held[0] * counts[s]}
        rows = []
        for p, a in cand.items():
            if p not in gone:
                cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                s, _, x, y = min(cuts)
                rows.append((-s, -a, " ".join(p).encode(), x, y))
        for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top]):
            out.add((lang, i + 1, p.decode(), -a, x, y, n[lang], -s))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus():
    return duckdb.sql(f"SELECT text, lang FROM '{SF}/documents.parquet'").fetchall()


def test_query_against_brute_force(spark):
    want = brute(corpus())
    assert want and got(co.op12_collocations(spark, SF)) == want


@pytest.mark.parametrize("words", [(2, 2), (2, 4), (3, 5)])
def test_other_lengths(spark, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(co.collocations(docs, words, least=4, top=300)) == brute(corpus(), words, 4, 300)


def test_hot_words_and_many_buckets(spark, monkeypatch):
    """All words hot and a bucket for each 2 KB, so that parts are counted in several buckets."""
    monkeypatch.setattr(co, "HOT", 1)
    monkeypatch.setattr(co, "SAMPLE", 2)
    monkeypatch.setattr(co, "BUCKET_BYTES", 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    assert got(co.collocations(docs)) == brute(corpus())


def test_odd_rows(spark):
    more = [(30 + i, "New York, new york! New York\tCity \x00 b c  d.e\n new york", lang) for i, lang in enumerate([None, "", "a b\nc", "en"] * 4)]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    want = brute([(r.text, r.lang) for r in docs.collect()], least=2)
    assert got(co.collocations(docs, least=2)) == want and {r[0] for r in want} >= {"und", "", "a b\nc", "en"}
    assert co.collocations(no_docs(spark)).count() == 0


def test_quicksort_against_counts():
    rng = np.random.default_rng(1)
    for n, top, least in ((5000, 30, 3), (3000, 400, 2), (1, 5, 1), (0, 5, 1)):
        s = np.minimum(rng.zipf(1.3, n + 2), top).astype(np.int64)
        columns, weights = np.stack([s[:n], s[1:n + 1], s[2:n + 2]]), rng.integers(1, 4, n)
        columns[2, ::7] = 0  # suffixes that end early
        seen = Counter()
        for pointer, places, size in equal_parts(columns, weights, np.zeros(n, np.int8), least):
            for at, k, c in zip(pointer, places, size, strict=True):
                seen[tuple(columns[:k, at])] += int(c)
        want = Counter()
        for i in range(n):
            for k in (1, 2, 3):
                if columns[k - 1, i]:
                    want[tuple(columns[:k, i])] += int(weights[i])
        assert seen == {k: v for k, v in want.items() if v >= least}


def test_packing_round_trip():
    import pyarrow as pa
    texts, langs = pa.array(["a b c a b", "", "x, y", "a b"], pa.large_binary()), pa.array(["en", None, "de", "en"], pa.large_binary()).fill_null(b"und")
    dictionary, columns, n = co.block_suffixes(texts, langs, 3)
    words, codes = co.unpacked(*co.packed(dictionary, columns, n))
    read = lambda d, c, n: Counter({tuple(d[x - 1].as_py() if x else None for x in own): int(k) for *own, k in zip(*c, n, strict=True)})
    assert read(dictionary, columns, n) == read(words, codes[:-1].astype(int), codes[-1])
    assert read(dictionary, columns, n)[b" en", b"a", b"b", None] == 2
