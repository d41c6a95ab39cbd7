from collections import Counter

import numpy as np
from helpers import SF, WORD, no_docs, odd_docs, texts, words

from trustlens.llm import quality_mcd as q


def brute(text):
    w, text = words(text), text or ""
    seen, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics(spark):
    rows = q.op5_quality(spark, SF).collect()
    want = texts()
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(want[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    want = sorted((repr((r.doc_id, *brute(r.text))) for r in docs.collect()))
    got = q.judged(docs, "doc_id").collect()
    assert sorted(repr((r.doc_id, *(r[c] for c in COLUMNS))) for r in got) == want
    assert {r.kept for r in got if r.doc_id == 8} == {True}  # too few documents to judge by
    assert q.judged(no_docs(spark), "doc_id").count() == 0


def test_estimates_against_numpy(spark):
    """Concentration steps by hand on one group with planted outliers."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, [0.1, 0.5, 0.2, 0.3], (900, 4)) @ np.array([[1, .2, 0, 0], [0, 1, .1, 0], [0, 0, 1, .3], [0, 0, 0, 1]])
    x[:120] += [2, 4, 0, 3]
    df = spark.createDataFrame([("g", *map(float, v)) for v in x], ["g", *q.NAMES])
    far = {r.i: r.distance2 for r in q.with_distance(df.withColumn("i", q.F.col(q.NAMES[0])), q.estimate(df)).collect()}
    floor = np.diag([q.FLOOR[n] ** 2 for n in q.NAMES])
    d = (((x - np.median(x, 0)) ** 2) / ((1.4826 * np.median(abs(x - np.median(x, 0)), 0)) ** 2 + np.diag(floor))).sum(1)

    def distances(near, share):
        m, s = x[near].mean(0), np.cov(x[near].T, bias=True) * q.consistency(share) + floor
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)

    for _ in range(q.STEPS):
        d = distances(d <= np.sort(d)[int(np.ceil(q.SUBSET * len(d))) - 1], q.SUBSET)
    d = distances(d <= 11.143, 0.975)
    got = np.array([far[v] for v in x[:, 0]])
    assert np.allclose(got, d, rtol=0.02)
    assert (got[:120] > q.CUT).all() and (got[120:] < q.CUT).all()


def test_junk_goes_and_prose_stays(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(2000)]
    docs = []
    for i in range(400):
        w = list(rng.choice(vocabulary, rng.integers(60, 600)))
        if i % 20 == 0:
            w = [f"{x}%%%" for x in w]
        elif i % 20 == 1:
            w = [x for v in w for x in (v, "|")]
        docs.append((i, "\n".join(" ".join(w[k:k + 12]) for k in range(0, len(w), 12)), "en" if i % 3 else None, "s"))
    rows = q.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), "doc_id").collect()
    assert all(r.kept == (r.doc_id % 20 > 1) for r in rows)


def test_planted_repeats_and_light_symbols_go(spark):
    rng = np.random.default_rng(10)
    text = lambda w, k=12: "\n".join(" ".join(w[i:i + k]) for i in range(0, len(w), k))
    docs = []
    for i in range(600):
        w = [f"{''.join(rng.choice(list('abcdefgh'), rng.integers(3, 8)))}" for _ in range(rng.integers(150, 400))]
        if i % 60 == 0:  # 46 % of the words in repeated windows
            n = len(w) * 30 // 100
            w, kind = w + w[:n], "windows"
        elif i % 60 == 1:  # two lines of three are copies of two words; long lines hold most of the words
            lines = [f"{w[0]} {w[1]}"] * 22 + [" ".join(w[2 + 10 * k:12 + 10 * k]) for k in range(10)]
            docs.append((i, "\n".join(lines), "en", "lines"))
            continue
        elif i % 60 == 2:  # one symbol in fifty characters
            w, kind = [x + "#" * (k % 9 == 0) for k, x in enumerate(w)], "symbols"
        else:
            kind = None
        docs.append((i, text(w), "en", kind))
    rows = q.judged(spark.createDataFrame([(d, t, lang, "s") for d, t, lang, _ in docs], "doc_id long, text string, lang string, source string"), "doc_id").collect()
    kinds = {d: k for d, _, _, k in docs}
    assert not any(r.kept for r in rows if kinds[r.doc_id] and not r.base_failed)
    assert {kinds[r.doc_id] for r in rows if not r.base_failed} == {None, "windows", "lines", "symbols"}
    assert sum(not r.kept for r in rows if kinds[r.doc_id] is None) <= 2


def test_a_small_pool_is_held_against_all(spark):
    """Rare languages, too few altogether for an estimate of their own: junk goes, prose stays."""
    rng = np.random.default_rng(11)
    docs = []
    for i in range(430):
        w = [f"{''.join(rng.choice(list('abcdefgh'), rng.integers(3, 8)))}" for _ in range(rng.integers(100, 300))]
        lang = "en" if i < 400 else f"rare{i % 3}"
        if i >= 400 and i % 10 == 0:
            w = [f"{x}%%%" for x in w]
        docs.append((i, "\n".join(" ".join(w[k:k + 12]) for k in range(0, len(w), 12)), lang, "s"))
    rows = q.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), "doc_id").collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert [kept[d] for d in (400, 410, 420)] == [False] * 3
    assert sum(not kept[d] for d in kept if d < 400 or d % 10) <= 2
