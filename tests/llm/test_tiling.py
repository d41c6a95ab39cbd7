import random

import numpy as np
from helpers import SF, no_docs, odd_docs, texts

from trustlens.llm import tiling
from trustlens.llm.words import mix


def brute(text, item, least):
    """Greedy string tiling by the definition: the longest common run of free words, again and again."""
    a, b = [True] * len(text), [True] * len(item)
    total, lengths = 0, []
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while (i + n < len(text) and j + n < len(item) and a[i + n] and b[j + n] and text[i + n] == item[j + n]):
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least:
            return lengths
        lengths.append(n)
        for k in range(n):
            a[i + k] = b[j + k] = False


def test_tiles_against_the_definition():
    rng = random.Random(2)
    for turn in range(150):
        letters = rng.choice([2, 3, 30])
        item = [rng.randrange(1, letters + 1) for _ in range(rng.randrange(3, 40))]
        parts = [item[i:i + 9] for i in range(0, len(item), 9)]
        rng.shuffle(parts)
        text = [x for p in parts for x in [*p, *[rng.randrange(1, letters + 1) for _ in range(rng.randrange(3))]]]
        x, y = (mix(np.array(v, np.uint64)) for v in (text, item))
        got = tiling.tiles(x, y, 3)
        ta, tb = np.zeros(len(x), int), np.zeros(len(y), int)
        for i, j, n in got:
            assert n >= 3 and (x[i:i + n] == y[j:j + n]).all()
            ta[i:i + n] += 1
            tb[j:j + n] += 1
        assert ta.max(initial=0) <= 1 and tb.max(initial=0) <= 1
        want = brute(text, item, 3)
        if letters == 30:  # no ties to speak of
            assert sorted(n for *_, n in got) == sorted(want)
        else:
            assert max((n for *_, n in got), default=0) == max(want, default=0)
        # nothing long enough is left
        left = np.where(ta == 0, x, 0)
        rest = np.where(tb == 0, y, 0)
        assert not any((left[i:i + 3] != 0).all() and (left[i:i + 3] == rest[j:j + 3]).all()
                       for i in range(len(x) - 2) for j in range(len(y) - 2))


def test_seeds_only_drop_what_cannot_match(spark):
    """The stretches that seeds cover give the same tiles as whole texts."""
    import duckdb
    import pyarrow as pa
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = sorted(texts().items())

    def tokens(col):
        return [h[bounds[i]:bounds[i + 1]] for a, b, bounds, h in tiling._tokens(pa.array(col)) for i in range(b - a)]

    want = {}
    words, own = tokens([t for _, t in docs]), tokens([t for _, t in items])
    for (i, _), y in zip(items, own, strict=True):
        known = set(y.tolist())
        for (d, _), x in zip(docs, words, strict=True):
            if sum(w in known for w in x.tolist()) < 5 or len(y) < tiling.SEED:
                continue
            got = sum(n for *_, n in tiling.tiles(x, y))
            if got >= tiling.COVERAGE * len(y):
                want[d, i] = got
    rows = tiling.op1_decontaminate(spark, SF).collect()
    assert {(r.doc_id, r.item_id): r.tiled_words for r in rows} == want and len(rows) == len(want)


def test_reordered_passages_and_odd_rows(spark):
    item = [f"q{i}" for i in range(40)]
    bench = [(1, " ".join(item), 5), (2, None, 5), (3, "", 5), (4, "the of", 5), (1, " ".join(item), 5)]
    shuffled = item[30:] + ["x"] * 3 + item[:10] + ["y"] + item[10:20] + ["z"] + item[20:30]
    docs = [(1, " ".join(shuffled)), (2, " ".join(item[:20])), (3, " ".join(item).upper() + "."), (4, None), (5, " ".join(item[::-1])),
            (1, " ".join(shuffled)), (None, " ".join(["pre"] * 50_000 + item))]
    d = spark.createDataFrame([(a, b, 0, 0) for a, b in docs], "doc_id long, text string, row long, item long")
    b = spark.createDataFrame(bench, "item_id long, text string, words long")
    got = sorted(((r.doc_id, r.item_id, r.tiled_words, r.n_tiles) for r in tiling.contaminated(d, b).collect()), key=repr)
    assert got == sorted([(1, 1, 40, 4), (1, 1, 40, 4), (3, 1, 40, 1), (None, 1, 40, 1)], key=repr)
    assert tiling.contaminated(no_docs(spark), b).count() == 0
    assert tiling.contaminated(d, b.limit(0)).count() == 0
    assert tiling.contaminated(odd_docs(spark), b).count() == 0
