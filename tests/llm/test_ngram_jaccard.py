import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, no_docs, odd_docs, shingle_set, texts

from trustlens.llm import ngram_jaccard as j
from trustlens.llm.components import components


def brute(docs):
    """Component by row of [(doc_id, text)]."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inside = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(k for e in s for k in inside[e])
        for k, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[k]) - n):
                parent[find(i)] = find(k)
        for e in s:
            inside[e].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)]


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_documents(spark):
    got = rows(j.op6_ngram_jaccard(spark, SF))
    assert got == sorted(brute(sorted(texts().items())), key=repr)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = rows(j.ngram_components(docs))
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    assert rows(j.ngram_components(no_docs(spark))) == []


def test_near_copies_of_all_sizes(spark):
    rng = random.Random(3)
    docs = []
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 18, 25, 40, 70, 130, 400]:
        for _ in range(6):
            first = [f"{rng.randrange(10**6)}" for _ in range(size + 4)]
            for _ in range(5):
                w = list(first)
                for _ in range(rng.randrange(1 + len(w) // 25 + 1)):
                    w[rng.randrange(len(w))] = f"{rng.randrange(10**6)}"
                if rng.random() < 0.5:
                    w = w[:len(w) - rng.randrange(1 + len(w) // 8)]
                docs.append((len(docs), " ".join(w)))
    w = [f"v{i}" for i in range(60)]  # and a chain: each is near the next only
    docs += [(len(docs) + i, " ".join(w[i:] + [f"n{k}" for k in range(i)])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(j.ngram_components(df)) == sorted(brute(docs), key=repr)


@pytest.mark.parametrize("frequent", [10**9, 7, 2, 1])
def test_similar_sets_share_a_signature(frequent):
    """Whatever shingles count as frequent."""
    rng = np.random.default_rng(5)
    for size in [4, 5, 6, 8, 9, 11, 13, 17, 21, 30, 55, 120, 500, 3000]:
        for _ in range(30):
            common = rng.integers(0, 2**63, size, dtype=np.uint64)
            # as far apart as the threshold allows
            own = [rng.integers(0, 2**63, int(size * 0.25 * f), dtype=np.uint64) for f in ((1, 0), (0.5, 0.5), (0.2, 0.8))[rng.integers(3)]]
            x, y = (np.unique(np.concatenate([common, o])) for o in own)
            if 100 * size < 80 * (len(x) + len(y) - size) or len(x) == len(y) == size:
                continue
            sigs = [set(np.concatenate([np.concatenate(g) for i in (b, b + 1) if (g := j.signatures(j.Parts(s, s[s % np.uint64(frequent) > 0]), i, 80, 100))] or [[0]]).tolist())
                    for s in (x, y) for b in [j.band_of(len(s))]]
            assert sigs[0] & sigs[1]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (7, 6), (3, 7), (None, 9), (1, 2)], "a long, b long")
    assert {r.node: r.root for r in components(e, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 6: 1, 4: 4, 5: 4}
    assert components(e.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("block", [4000, 40])
def test_a_common_passage_and_a_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j, "STARS", 2 if block == 40 else 1)
    rng = random.Random(9)
    new = lambda n: [f"{rng.randrange(10**7)}" for _ in range(n)]
    passage, first, docs = new(60), new(120), []
    for i in range(1200):
        if i % 3 == 0:
            docs.append((i, " ".join(new(rng.randrange(5, 120)) + passage + new(rng.randrange(5, 60)))))
        elif i % 3 == 1:
            w = list(first)
            for _ in range(rng.randrange(9)):
                w[rng.randrange(len(w))] = new(1)[0]
            docs.append((i, " ".join(w)))
        else:
            docs.append((i, " ".join(passage + new(rng.randrange(0, 12)))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(j.ngram_components(df)) == sorted(brute(docs), key=repr)


def test_pieces_with_more_pairs_than_rows():
    """Chains of near sets among sets just below the threshold: a piece gives its key instead of its pairs, and verified in
    the task it gives links that join exactly the components of all links."""
    rng = np.random.default_rng(5)
    core = rng.integers(1, 2**63, 160, np.uint64)
    sets = []
    for chain in range(12):
        own = rng.integers(1, 2**63, 60, np.uint64)
        for step in range(4):  # neighbours share all but a few shingles, ends of a chain fewer
            sets.append(np.unique(np.concatenate([core, own[5 * step:5 * step + 25]])))
    ids = [j.set_id(s) for s in sets]
    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    rows = [(7, i, i, len(s), len(s), j.histogram(s).tobytes(), 0, 0, 0, s.tobytes()) for i, s in zip(ids, sets, strict=True)]
    names = ["sig", "set_id", "root", "n", "common", "counts", "block", "i", "j", "elements"]
    kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.int32()] * 3 + [pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)
               for part in (rows[:20], rows[20:])]
    found = [r for b in j._left_pairs(80, 100)(iter(batches)) for r in b.to_pylist()]
    assert {(r["b"], r["sig"], r["i"], r["j"]) for r in found} == {(None, 7, 0, 0)} and len({r["a"] for r in found}) == len(found)
    partners = {i for x, y in ((x, y) for x in range(len(sets)) for y in range(x) if linked(sets[x], sets[y])) for i in (ids[x], ids[y])}
    assert partners <= {r["a"] for r in found}
    links = [(r["a"], r["b"]) for b in j._joined(80, 100)(iter(batches)) for r in b.to_pylist()]
    assert len(links) < len(rows)

    def components(edges):
        root = {i: i for i in ids}
        for a, b in edges:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
        return {frozenset(k for k in ids if root[k] == v) for v in root.values()}
    every = [(ids[x], ids[y]) for x in range(len(sets)) for y in range(x) if linked(sets[x], sets[y])]
    assert components(links) == components(every) and len(components(every)) < len(ids)
