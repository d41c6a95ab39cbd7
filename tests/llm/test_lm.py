import math
from collections import Counter

import numpy as np
from helpers import SF, held_out, lower, no_docs, odd_docs, texts, words

from trustlens.llm import lm
from trustlens.llm.subwords import default_path

SF01 = "/root/testdata/sf0.01"


def base(docs):
    counts = Counter()
    for d, t in docs:
        if not held_out(d):
            counts.update([*words(lower(t)), None])
    total, distinct = sum(counts.values()), len(counts)
    return [(d, held_out(d), len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w))
            for d, t in docs for w in [[*words(lower(t)), None]]]


def check(rows, docs):
    want = sorted(base(docs), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=repr)
    key = lambda r: (repr(r[0]), r[1:4], round(r[5], 3))
    for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_documents(spark):
    check(lm.op2_lm_scores(spark, SF).collect(), sorted(texts().items()))


def test_blocks_of_any_size_and_odd_rows(spark):
    docs = odd_docs(spark)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    for block in (1, 1000, 10**9):
        check(lm.score_documents(docs, default_path(), block).collect(), pairs)
    assert lm.score_documents(no_docs(spark), default_path()).count() == 0


def test_better_than_unigrams_on_held_out_text(spark):
    rows = [r for r in lm.op2_lm_scores(spark, SF01).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_every_training_document_reaches_the_model(spark):
    """Enough documents that a share of them would do, none of them drawn by an even number."""
    docs = [(f"word{i % 50} has number {i}", (i << 10) | 1) for i in range(4200)]
    flat, vocabulary = lm.train(spark.createDataFrame(docs, "text string, draw long").repartition(3), default_path())
    encoder = lm.Encoder.of(default_path())
    counts = np.zeros(encoder.size, np.int64)
    for _, _, ids, _ in encoder.documents(lm.pa.array([t for t, _ in docs])):
        counts += np.bincount(ids, minlength=encoder.size)
    want = lm.Vocabulary(counts)
    assert (vocabulary.rank == want.rank).all() and np.allclose(vocabulary.mass, want.mass)
    assert (flat != lm.initial(want)).any()


def test_a_trainer_goes_through_all_of_its_text(monkeypatch):
    monkeypatch.setattr(lm, "TRAINER_BYTES", 4000)
    texts = [f"text {i} " * (i % 40) for i in range(200)]
    encoder, value = lm.Encoder.of(default_path()), lambda v: type("Sent", (), {"value": v})
    tokens = sum(len(ids) for _, _, ids, _ in encoder.documents(lm.pa.array(texts)))
    vocabulary = lm.Vocabulary(np.ones(encoder.size, np.int64))
    batches = lm.pa.table({"text": texts}).to_batches(max_chunksize=9)
    assert len(list(lm._text_pieces(encoder, batches, vocabulary))) > 3
    out, = lm._trained(default_path(), value(lm.initial(vocabulary)), value(vocabulary), 20_000.0)(iter(batches))
    assert out["w"].to_pylist() == [tokens] * lm.PARAMETERS


def setup():
    rng = np.random.default_rng(2)
    vocabulary = lm.Vocabulary(rng.integers(0, 1000, 5000))
    flat = lm.initial(vocabulary)
    flat += rng.normal(0, 0.2, len(flat)).astype(np.float32)
    return rng, vocabulary, flat


def one_by_one(flat, vocabulary, ids):
    """Log probability of a text's ids, each scored alone from its window, in float64."""
    p = {k: v.astype(float) for k, v in lm.split(flat).items()}
    x = [lm.START, *vocabulary.input[ids[:-1]]]
    fresh, total = lm.CONTEXT - lm.OVERLAP, 0.0
    for t, y in enumerate(ids):
        turn = 0 if t < lm.CONTEXT else 1 + (t - lm.CONTEXT) // fresh
        start = turn * fresh
        e = np.array([p["embed"][x[i]] + p["place"][i - start] for i in range(start, t + 1)])
        q, k, v = e[-1] @ p["query"], e @ p["key"], e @ p["value"]
        a = np.exp(k @ q / math.sqrt(lm.WIDTH))
        h = e[-1] + (a / a.sum()) @ v @ p["out"]
        h = np.append(h, 1)
        z, y = h @ p["head"], int(y)
        g = vocabulary.group[y]
        total += z[g] - math.log(np.exp(z).sum()) + vocabulary.within[y]
        if g < len(vocabulary.first) - 2:
            z = h @ p["inner"][:, vocabulary.first[g]:vocabulary.first[g + 1]]
            total += z[vocabulary.rank[y] - vocabulary.first[g]] - math.log(np.exp(z).sum())
    return total


def test_scores_of_windows_against_one_by_one():
    rng, vocabulary, flat = setup()
    lens = np.array([1, 0, 5, 31, 32, 33, 56, 57, 100, 300])
    ids = rng.integers(0, 5000, lens.sum())
    bounds = np.concatenate([[0], np.cumsum(lens)])
    got = lm.Scorer(flat, vocabulary, windows=4, batches=3).documents(ids, bounds)
    for i, n in enumerate(lens):
        want = one_by_one(flat, vocabulary, ids[bounds[i]:bounds[i + 1]]) if n else 0.0
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-4)


def test_probabilities_sum_to_one():
    _, vocabulary, flat = setup()
    n = len(vocabulary.rank)
    ids = np.stack([np.full(n, 17), np.full(n, 4), np.arange(n)], 1).ravel()
    scorer = lm.Scorer(flat, vocabulary)
    three = scorer.documents(ids, np.arange(0, 3 * n + 1, 3))
    two = scorer.documents(np.array([17, 4]), np.array([0, 2]))
    assert math.isclose(np.exp(three - two[0]).sum(), 1, rel_tol=1e-3)


def test_gradient():
    rng, vocabulary, flat = setup()
    x, ids = rng.integers(0, lm.INPUTS, (3, lm.CONTEXT)), rng.integers(0, 5000, (3, lm.CONTEXT))
    y, r = vocabulary.group[ids], vocabulary.rank[ids]
    live = rng.random((3, lm.CONTEXT)) < 0.8
    grad = np.zeros(lm.PARAMETERS)
    flat = flat.astype(float)
    loss = lambda f, g: lm.step(lm.split(f), vocabulary.first, x, y, r, live, lm.split(g))
    loss(flat, grad)
    used = np.flatnonzero(abs(grad) > 1e-5)
    for i in rng.choice(used, 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-3
        down[i] -= 1e-3
        numeric = (loss(up, np.zeros(lm.PARAMETERS)) - loss(down, np.zeros(lm.PARAMETERS))) / 2e-3
        assert abs(numeric - grad[i]) < 2e-5 + 0.05 * abs(grad[i])


def test_only_a_trainer_with_little_text_goes_over_it_again(monkeypatch):
    monkeypatch.setattr(lm, "TRAINER_BYTES", 4000)
    monkeypatch.setattr(lm, "STEPS", 5)
    texts = [f"text {i} " * (i % 40) for i in range(200)]
    value, seen, own = lambda v: type("Sent", (), {"value": v}), [], lm.step
    vocabulary = lm.Vocabulary(np.ones(lm.Encoder.of(default_path()).size, np.int64))
    batches = lm.pa.table({"text": texts}).to_batches(max_chunksize=9)
    windows = [len(x) for (x, *_), _ in lm._text_pieces(lm.Encoder.of(default_path()), batches, vocabulary)]
    monkeypatch.setattr(lm, "step", lambda p, first, x, *more: seen.append(len(x)) or own(p, first, x, *more))
    run = lambda some: list(lm._trained(default_path(), value(lm.initial(vocabulary)), value(vocabulary),
                                        float(sum(b.column("text").nbytes for b in some)))(iter(some)))
    run(batches)
    assert sum(seen) == sum(windows)
    seen.clear()
    run(batches[:1])
    assert len(seen) >= lm.STEPS


def test_slices_hold_all_ids_of_their_round(spark):
    texts = ["", "one", None, "two words " * 90, "öäü!!", "x" * 700] * 5
    rows = [(i, t, i % 4 == 3, i % lm.ROUNDS) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, turn int").repartition(3)
    parts = lm.encoded(df, default_path(), 40)
    blocks = {r.block: r.doc_ids for r in parts.filter("ids is null").collect()}
    encoder, got = lm.Encoder.of(default_path()), {}
    for batch in parts.filter("ids is not null").toArrow().to_batches():
        for turn in (None, *range(lm.ROUNDS)):
            for i in range(batch.num_rows):
                for ids, bounds, size in lm._slices(None, batch.slice(i, 1), turn):
                    whole = turn is None
                    place = batch.column("first")[i].as_py()
                    names = blocks[batch.column("block")[i].as_py()][place:] if whole else None
                    for k in range(len(bounds) - 1):
                        got.setdefault(turn, []).append((names[k] if whole else None, ids[bounds[k]:bounds[k + 1]].tolist()))
                    got[turn, "size"] = got.get((turn, "size"), 0) + size
    want = {}
    for d, t, held, turn in rows:
        (_, _, ids, _), = encoder.documents(lm.pa.array([t], lm.pa.string()))
        for k in (None, *([] if held else [turn])):
            want.setdefault(k, []).append((d if k is None else None, ids.tolist()))
            want[k, "size"] = want.get((k, "size"), 0) + len((t or "").encode())
    order = lambda v: sorted(v, key=repr) if isinstance(v, list) else v
    assert {k: order(v) for k, v in got.items()} == {k: order(v) for k, v in want.items()}
