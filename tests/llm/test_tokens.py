import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import SF, no_docs, odd_docs, texts

from trustlens.llm import packing, token_files
from trustlens.llm.common import scratch
from trustlens.llm.subwords import END_ID, Encoder, default_path


def encoded(pairs):
    tk = Encoder.of(default_path()).tokenizer
    return [(d, np.array([*e.ids, END_ID], "<u4")) for (d, _), e in
            zip(pairs, tk.encode_batch([t or "" for _, t in pairs], add_special_tokens=False), strict=True)]


def test_files_round_trip(spark):
    want, start = [], 0
    for d, ids in encoded(sorted(texts().items())):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in token_files.op4_token_files(spark, SF).collect())
    assert got == want


def test_odd_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 200)
    docs = odd_docs(spark)
    folder = scratch(spark, "odd")
    manifest = token_files.write_token_files(docs, folder, default_path(), file_bytes=2000)
    got = token_files.read_token_files(manifest, ["doc_id", "start", "n_tokens", "ids_crc32"], token_files._digest,
                                       "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    pairs = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (key(r), r[1] or ""))
    want = encoded(pairs)
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert [r.n_tokens for r in got] == [len(x) for _, x in want]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(x.tobytes()) for _, x in want]
    assert [r.start for r in got] == np.cumsum([0, *[len(x) for _, x in want]])[:-1].tolist()
    some = {r.doc_id: r.ids for r in token_files.fetch_documents(manifest, [8, 12, 77]).collect()}
    assert some == {d: x.tolist() for d, x in want if d in (8, 12)}
    assert token_files.write_token_files(no_docs(spark), scratch(spark, "none"), default_path()).count() == 0


def test_reader_decompresses_only_what_is_asked_for(tmp_path):
    path = str(tmp_path / "x.zst")
    w = token_files.Writer(path)
    for d in range(40):
        w.add(d, np.arange(10_000, dtype=np.uint32) + d)
    w.close()
    r = token_files.Reader(path)
    assert len(r.seek) > 3 and len(r.frames_of([25])) == 1
    k = r.frames_of([25])[0]
    assert [x for d, _, x in r.documents([k]) if d == 25][0][0] == 25
    # public zstd readers see the same frames
    import zstandard
    data = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().decompressobj().decompress(data[:int(r.at[1])])
    assert len(whole) == r.seek["size"][0]
    bad = bytearray(data)
    bad[int(r.at[k]) + int(r.seek["packed"][k]) // 2] ^= 0xFF
    open(path, "wb").write(bytes(bad))
    with pytest.raises(Exception):
        list(token_files.Reader(path).documents([k]))
    assert list(token_files.Reader(path).documents([k + 1]))


def check_pieces(pieces, want, window=4096):
    """Every id in one piece, sequences without gaps, one padded sequence at most."""
    tokens = defaultdict(list)
    for d, x in want:
        tokens[d].append(x)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == set(tokens)
    for d, own in by_doc.items():
        assert sum(p.length for p in own) == sum(map(len, tokens[d]))
        if len(tokens[d]) == 1:
            at, x = 0, tokens[d][0]
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(x)
                assert p.ids_crc32 == zlib.crc32(x[at:at + p.length].tobytes())
                at += p.length
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
    sizes = []
    for k in sorted(by_seq):
        at = 0
        for p in sorted(by_seq[k], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(by_seq))) and all(s == window for s in sizes[:-1]) and (not sizes or 0 < sizes[-1] <= window)
    return by_seq


def test_packing(spark):
    by_seq = check_pieces(packing.op10_packing(spark, SF).collect(), encoded(sorted(texts().items())))
    total, count = defaultdict(int), len(by_seq)
    for own in by_seq.values():
        for p in own:
            total[p.source] += p.length
    # every window but the rests at the end has the corpus' shares to within a quantum a queue
    every = sum(total.values())
    for k in range(count - 1 - len(total) * packing.QUANTUM // packing.WINDOW - 1):
        have = defaultdict(int)
        for p in by_seq[k]:
            have[p.source] += p.length
        for s, n in total.items():
            assert abs(have[s] - packing.WINDOW * n / every) <= 2 * packing.QUANTUM


def test_odd_packing(spark):
    docs = odd_docs(spark)
    got = packing.pack_documents(docs, default_path(), {"a": 0.2, "b": 0.5}).collect()
    check_pieces(got, encoded([(r.doc_id, r.text) for r in docs.collect()]))
    assert packing.pack_documents(no_docs(spark), default_path()).collect() == []


def test_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    pairs = [(i, "some words of text " * (i % 50 + 1)) for i in range(300)]
    docs = spark.createDataFrame([(d, t, f"s{d % 23}") for d, t in pairs], "doc_id long, text string, source string").repartition(5)
    check_pieces(packing.pack_documents(docs, default_path()).collect(), encoded(pairs))


def test_windows_have_the_shares_of_many_sources(spark, monkeypatch):
    """Five round-robins in one another; also with a target for a source that is not among the largest."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 9)
    window, quantum = 1024, 8
    docs = spark.createDataFrame([(d, "some words of text " * 12, f"s{d % 40:02}") for d in range(1600)],
                                 "doc_id long, text string, source string").repartition(5)
    for targets in (None, {"s39": 0.25}):
        pieces, have = packing.pack_documents(docs, default_path(), targets, window, quantum).collect(), defaultdict(int)
        total = sum(p.length for p in pieces)
        for p in pieces:
            have[p.sequence_id, p.source] += p.length
        full = total // window - 40 * quantum // window - 2
        for k in range(full if targets is None else int(full / 40 / 0.25) - 1):
            for i in range(40):
                want = window / 40 if targets is None else window * (0.25 if i == 39 else 0.75 / 39)
                assert abs(have[k, f"s{i:02}"] - want) <= 3 * quantum, (k, i)


def test_round_robin_state_is_one_order():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(0, 50_000, rng.integers(1, 9))
        sizes[0] += 1
        plan = packing.RoundRobin(sizes, rng.uniform(0.01, 1, len(sizes)), 1024, 64)
        q = plan.served(np.arange(sizes.sum() // 1024 + 2))
        assert (np.diff(q, axis=0) >= 0).all() and (q[-1] == plan.quanta).all()
        # the order by hand: the queue whose next quantum is due first
        order = sorted((j + 1) / w * 1.0 for i, w in enumerate(plan.weights) for j in range(plan.quanta[i]))
        assert len(order) == plan.quanta.sum()
        by_hand = sorted(((j + 1) / plan.weights[i], i) for i in range(len(sizes)) for j in range(plan.quanta[i]))[:plan.per_window]
        assert np.bincount([i for _, i in by_hand], minlength=len(sizes)).tolist() == q[1].tolist()
        queue = np.repeat(np.arange(len(sizes)), 3)
        cut = sizes // 3
        first = np.stack([0 * cut, cut, 2 * cut], 1).ravel()
        count = np.stack([cut, cut, sizes - 2 * cut], 1).ravel()
        _, lo, length, k, off = plan.pieces(queue, first, count)
        place = np.sort(k * 1024 + off)
        order = np.argsort(k * 1024 + off)
        assert length.sum() == sizes.sum() and (place == np.concatenate([[0], np.cumsum(length[order])[:-1]])).all()
