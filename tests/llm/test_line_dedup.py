import hashlib
from collections import Counter, defaultdict

import numpy as np
from helpers import SF, no_docs, odd_docs, texts

from trustlens.llm import line_dedup as ld
from trustlens.llm.cuckoo import SLOTS, CuckooFilter, fingerprints

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SHARED = "this line stands in more than one place"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute(rows):
    """{(doc_id, text): (n_lines, n_dropped, kept)}"""
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                held[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == d]
        out[d, t] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def as_rows(df):
    return sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept)) for r in df.collect())


def state(index):
    return (sorted(map(tuple, index.refs.collect())), sorted(map(tuple, index.keys.collect())))


def test_query_against_brute_force(spark):
    want = brute(list(texts().items()))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.op13_line_dedup(spark, SF).collect()}
    assert got == {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for (d, _), (n, k, t) in want.items()}
    assert sum(k for _, k, _ in got.values()) > 0


def test_increments_change_nothing_and_deletions_undo(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, SHARED + "\nown line number " + str(i)) for i in range(50)], docs.schema))
    once = as_rows(ld.deduped(docs, 1))
    assert as_rows(ld.deduped(docs, 3)) == once
    first, more = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1")
    before = ld.insert(None, first)
    both = ld.insert(before, more)
    again = ld.insert(both, more)  # documents that are in already
    assert state(again) == state(both)
    undone = ld.delete(both, more.select("doc_id"))
    assert state(undone) == state(before)
    sizes = lambda x: {r.shard: len(CuckooFilter.loads(r.slots, r.stash)) for r in x.filters.collect()}
    assert sizes(undone) == sizes(before)
    assert as_rows(ld.kept_lines(undone, first)) == as_rows(ld.deduped(first, 1))


def test_the_next_document_takes_a_line_over(spark):
    docs = spark.createDataFrame([(i, SHARED) for i in (5, 3, 9)], "doc_id long, text string")
    index = ld.insert(None, docs)
    assert {r.doc_id for r in ld.kept_lines(index, docs).collect() if r.kept} == {3}
    index = ld.delete(index, docs.filter("doc_id = 3"))
    assert {r.doc_id for r in ld.kept_lines(index, docs.filter("doc_id <> 3")).collect() if r.kept} == {5}


def test_odd_rows(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(20, f"  {SHARED.upper()}\t\n\nshort\n{SHARED}\n{SHARED}é"), (21, SHARED), (None, SHARED)],
                                                             "doc_id long, text string"), allowMissingColumns=True)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for n in (1, 2):
        got = Counter(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept)) for r in ld.deduped(docs, n).collect())
        assert got == Counter(repr((r.doc_id, *want[r.doc_id, r.text])) for r in docs.collect())
    assert ld.deduped(no_docs(spark)).count() == 0


def test_shards_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 2)
    docs = spark.createDataFrame([(i, f"line of the document number {i // 2}") for i in range(200)], "doc_id long, text string")
    index = ld.insert(ld.insert(None, docs.filter("doc_id < 4")), docs)
    assert index.shards > 1 and index.keys.count() == 100
    assert as_rows(ld.kept_lines(index, docs)) == as_rows(ld.deduped(docs, 1))


def test_filter_against_a_set():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 30_000)
    f = CuckooFilter()
    for part in np.array_split(keys, 7):
        f.insert(fingerprints(part))
    assert len(f) == len(keys) and f.contains(fingerprints(keys)).all()
    other = fingerprints(rng.integers(0, 2**63, 100_000))
    assert f.contains(other).mean() < 1e-3
    assert len(keys) > 0.4 * f.table.size
    f.delete(fingerprints(keys[:20_000]))
    assert len(f) == 10_000 and f.contains(fingerprints(keys[20_000:])).all()
    assert f.contains(fingerprints(keys[:20_000])).mean() < 1e-3
    g = CuckooFilter.loads(*f.dumps())
    assert g.contains(fingerprints(keys[20_000:])).all() and len(g) == len(f)


def test_one_fingerprint_many_times():
    f, x = CuckooFilter(), np.full(5 * SLOTS, 77, np.uint32)
    f.insert(x)
    assert len(f) == len(x)
    f.delete(x[:-1])
    assert len(f) == 1 and f.contains(x[:1]).all()
    f.delete(x[:1])
    assert len(f) == 0 and not f.contains(x[:1]).any()
