import zlib
from collections import defaultdict

import pytest
from helpers import no_docs, odd_docs, texts

from trustlens.llm import kd_shards as k

SF01 = "/root/testdata/sf0.01"


def check(rows, docs, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(repr((d, size(t), zlib.crc32((t or "").encode()))) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_near_equal_bytes_and_groups_together(spark):
    docs = texts(SF01)
    rows = k.op7_kd_shards(spark, SF01).collect()
    check(rows, docs.items(), 16)
    weight, of = defaultdict(int), defaultdict(set)
    for r in rows:
        weight[r.shard] += r.size
        of[docs[r.doc_id]].add(r.shard)
    mean, largest = sum(weight.values()) / 16, max(r.size for r in rows)
    assert len(weight) == 16 and max(abs(w - mean) for w in weight.values()) <= largest
    heavy = {t for t in of if sum(len(t.encode()) + 1 for d in docs.values() if d == t) > k.HEAVY * mean}
    assert all(len(s) == 1 for t, s in of.items() if t not in heavy)


def test_a_third_in_one_source_and_a_hot_text(spark):
    docs = [(i, "same text " * 20 if i % 3 == 0 else f"{i} " * (20 + i % 50), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows = k.kd_shards(df, 8).collect()
    check(rows, [(d, t) for d, t, *_ in docs], 8)
    weight = defaultdict(int)
    for r in rows:
        weight[r.shard] += r.size
    assert max(weight.values()) < 1.01 * min(weight.values())


def brute_shards(points, shards):
    """The tree by hand over collected points: widest dimension, weighted median, recursively."""
    span = [max(1, max(r[f"p{i}"] for r in points) - min(r[f"p{i}"] for r in points)) for i in range(3)]
    out = {}

    def place(rows, node, left):
        if not left:
            out[node] = rows
            return
        if not rows:
            return
        wide = [(max(r[f"p{i}"] for r in rows) - min(r[f"p{i}"] for r in rows)) / span[i] for i in range(3)]
        d, at = wide.index(max(wide)), defaultdict(int)
        for r in rows:
            at[(r[f"p{d}"], r["tie"])] += r["size"]
        total, before = sum(at.values()), 0
        for cut in sorted(at):
            if 2 * (before + at[cut]) >= total:
                break
            before += at[cut]
        own = 2 * before + at[cut] < total  # the median's own rows go where this leaves nearer halves
        side = lambda r: (r[f"p{d}"], r["tie"]) < cut or own and (r[f"p{d}"], r["tie"]) == cut
        place([r for r in rows if side(r)], 2 * node, left - 1)
        place([r for r in rows if not side(r)], 2 * node + 1, left - 1)

    place(points, 1, shards.bit_length() - 1)
    return {(r["doc_id"], node - shards) for node, rows in out.items() for r in rows}


def test_against_a_tree_by_hand(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    total = sum(len((t or "").encode()) + 1 for t in texts(SF01).values())
    points = [r.asDict() for r in k.points(docs, total / 16).collect()]
    assert {(r.doc_id, r.shard) for r in k.op7_kd_shards(spark, SF01).collect()} == brute_shards(points, 16)


def test_heavy_groups_are_cut_only_where_a_median_falls(spark):
    """Nine heavy groups of equal texts from many sources, four leaves: three medians, so at most three groups are cut once."""
    docs = [(i, f"group {i % 9} " * 12 if i % 2 else f"{i} alone " * (5 + i % 40), "en", f"s{i % 11}") for i in range(3000)]
    rows = k.kd_shards(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), 4).collect()
    check(rows, [(d, t) for d, t, *_ in docs], 4)
    of, weight = defaultdict(set), defaultdict(int)
    for r in rows:
        weight[r.shard] += r.size
        of[docs[r.doc_id][1]].add(r.shard)
    assert sum(len(s) - 1 for s in of.values()) <= 3
    assert max(weight.values()) < 1.02 * min(weight.values())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    check(k.kd_shards(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 16)
    assert k.kd_shards(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        k.kd_shards(docs, 12)
