"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and freed of closing marks. A document and a benchmark item are a pair when
they share a seed, a run of ``SEED`` words. For each pair, running Karp-Rabin greedy string tiling
finds the longest runs of common words that overlap no run marked before, marks them, and
goes on with shorter ones down to the seed length. The share of the item's words that is marked
decides, wherever and in whatever order the runs stand in the document.

Seeds reach the documents as a bit filter of fixed size built from the benchmark; only documents
with a seed send anything on, and of these only the stretches of words that seeds cover, for no
tile can lie elsewhere. The exact join on seeds follows, so the filter costs no result however
large the benchmark is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import hash_filter, hashes_in, ready, source, written
from trustlens.llm.words import row_slices, shingles, spans, text_buffer, word_hashes

SEED = 5
#: share of an item's words that must be tiled
COVERAGE = 0.6

_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord(c) for c in "\"'(["]] = True
_CLOSE[[ord(c) for c in ".,;:!?\"')]"]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _tokens(col: pa.Array):
    """(first row, one past the last, word bounds by row, word hashes) without outer marks."""
    offsets, data = text_buffer(col)
    for a, b in row_slices(offsets):
        raw = data[offsets[a]:offsets[b]]
        starts, ends, bounds = spans(offsets[a:b + 1] - offsets[a], raw)
        if len(starts):
            starts = starts + (_OPEN[raw[starts]] & (ends - starts > 1))
            ends = ends - (_CLOSE[raw[ends - 1]] & (ends - starts > 1))
        yield a, b, bounds, word_hashes(raw, starts, ends)


# ------------------------------------------------------------------ tiling of one pair

def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _windows(words: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of s free words and their Karp-Rabin hashes (prefix sums of a polynomial)."""
    n = len(words) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[s:] == taken[:-s])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words))[:-1], dtype=np.uint64)])
    return at, (sums[at + s] - sums[at]) * _powers(_INVERSE, len(words))[at]


def tiles(text: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in text, start in item, length) of two sequences of word hashes.

    Word 0 stands for a gap and matches nothing. ``least`` is the shortest tile.
    """
    text_free, item_free, out = text != 0, item != 0, []
    s = max(least, min(len(item), 32))
    while True:
        at, keys = _windows(item, item_free, s)
        place: dict[int, list[int]] = {}
        for j, k in zip(at.tolist(), keys.tolist(), strict=True):
            place.setdefault(k, []).append(j)
        at, keys = _windows(text, text_free, s)
        found, longest = [], 0
        for i, k in zip(at.tolist(), keys.tolist(), strict=True):
            for j in place.get(k, ()):
                if i and j and text_free[i - 1] and item_free[j - 1] and text[i - 1] == item[j - 1]:
                    continue  # part of the run that begins a word earlier
                n = 0
                while (i + n < len(text) and j + n < len(item) and text_free[i + n] and item_free[j + n]
                       and text[i + n] == item[j + n]):
                    n += 1
                if n >= s:
                    found.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * s:
            s = longest  # far longer runs than looked for: these first
            continue
        for n, i, j in sorted(found, key=lambda x: (-x[0], x[2], x[1])):
            # the part that longer tiles have left
            both = text_free[i:i + n] & item_free[j:j + n]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], both, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= s:
                    text_free[i + a:i + b] = False
                    item_free[j + a:j + b] = False
                    out.append((i + a, j + a, b - a))
        if s == least:
            return out
        s = max(least, s // 2)


# ------------------------------------------------------------------ Spark passes

_ITEMS = "item_id long, n_words long, words binary, seeds array<long>"


def _item_rows(size: int):
    def run(batches):
        for batch in batches:
            rows = []
            for a, b, bounds, h in _tokens(batch.column("text")):
                for i in range(b - a):
                    w = h[bounds[i]:bounds[i + 1]]
                    rows.append((batch.column("item_id")[a + i].as_py(), len(w), w.tobytes(),
                                 np.unique(shingles(w, size)).view(np.int64).tolist()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["item_id", "n_words", "words", "seeds"])
    return run


_HITS = "row long, doc_id long, words binary, seeds array<long>"


def _hit_rows(size: int, bits):
    def run(batches):
        from pyspark import TaskContext
        table, row = bits.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for a, _, bounds, h in _tokens(batch.column("text")):
                keys = shingles(h, size)
                got = hashes_in(table, keys)
                doc = np.searchsorted(bounds, got, "right") - 1
                inside = got + size <= bounds[doc + 1]  # a seed ends in the text it begins in
                got, doc = got[inside], doc[inside]
                for i in np.unique(doc).tolist():
                    s, e = int(bounds[i]), int(bounds[i + 1])
                    own = got[doc == i]
                    seen = np.zeros(e - s, bool)
                    for k in range(size):
                        seen[own - s + k] = True
                    # words outside all seeds shrink to one gap
                    keep = seen.copy()
                    keep[1:] |= seen[:-1]
                    words = np.where(seen, h[s:e], np.uint64(0))[keep]
                    out.append((row, ids[a + i].as_py(), words.tobytes(), np.unique(keys[own]).view(np.int64).tolist()))
                    row += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["row", "doc_id", "words", "seeds"])
    return run


_TILED = "row long, doc_id long, item_id long, item_words long, tiled_words long, n_tiles long, longest_tile long, coverage double"


def _tile_rows(seed: int):
    def run(batches):
        for batch in batches:
            text, item = batch.column("words"), batch.column("item")
            n = np.zeros((batch.num_rows, 3), np.int64)
            for i in range(batch.num_rows):
                y = np.frombuffer(item[i].as_buffer(), np.uint64)
                got = tiles(np.frombuffer(text[i].as_buffer(), np.uint64), y, seed)
                n[i] = sum(x[2] for x in got), len(got), max((x[2] for x in got), default=0)
            total = batch.column("item_words").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("item_id"), batch.column("item_words"),
                 *(pa.array(n[:, k]) for k in range(3)), pa.array(n[:, 0] / np.maximum(total, 1))],
                names=["row", "doc_id", "item_id", "item_words", "tiled_words", "n_tiles", "longest_tile", "coverage"])
    return run


def tiled_pairs(docs: DataFrame, benchmark: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, item_words, tiled_words, n_tiles, longest_tile, coverage) of every document
    row and benchmark item with a seed in common.

    docs: doc_id and text; benchmark: item_id and text; further columns are ignored. A null, empty
    or wordless text has no seeds and is in no pair, nor is an item of fewer words than a seed,
    which chance alone would find. Repeated rows give a row each; an empty table on either side gives no rows.
    """
    spark = ready(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = written(items.mapInArrow(_item_rows(seed), _ITEMS), "items").filter(F.col("n_words") >= seed)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bits = spark.sparkContext.broadcast(hash_filter(items, "seeds"))
    hits = written(texts.mapInArrow(_hit_rows(seed, bits), _HITS), "hits")
    items = items.withColumn("item_row", F.xxhash64("item_id", "words"))
    pairs = (hits.select("row", F.explode("seeds").alias("seed"))
             .join(items.select("item_row", F.explode("seeds").alias("seed")), "seed").select("row", "item_row").distinct())
    rows = (pairs.join(items.dropDuplicates(["item_row"]).select(
                "item_row", "item_id", F.col("n_words").alias("item_words"), F.col("words").alias("item")), "item_row")
            .join(hits.select("row", "doc_id", "words"), "row"))
    return rows.select("row", "doc_id", "item_id", "item_words", "words", "item").mapInArrow(_tile_rows(seed), _TILED).drop("row")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """The pairs of ``tiled_pairs`` whose tiles cover ``coverage`` of the item."""
    return tiled_pairs(docs, benchmark, seed).filter(F.col("coverage") >= coverage)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the benchmark items that they hold."""
    return contaminated(source(spark, sf_dir, "documents", "doc_id", "text"),
                        source(spark, sf_dir, "benchmark", "item_id", "text"))
