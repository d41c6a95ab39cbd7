"""Mixture-controlled packing: windows of fixed length filled from source queues by deficit
round-robin.

Every source's documents, end to end, are a queue of ids. Queues are served a quantum of ids at a
time: the next quantum goes to the queue that is furthest behind its target share, so each window
has the target proportions to within a quantum per queue, and what a queue lacks in one window it
gets in a later one. A queue that has run dry leaves its share to the others.

The state of the round-robin after any number of quanta has a closed form: quantum j of a queue of
weight w is served at virtual time (j + 1) / w (ties: queue order), so the quanta served before
window k are the first k * per_window in that order. Each task computes that state for the
windows its own documents reach. Deficits thus carry across windows and across Spark partitions,
and no task needs another's result, a shuffle of ids, or more than one row per queue of state.

A round-robin has at most ``MAX_QUEUES`` queues. With more sources the last queue is itself what a
round-robin of the next sources deals, and so on: every source keeps its share of every window.

Quanta that are not full (the rest of each queue) follow at the very end, so only one window of
the whole corpus is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlens.llm.common import ready, source, written
from trustlens.llm.subwords import Encoder, default_path

WINDOW = 4096
QUANTUM = 128
#: queues of one round-robin; with more sources the last queue is a round-robin of the others
MAX_QUEUES = 256


class RoundRobin:
    """The closed-form state. sizes: ids per queue; weights: target shares (> 0)."""

    def __init__(self, sizes, weights, window: int = WINDOW, quantum: int = QUANTUM):
        if window % quantum:
            raise ValueError("the window must be a multiple of the quantum")
        self.window, self.quantum, self.per_window = window, quantum, window // quantum
        self.sizes, self.weights = np.asarray(sizes, np.int64), np.asarray(weights, float)
        self.quanta = self.sizes // quantum
        self.main = int(self.quanta.sum()) * quantum
        rest = self.sizes - self.quanta * quantum
        self.rest_at = self.main + np.cumsum(rest) - rest
        dry = np.sort(self.quanta / self.weights)  # virtual times at which queues run dry
        self._dry = np.concatenate([[0.0], dry])
        self._served = np.concatenate([[0.0], [np.minimum(self.quanta, v * self.weights).sum() for v in dry]])

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Quanta of each queue served before each window: [len(windows), queues]."""
        n = np.minimum(windows * self.per_window, int(self.quanta.sum()))
        v = np.interp(n, self._served, self._dry)
        q = np.clip(np.floor(v[:, None] * self.weights).astype(np.int64) - 1, 0, self.quanta)
        left = n - q.sum(1)
        while (left > 0).any():
            rows = np.flatnonzero(left > 0)
            due = np.where(q[rows] < self.quanta, (q[rows] + 1) / self.weights, np.inf)
            q[rows, due.argmin(1)] += 1
            left[rows] -= 1
        return q

    def reach(self, queue: np.ndarray, quantum: np.ndarray, slack: int) -> np.ndarray:
        """About the window in which a quantum of a queue is served, ``slack`` = -1: at or before it,
        1: at or after it."""
        v = (quantum + slack) / self.weights[queue]
        total = np.interp(v, self._dry, self._served)
        far = total + slack * (len(self.sizes) + 2)
        last = max(0, -(-int(self.quanta.sum()) // self.per_window) - 1)
        return np.clip(np.floor(far / self.per_window).astype(np.int64), 0, last)

    def pieces(self, queue: np.ndarray, first: np.ndarray, count: np.ndarray):
        """Where stretches [first, first + count) of queues go: arrays (stretch, first id of the
        piece in the queue, length, window, offset)."""
        out = [self._main(queue, first, count), self._rest(queue, first, count)]
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def order(self, queue: np.ndarray, first: np.ndarray, count: np.ndarray):
        """Where stretches of queues stand in the order of service, quantum by quantum: arrays (stretch, first
        id of the piece in the queue, length, place). A quantum's place is the number of quanta due before it."""
        q, cut = self.quantum, self.quanta[queue] * self.quantum
        end = np.minimum(first + count, cut)
        some = np.flatnonzero(end > first)
        at, j = _each(first[some] // q, (end[some] - 1) // q)
        at, before, w, number = some[at], np.empty(len(j), np.int64), self.weights, np.arange(len(self.weights))
        for a in range(0, len(j), 4096):
            own, mine = queue[at[a:a + 4096], None], j[a:a + 4096, None]
            due = (mine + 1) / w[own]
            n = np.floor(due * w).astype(np.int64)
            n -= n / w > due
            n += (n + 1) / w <= due
            n -= (n / w == due) & (number > own)
            before[a:a + 4096] = np.where(number == own, mine, np.minimum(n, self.quanta)).sum(1)
        lo, hi = np.maximum(first[at], j * q), np.minimum(end[at], (j + 1) * q)
        rest = np.flatnonzero(first + count > cut)
        begin = np.maximum(first[rest], cut[rest])
        out = [(at, lo, hi - lo, before * q + lo - j * q),
               (rest, begin, (first + count)[rest] - begin, self.rest_at[queue[rest]] + begin - cut[rest])]
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def _main(self, queue, first, count):
        q, end = self.quantum, np.minimum(first + count, self.quanta[queue] * self.quantum)
        some = np.flatnonzero(end > first)
        if not len(some):
            return [np.zeros(0, np.int64)] * 5
        s, a, b = queue[some], first[some], end[some]
        low, high = self.reach(s, a // q, -1), self.reach(s, (b - 1) // q + 1, 1)
        n = high - low + 1
        at = np.repeat(np.arange(len(some)), n)
        k = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        known, place = np.unique(k, return_inverse=True)
        before = self.served(known) * q
        given = self.served(known + 1) * q - before
        inside = np.cumsum(given, 1) - given
        s = s[at]
        begin = before[place, s]
        lo, hi = np.maximum(a[at], begin), np.minimum(b[at], begin + given[place, s])
        keep = hi > lo
        lo, hi, place, s = lo[keep], hi[keep], place[keep], s[keep]
        return [some[at[keep]], lo, hi - lo, k[keep], inside[place, s] + lo - before[place, s]]

    def _rest(self, queue, first, count):
        cut = self.quanta[queue] * self.quantum
        some = np.flatnonzero(first + count > cut)
        if not len(some):
            return [np.zeros(0, np.int64)] * 5
        lo = np.maximum(first[some], cut[some])
        p = self.rest_at[queue[some]] + lo - cut[some]
        length = first[some] + count[some] - lo
        low, high = p // self.window, (p + length - 1) // self.window
        n = high - low + 1
        at = np.repeat(np.arange(len(some)), n)
        k = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin = np.maximum(p[at], k * self.window)
        stop = np.minimum((p + length)[at], (k + 1) * self.window)
        return [some[at], lo[at] + begin - p[at], stop - begin, k, begin - k * self.window]


def _each(low: np.ndarray, high: np.ndarray):
    """(place, number) of every number low[place] ... high[place]."""
    n = high - low + 1
    return np.repeat(np.arange(len(n)), n), np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def nested(sizes, weights, window: int, quantum: int) -> list[RoundRobin]:
    """Round-robins of the sources in their order; the last queue of each but the last is the next."""
    own, out = MAX_QUEUES - 1, []
    for at in range(0, max(1, len(sizes) - 1), own):
        end = at + own if len(sizes) > at + MAX_QUEUES else len(sizes)
        more = end < len(sizes)
        out.append(RoundRobin([*sizes[at:end], *[sum(sizes[end:])] * more], [*weights[at:end], *[sum(weights[end:])] * more], window, quantum))
    return out


def nested_pieces(plans: list[RoundRobin], level: np.ndarray, slot: np.ndarray, first: np.ndarray, count: np.ndarray):
    """``RoundRobin.pieces`` of stretches of queues ``slot`` of round-robins ``level``."""
    none = np.zeros(0, np.int64)
    doc, queue, at, own, n, k, offset = [none] * 7
    for i in range(int(level.max(initial=0)), -1, -1):
        new = np.flatnonzero(level == i)
        join = lambda a, b: np.concatenate([a, b])
        doc, queue, at, own, n = join(doc, new), join(queue, slot[new]), join(at, first[new]), join(own, first[new]), join(n, count[new])
        if i:  # the next round-robin up has these ids in order of service in its last queue
            piece, lo, n, place = plans[i].order(queue, at, n)
            queue = np.full(len(piece), len(plans[i - 1].sizes) - 1)
        else:
            piece, lo, n, k, offset = plans[i].pieces(queue, at, n)
        doc, own = doc[piece], own[piece] + lo - at[piece]
        at = place if i else at
    return doc, own, n, k, offset


def _tokens(tokenizer: str):
    def run(batches):
        from pyspark import TaskContext
        part, encoder, held = TaskContext.get().partitionId(), Encoder.of(tokenizer), {}
        kind = "<u2" if encoder.size <= 1 << 16 else "<u4"
        for batch in batches:
            names, keys = batch.column("source").to_pylist(), batch.column("doc_id")
            for a, b, ids, bounds in encoder.documents(batch.column("text")):
                starts, blobs, lens = [], [], np.diff(bounds)
                for i in range(b - a):
                    name, n = names[a + i], int(lens[i])
                    starts.append(held.get(name, 0))
                    held[name] = starts[-1] + n
                    blobs.append(ids[bounds[i]:bounds[i + 1]].astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part, np.int32)), pa.array(names[a:b], pa.string()), keys.slice(a, b - a),
                     pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["part", "source", "doc_id", "own_start", "n", "ids"])
    return run


_TOKENS = "part int, source string, doc_id long, own_start long, n long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def _pieces(plans):
    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                doc_n = batch.column("n").to_numpy()
                first = batch.column("queue_start").to_numpy()
                doc, lo, length, k, offset = nested_pieces(plans.value, batch.column("level").to_numpy(), batch.column("slot").to_numpy(), first, doc_n)
                blobs, start = batch.column("ids"), lo - first[doc]
                crc, have, own = np.empty(len(doc), np.int64), -1, None
                order = np.argsort(doc, kind="stable")
                for i in order.tolist():
                    if doc[i] != have:
                        have = int(doc[i])
                        raw = blobs[have].as_buffer()
                        own = np.frombuffer(raw, "<u2" if raw.size == 2 * doc_n[have] else "<u4").astype("<u4")
                    crc[i] = zlib.crc32(own[start[i]:start[i] + length[i]])
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), pa.array(start), pa.array(length), pa.array(crc), pa.array(doc_n[doc]),
                     pa.array(k), pa.array(offset), batch.column("source").take(take)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])
    return run


def pack_documents(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None,
                   window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source).

    ``docs`` has doc_id, text and source. ``targets``: token shares by source; sources without
    one divide what is left by their size. By default the shares are those of the corpus, so that
    all queues run dry together.

    A null text is empty (one piece: the end id); a null source is the source "". Every id of
    every row is in exactly one piece; repeated rows are packed each for itself; an empty table
    gives no rows; further columns are ignored.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    tokens = written(rows.mapInArrow(_tokens(tokenizer), _TOKENS), "tokens")
    sums = written(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "sums")

    every = sums.groupBy("source").agg(F.sum("n").alias("n")).collect()
    if not every:
        return spark.createDataFrame([], PIECES)
    # sources with a target come first, so that what they leave goes to all others
    every.sort(key=lambda r: (not (targets or {}).get(r["source"], 0) > 0, -r["n"], r["source"]))
    names, sizes = [r["source"] for r in every], [r["n"] for r in every]
    plans = nested(sizes, shares(names, sizes, targets), window, quantum)
    places = [(min(i // (MAX_QUEUES - 1), len(plans) - 1)) for i in range(len(names))]
    queue = spark.createDataFrame([(x, k, i - k * (MAX_QUEUES - 1)) for i, (x, k) in enumerate(zip(names, places, strict=True))],
                                  "source string, level long, slot long")
    # where each part's documents of a source begin in the queue: a row per part and source
    base = (sums.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("part")
                                                    .rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
            .join(queue, "source").select("part", "source", "level", "slot", "base"))
    placed = (tokens.join(base, ["part", "source"])
              .select("doc_id", "source", "level", "slot", (F.col("base") + F.col("own_start")).alias("queue_start"), "n", "ids"))
    return placed.mapInArrow(_pieces(spark.sparkContext.broadcast(plans)), PIECES)


def shares(names: list[str], sizes: list[int], targets: dict[str, float] | None) -> list[float]:
    """Positive weights of the queues (see ``pack_documents``)."""
    given = {k: float(v) for k, v in (targets or {}).items() if v > 0}
    own = [given.get(x) for x in names]
    left = max(1e-6, 1 - sum(w for w in own if w is not None))
    free = sum(n for n, w in zip(sizes, own, strict=True) if w is None) or 1
    return [w if w is not None else left * n / free for n, w in zip(sizes, own, strict=True)]


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 4096 ids."""
    return pack_documents(source(spark, sf_dir, "documents", "doc_id", "text", "source"), default_path())
