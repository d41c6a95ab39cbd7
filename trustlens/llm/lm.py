"""Language-model scoring: a causal self-attention model over subword ids, trained with numpy.

Model. Inputs are subword ids (frequent ones with an embedding each, the others share hashed ones)
plus a learned position; one causal attention layer with a residual; a softmax in two levels: ids
in order of frequency fall into classes of about equal mass, an output picks the class and one of
the class's own the id. Ids beyond the ranked ones are a class that their add-one frequencies divide.

Encoding. Every text is encoded once: its ids are written in slices (about a megabyte of text each), beside
the blocks below, and counting, training and scoring read the slices.

Training. Id counts and parameters learn from every training document. A trainer is a partition of the
slices (at least ``TRAINER_BYTES`` of text, so their number follows the corpus). Each starts from the same
parameters and runs Adam over all windows of its documents, a piece of text at a time; parameters are then
averaged, weighted by tokens, as a grouped sum per parameter; the next round, over the documents that the
first one left, starts from the average. A trainer with text for fewer than ``STEPS`` steps goes over its
pieces again. No text is shuffled. Parameters and id counts have a fixed size, so only they meet the driver.

Scoring. A text is cut into windows of ``CONTEXT`` inputs that overlap by ``OVERLAP``; each id is
scored once, in the first window that holds it, with batched masked attention.

Beside it stands an add-one unigram score over words. Word counts cover all training documents: each
task turns its texts into blocks (distinct word hashes, and places in them), counts are summed by
word, and go back to the blocks that hold the word.
"""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import discard, give_back, ready, source, written
from trustlens.llm.subwords import END_ID, Encoder, default_path
from trustlens.llm.words import hashed_rows, mix

#: window inputs, inputs that two windows share, vector size, input vectors
CONTEXT, OVERLAP, WIDTH, INPUTS = 32, 8, 16, 2048
#: classes, ids with an output of their own, most of them in a class
HEAD, RANKED, WIDEST = 80, 2048, 96
#: every training document is in one of so many rounds
ROUNDS = 2
#: text of a trainer at least and of its pieces, windows in a step, step length, steps of a trainer at least (over the same windows again)
TRAINER_BYTES, STEP_WINDOWS, RATE, STEPS = 4 << 20, 192, 0.02, 200
#: bytes of written slices and blocks that a task reads
SPLIT_BYTES = 32 << 20
#: words in a block of texts
BLOCK_WORDS = 2_000_000
#: stands for the end of a text among word hashes
END_WORD = np.uint64(1)


# ------------------------------------------------------------------ model

SHAPES = {"embed": (INPUTS + 1, WIDTH), "place": (CONTEXT, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH),
          "value": (WIDTH, WIDTH), "out": (WIDTH, WIDTH), "head": (WIDTH + 1, HEAD), "inner": (WIDTH + 1, RANKED)}
_SIZES = {k: int(np.prod(s)) for k, s in SHAPES.items()}
PARAMETERS = sum(_SIZES.values())


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        out[name] = flat[at:at + _SIZES[name]].reshape(shape)
        at += _SIZES[name]
    return out


class Vocabulary:
    """Input vectors, classes and places of ids, from the ids' counts."""

    def __init__(self, counts: np.ndarray):
        ids = np.arange(len(counts))
        order = np.lexsort((ids, -counts))
        self.rank = np.empty(len(counts), np.int32)
        self.rank[order] = ids
        mass = (counts[order] + 1.0) / (counts + 1.0).sum()
        self.first, at = [], 0  # of each class: its first rank
        while at < min(RANKED, len(ids)) and len(self.first) < HEAD - 1:
            self.first.append(at)
            reach = int(np.searchsorted(np.cumsum(mass[at:at + WIDEST]), 1 / HEAD)) + 1
            at = min(at + min(reach, WIDEST), RANKED, len(ids))
        self.first += [at, len(ids)]  # the last class holds the rest
        self.first = np.array(self.first)
        self.group = (np.searchsorted(self.first, self.rank, "right") - 1).astype(np.int16)
        self.ranked = at
        own = INPUTS * 3 // 4
        hashed = own + (mix(ids.astype(np.uint64)) % np.uint64(INPUTS - own)).astype(np.int64)
        self.input = np.where(self.rank < own, self.rank, hashed).astype(np.int32)
        rest = self.rank >= at
        # log probability of an id of the last class given the class
        self.within = np.where(rest, np.log((counts + 1.0) / max(1.0, (counts[rest] + 1.0).sum())), 0.0).astype(np.float32)
        self.mass = mass


def initial(vocabulary: Vocabulary, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, 0.1, PARAMETERS).astype(np.float32)
    p = split(flat)
    for name in ("query", "key", "value", "out"):
        p[name][:] = rng.normal(0, WIDTH**-0.5, p[name].shape)
    first, mass = vocabulary.first, vocabulary.mass
    p["head"][-1] = -30
    for c in range(len(first) - 1):
        p["head"][-1, c] = np.log(max(1e-12, mass[first[c]:first[c + 1]].sum()))
    p["inner"][-1, :vocabulary.ranked] = np.log(mass[:vocabulary.ranked])
    return flat


#: what a place of a window sees: itself and those before
_SEEN = np.tri(CONTEXT, dtype=np.float32)
START = INPUTS  # the input before a text's first id


def _by_group(group: np.ndarray, first: np.ndarray):
    """Rows in order of class, and where each class begins among them."""
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(len(first), dtype=group.dtype)).tolist()


def _exp(z: np.ndarray) -> np.ndarray:
    """exp in place, up to a factor by row that a softmax divides out."""
    if z.size and (z.max() > 60 or z.min() < -60):
        z -= z.max(-1, keepdims=True)
    return np.exp(z, out=z)


def _inner(weights: np.ndarray, first: np.ndarray, h: np.ndarray, group: np.ndarray, rank: np.ndarray, w: np.ndarray, g: np.ndarray):
    """Loss of ids within their classes, and its gradient: to the weights into g, and (rows, gradient to those rows of h, then zeros)."""
    order, cuts = _by_group(group, first)
    begin, widths = first[:-2], np.diff(first[:-1])
    sizes = np.diff(cuts)[:len(begin)] * (widths > 1)
    order = order[np.repeat(widths > 1, np.diff(cuts)[:len(begin)]).nonzero()[0]]  # neither classes of one id nor the last
    h, rank, w = h.take(order, axis=0), rank.take(order), w.take(order)
    rows, cells = np.cumsum(sizes) - sizes, np.cumsum(sizes * widths) - sizes * widths
    cls = np.repeat(np.arange(len(begin)), sizes)
    picked = cells[cls] + (np.arange(len(order)) - rows[cls]) * widths[cls] + rank - begin[cls]
    # the logits of all classes lie end to end, so that most steps are taken once for all of them
    flat, sums, dh = np.empty(int((sizes * widths).sum()), h.dtype), np.empty(len(order), h.dtype), np.zeros((len(order) + 1, WIDTH), h.dtype)
    ones, parts = np.ones(WIDEST, h.dtype), []
    for n, m, row, cell, at in zip(sizes.tolist(), widths.tolist(), rows.tolist(), cells.tolist(), begin.tolist(), strict=True):
        if n:
            parts.append((slice(row, row + n), slice(at, at + m), flat[cell:cell + n * m].reshape(n, m)))
            np.matmul(h[row:row + n], weights[:, at:at + m], out=parts[-1][2])
    if flat.size and (flat.max() > 60 or flat.min() < -60):
        for _, _, z in parts:
            z -= z.max(1, keepdims=True)
    np.exp(flat, out=flat)
    for some, _, z in parts:
        np.matmul(z, ones[:z.shape[1]], out=sums[some])
    loss = -(np.log(np.maximum(flat[picked] / sums, 1e-30)) * w).sum()
    scale = (w / sums)[:, None]
    for some, _, z in parts:
        z *= scale[some]
    flat[picked] -= w
    g[:] = 0
    for some, ranks, z in parts:
        g[:, ranks] = h[some].T @ z
        np.matmul(z, weights[:-1, ranks].T, out=dh[some])
    return loss, order, dh


def step(p: dict, first: np.ndarray, x: np.ndarray, group: np.ndarray, rank: np.ndarray, live: np.ndarray, g: dict) -> float:
    """Loss of windows of inputs x and outputs (class, rank) where ``live``, and its gradient, into g."""
    b, scale, kind = len(x), np.float32(WIDTH**-0.5), p["embed"].dtype
    e = p["embed"].take(x, axis=0)
    e += p["place"]
    flat = e.reshape(-1, WIDTH)
    three = np.concatenate([p["query"] * scale, p["key"], p["value"]], 1)
    cut = [slice(i * WIDTH, (i + 1) * WIDTH) for i in range(3)]
    q, k, v = ((flat @ three).reshape(b, CONTEXT, -1)[:, :, c] for c in cut)
    a = _exp(np.matmul(q, k.transpose(0, 2, 1)))
    a *= _SEEN
    a /= (a @ np.ones(CONTEXT, kind))[:, :, None]
    c = (a @ v).reshape(-1, WIDTH)
    h = np.ones((len(flat), WIDTH + 1), kind)
    np.add(flat, c @ p["out"], out=h[:, :WIDTH])
    rows, w, group, rank = np.arange(len(h)), live.ravel().astype(kind), group.ravel(), rank.ravel()
    w /= max(1.0, float(w.sum()))
    z = _exp(h @ p["head"])
    sums = z @ np.ones(HEAD, kind)
    loss = -(np.log(np.maximum(z[rows, group] / sums, 1e-30)) * w).sum()
    z *= (w / sums)[:, None]
    z[rows, group] -= w
    g["head"][:] = (z.T @ h).T
    dh = z @ p["head"][:-1].T
    inner, at, more = _inner(p["inner"], first, h, group, rank, w, g["inner"])
    place = np.full(len(h), len(at))
    place[at] = np.arange(len(at))
    dh += more.take(place, axis=0)
    g["out"][:] = c.T @ dh
    dc = dh @ p["out"].T
    inside = np.einsum("ij,ij->i", dc, c).reshape(b, CONTEXT, 1)  # of each place: its weights times their gradients
    dc = dc.reshape(b, CONTEXT, WIDTH)
    ds = dc @ v.transpose(0, 2, 1)
    ds -= inside
    ds *= a
    d = np.empty((b, CONTEXT, 3 * WIDTH), kind)
    np.matmul(ds, k, out=d[:, :, cut[0]])
    np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, cut[1]])
    np.matmul(a.transpose(0, 2, 1), dc, out=d[:, :, cut[2]])
    d = d.reshape(-1, 3 * WIDTH)
    to = flat.T @ d
    g["query"][:], g["key"][:], g["value"][:] = to[:, cut[0]] * scale, to[:, cut[1]], to[:, cut[2]]
    de = dh
    de += d @ three.T
    g["place"][:] = de.reshape(b, CONTEXT, WIDTH).sum(0)
    g["embed"][:] = 0
    x = x.astype(np.int16).ravel()
    order = np.argsort(x, kind="stable")
    x = x[order]
    begin = np.flatnonzero(np.diff(x, prepend=-1))
    g["embed"][x[begin]] = np.add.reduceat(de.take(order, axis=0), begin)
    return float(loss + inner)


class Adam:
    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.t = flat, rate, 0
        self.m, self.v, self.room = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)

    def move(self, g: np.ndarray, scale: float) -> None:
        self.t += 1
        self.m *= np.float32(0.9)
        self.m += np.multiply(g, np.float32(0.1), out=self.room)
        self.v *= np.float32(0.99)
        np.multiply(g, g, out=self.room)
        self.room *= np.float32(0.01)
        self.v += self.room
        rate = self.rate * scale * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        np.sqrt(self.v, out=self.room)
        self.room += np.float32(1e-8)
        np.divide(self.m, self.room, out=self.room)
        self.room *= np.float32(rate)
        self.flat -= self.room


class Scorer:
    """Log probabilities of documents' ids under given parameters."""

    def __init__(self, flat: np.ndarray, vocabulary: Vocabulary, windows: int = 128, batches: int = 8):
        p = self.p = split(np.nan_to_num(flat))
        self.vocabulary, self.windows, self.fresh = vocabulary, windows, CONTEXT - OVERLAP
        # projections of every input vector and place, so that no window multiplies them again
        scale = np.float32(WIDTH**-0.5)
        both = lambda m: (np.ascontiguousarray(p["embed"] @ m), p["place"] @ m)
        self.query, self.key, self.value = both(p["query"] * scale), both(p["key"]), both(p["value"] @ p["out"])
        self.plain = p["embed"], p["place"]
        self.inner = {c: np.ascontiguousarray(p["inner"][:, a:b]) for c, (a, b) in
                      enumerate(zip(vocabulary.first[:-2].tolist(), vocabulary.first[1:-1].tolist(), strict=True))}
        self.together = windows * batches  # windows whose classes are worked on together
        self.several = np.flatnonzero(np.diff(vocabulary.first[:-1]) > 1).tolist()
        self.hidden = np.ones((self.together * CONTEXT, WIDTH + 1), np.float32)
        self.ones = np.ones(max(CONTEXT, HEAD, WIDEST), np.float32)
        self.logits = np.empty((windows * CONTEXT, HEAD), np.float32)
        self.weights = np.empty((windows, CONTEXT, CONTEXT), np.float32)
        self.mask = _SEEN

    def documents(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log probability of each document's ids [bounds[i], bounds[i + 1])."""
        n, total = len(bounds) - 1, len(ids)
        if total == 0:
            return np.zeros(n)
        inputs = np.empty(total, np.int32)
        inputs[1:] = self.vocabulary.input[ids[:-1]]
        lens = np.diff(bounds)
        inputs[bounds[:-1][lens > 0]] = START
        group, rank = self.vocabulary.group[ids], self.vocabulary.rank[ids]
        logp = np.zeros(total, np.float32)
        first = bounds[:-1]
        # the first window of each document scores all of its ids, the others what is new in them
        some = np.flatnonzero(lens > 0)
        self._run(inputs, group, rank, logp, first[some], np.minimum(lens[some], CONTEXT), 0)
        more = np.maximum(0, -(-(lens - CONTEXT) // self.fresh))
        doc = np.repeat(np.arange(n), more)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(more) - more, more) + 1
        start = first[doc] + turn * self.fresh
        self._run(inputs, group, rank, logp, start, np.minimum(bounds[1:][doc] - start, CONTEXT), OVERLAP)
        logp += self.vocabulary.within[ids]
        sums = np.concatenate([[0.0], np.cumsum(logp, dtype=np.float64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def _run(self, inputs, group, rank, logp, start, length, skip: int) -> None:
        span, last, fresh = np.arange(CONTEXT), len(inputs) - 1, CONTEXT - skip
        for a in range(0, len(start), self.together):
            s, n = start[a:a + self.together], length[a:a + self.together]
            at = np.minimum(s[:, None] + span, last)
            h = self.hidden[:len(s) * fresh]
            y = group[at[:, skip:]].ravel()
            got = np.empty(len(h), np.float32)
            for i in range(0, len(s), self.windows):
                rows = slice(i * fresh, min(len(s), i + self.windows) * fresh)
                h[rows, :WIDTH] = self._attended(inputs[at[i:i + self.windows]], skip)
                z = np.matmul(h[rows], self.p["head"], out=self.logits[:rows.stop - rows.start])
                got[rows] = self._picked(z, y[rows])
            r = rank[at[:, skip:]].ravel()
            order, cuts = _by_group(y, self.vocabulary.first)
            h, r, inside = h.take(order, axis=0), r.take(order), np.zeros(len(h), np.float32)
            for k in self.several:
                if cuts[k] < cuts[k + 1]:
                    some = slice(cuts[k], cuts[k + 1])
                    inside[some] = self._picked(h[some] @ self.inner[k], r[some] - self.vocabulary.first[k])
            got[order] += inside
            live = (span[skip:] < n[:, None]).ravel()
            logp[at[:, skip:].ravel()[live]] = got[live]

    def _attended(self, x: np.ndarray, skip: int) -> np.ndarray:
        """What attention makes of the inputs of windows, but for the first ``skip`` places."""
        get = lambda pair, x, skip=0: pair[0].take(x, axis=0) + pair[1][skip:]
        q, k, v = get(self.query, x[:, skip:], skip), get(self.key, x), get(self.value, x)
        w = self.weights[:len(x), :CONTEXT - skip]
        np.matmul(q, k.transpose(0, 2, 1), out=w)
        np.minimum(w, np.float32(60), out=w)
        np.exp(w, out=w)
        w *= self.mask[skip:]
        c = w @ v
        c /= (w @ self.ones[:CONTEXT])[:, :, None]
        c += get(self.plain, x[:, skip:], skip)
        return c.reshape(-1, WIDTH)

    def _picked(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log probability of the output y of each row of logits (which are overwritten)."""
        np.minimum(z, np.float32(80), out=z)
        chosen = z[np.arange(len(z)), y]
        np.exp(z, out=z)
        return chosen - np.log(np.maximum(z @ self.ones[:z.shape[1]], np.float32(1e-30)))


# ------------------------------------------------------------------ training on Spark

def _free(encoder: Encoder) -> None:
    """What a worker remembers, back to the system: an idle one stays beside those of the next pass."""
    encoder.clear()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _slices(encoder: Encoder | None, batch: pa.RecordBatch, turn: int | None = None):
    """(ids, bounds, bytes of text) of a batch of texts, or of written slices: all documents or those of a turn."""
    if "text" in batch.schema.names:
        for a, b, ids, bounds in encoder.documents(batch.column("text")):
            yield ids, bounds, batch.column("text").slice(a, b - a).nbytes
        return
    get = lambda c, i, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)
    for i in range(batch.num_rows):
        lens, sizes = get("n_ids", i, "<u4").astype(np.int64), get("sizes", i, "<u4")
        ids = get("ids", i, "<u2" if 2 * lens.sum() == batch.column("ids")[i].as_buffer().size else "<u4")
        if turn is not None:
            some = get("turns", i, np.int8) == turn
            ids, lens, sizes = ids[np.repeat(some, lens)], lens[some], sizes[some]
        if len(lens):
            yield ids, np.concatenate([[0], np.cumsum(lens)]), int(sizes.sum())


def _id_counts(size: int):
    """How often each id occurs in training documents; the two numbers after the last id stand for bytes of text and tasks."""
    def run(batches):
        for encoder in Encoder.loaded():  # the pass that encodes is over
            _free(encoder)
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for turn in range(ROUNDS):
                for ids, _, text in _slices(None, batch, turn):
                    total[:-2] += np.bincount(ids, minlength=size)
                    total[-2] += text
            total[-1] = 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])
    return run


def _windows(ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary):
    """(inputs, classes, ranks, live) of all windows end to end."""
    lens = np.diff(bounds)
    inputs = np.empty(len(ids), np.int32)
    inputs[1:] = vocabulary.input[ids[:-1]]
    inputs[bounds[:-1][lens > 0]] = START
    n = -(-lens // CONTEXT)
    doc = np.repeat(np.arange(len(lens)), n)
    start = bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * CONTEXT
    at = start[:, None] + np.arange(CONTEXT)
    live = at < bounds[1:][doc][:, None]
    at = np.minimum(at, len(ids) - 1)
    return inputs[at], vocabulary.group[ids[at]], vocabulary.rank[ids[at]], live


def _text_pieces(encoder: Encoder | None, batches, vocabulary: Vocabulary, turn: int | None = None):
    """(windows, bytes) of about ``TRAINER_BYTES`` of text at a time."""
    parts, size = [], 0
    for batch in batches:
        for ids, bounds, text in _slices(encoder, batch, turn):
            parts.append(_windows(ids, bounds, vocabulary))
            size += text
            if size >= TRAINER_BYTES:
                yield [np.concatenate(c) for c in zip(*parts, strict=True)], size
                parts, size = [], 0
    if parts:
        yield [np.concatenate(c) for c in zip(*parts, strict=True)], size


def _trained(tokenizer: str, flat, vocabulary, expected: float, turn: int | None = None):
    """Parameters times tokens, and tokens, of a trainer of about ``expected`` bytes."""
    def run(batches):
        own, grad = flat.value.copy(), np.zeros(PARAMETERS, np.float32)
        p, g, adam, words = split(own), split(grad), Adam(own, RATE), vocabulary.value
        encoder = Encoder.of(tokenizer) if turn is None else None
        rng, tokens, done = np.random.default_rng(11), 0, 0.0
        for (x, y, r, live), size in _text_pieces(encoder, batches, words, turn):
            steps, t = -(-len(x) // STEP_WINDOWS), 0
            # the steps that all of the trainer's text makes, not this piece alone, decide whether it is gone over again
            total = steps * (1 if adam.t >= STEPS else -(-STEPS // max(steps, int(steps * expected / max(1, size)))))
            while t < total:
                order = rng.permutation(len(x))
                for a in range(0, len(order), STEP_WINDOWS):
                    some = order[a:a + STEP_WINDOWS]
                    step(p, words.first, *(c.take(some, axis=0) for c in (x, y, r, live)), g)
                    # a short rise, then down to a tenth
                    adam.move(grad, min(1.0, (adam.t + 1) / 20) * (1 - 0.9 * min(1.0, (done + size * t / total) / expected)))
                    t += 1
            tokens += int(live.sum())
            done += size
        if encoder is not None:
            _free(encoder)
        give_back()
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(PARAMETERS)), pa.array(own.astype(np.float64) * tokens), pa.array(np.full(PARAMETERS, float(tokens)))],
                names=["i", "v", "w"])
    return run


@contextmanager
def _split_small(spark: SparkSession):
    """Written slices are read by enough tasks to train in parallel: they are smaller than their texts' scan."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(SPLIT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def train(docs: DataFrame, tokenizer: str) -> tuple[np.ndarray, Vocabulary]:
    """(parameters, vocabulary) from all training documents ``docs`` (text, draw: a uniform long)."""
    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out"), _turn("draw"))
    return fit(encoded(rows, tokenizer, BLOCK_WORDS), tokenizer)


def _turn(draw: str):
    return F.pmod(F.expr(f"{draw} div 1024"), F.lit(ROUNDS)).cast("int").alias("turn")


def fit(slices: DataFrame, tokenizer: str) -> tuple[np.ndarray, Vocabulary]:
    """(parameters, vocabulary) from the training documents of written slices."""
    spark = slices.sparkSession
    slices = slices.filter("ids is not null").select("sizes", "turns", "n_ids", "ids")
    n = Encoder.of(tokenizer).size
    counts = np.zeros(n + 2, np.int64)
    with _split_small(spark):
        got = slices.mapInArrow(_id_counts(n), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
        counts[got["id"].to_numpy()] = got["n"].to_numpy()
        vocabulary, size = Vocabulary(counts[:-2]), int(counts[-2]) / ROUNDS
        flat, words = initial(vocabulary), spark.sparkContext.broadcast(vocabulary)
        trainers = max(1, min(round(size / TRAINER_BYTES), int(counts[-1])))
        for turn in range(ROUNDS):
            start = spark.sparkContext.broadcast(flat)
            mean = (slices.coalesce(trainers)
                    .mapInArrow(_trained(tokenizer, start, words, max(1.0, size / trainers), turn), "i long, v double, w double")
                    .groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).toArrow())
            if mean.num_rows:
                flat = flat.copy()
                flat[mean["i"].to_numpy()] = mean["v"].to_numpy()
    return flat, vocabulary


# ------------------------------------------------------------------ slices and blocks, word counts, scores

#: a row is a slice (the documents of a block from ``first`` on: bytes of text, round or -1 for held out, ids) or a block
_ENCODED = ("block long, first long, sizes binary, turns binary, n_ids binary, ids binary, "
            "doc_ids array<long>, held array<boolean>, lens binary, words binary, counts binary, places binary")
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _encode(tokenizer: str, block_words: int):
    def run(batches):
        from pyspark import TaskContext
        encoder = Encoder.of(tokenizer)
        kind = "<u2" if encoder.size <= 1 << 16 else "<u4"
        number = TaskContext.get().partitionId() << 32
        ids, held, lens, words, n = [], [], [], [], 0

        def row(**values):
            columns = [c.split() for c in _ENCODED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([values.get(c)], _KINDS[t]) for c, t in columns], names=[c for c, _ in columns])

        def block():
            w, place = np.unique(np.concatenate(words), return_inverse=True)
            size = np.concatenate(lens)
            known = np.repeat(~np.array(held, bool), size)
            count = np.bincount(place[known], minlength=len(w))
            return row(block=number, doc_ids=ids, held=held, lens=size.astype("<i8").tobytes(), words=w.tobytes(),
                       counts=count.astype("<u4").tobytes(), places=place.astype("<u4").tobytes())

        for batch in batches:
            keys, out, col = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")
            turns = np.where(batch.column("held_out").to_numpy(zero_copy_only=False), -1, batch.column("turn").to_numpy()).astype(np.int8)
            for a, b, offsets, _, _, _, bounds, h in hashed_rows(col):
                first = len(ids)
                words.append(np.insert(h, bounds[1:], END_WORD))
                lens.append(np.diff(bounds) + 1)
                ids += keys[a:b]
                held += out[a:b]
                for c, d, i, o in encoder.documents(col.slice(a, b - a)):
                    yield row(block=number, first=first + c, sizes=np.diff(offsets[c:d + 1]).astype("<u4").tobytes(),
                              turns=turns[a + c:a + d].tobytes(), n_ids=np.diff(o).astype("<u4").tobytes(), ids=i.astype(kind).tobytes())
                n += len(words[-1])
                if n >= block_words:
                    yield block()
                    number += 1
                    ids, held, lens, words, n = [], [], [], [], 0
        if ids:
            yield block()
        give_back()  # the encoder's words stay for the worker's next task of this pass
    return run


def encoded(rows: DataFrame, tokenizer: str, block_words: int) -> DataFrame:
    """Slices and blocks of all rows (doc_id, text, held_out, turn), written once."""
    rows = rows.select("doc_id", "text", "held_out", "turn")
    return written(rows.mapInArrow(_encode(tokenizer, block_words), _ENCODED), "encoded", compression="zstd")


def _slice_scores(flat, vocabulary):
    """(block, place, c, score) of every document of written slices."""
    def run(batches):
        scorer = Scorer(flat.value, vocabulary.value)
        for batch in batches:
            for i in range(batch.num_rows):
                for ids, bounds, _ in _slices(None, batch.slice(i, 1)):
                    score = scorer.documents(ids, bounds) / np.log(10)
                    place = batch.column("first")[i].as_py() + np.arange(len(score))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(score), batch.column("block")[i].as_py())), pa.array(place.astype(np.int32)),
                         pa.array(np.full(len(score), -1)), pa.array(score)], names=["block", "place", "c", "score"])
        give_back()
    return run


def _block_words(batches):
    """(block, place, word, n) of every distinct word of the blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            w = np.frombuffer(batch.column("words")[i].as_buffer(), np.int64)
            n = np.frombuffer(batch.column("counts")[i].as_buffer(), "<u4").astype(np.int64)
            for a in range(0, len(w), 100_000):
                part = len(w[a:a + 100_000])
                block = np.full(part, batch.column("block")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.arange(a, a + part, dtype=np.int32)), pa.array(w[a:a + part]),
                                                  pa.array(n[a:a + part])], names=["block", "place", "word", "n"])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(total: int, distinct: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        place_of, count, score = (right[c].to_numpy() for c in ("place", "c", "score"))
        word = count >= 0  # the other rows hold a document's score
        for row in left.to_batches():
            for i in range(row.num_rows):
                get = lambda c, t: np.frombuffer(row.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                c = np.zeros(row.column("distinct")[i].as_py(), np.int64)
                c[place_of[word]] = count[word]
                lens, place = get("lens", "<i8"), get("places", "<u4")
                scores = np.empty(len(lens))
                scores[place_of[~word]] = score[~word]
                at = np.cumsum(lens) - lens
                base = np.add.reduceat(np.log10(c + 1.0)[place], at) - lens * np.log10(total + distinct + 1.0)
                known = np.add.reduceat((c > 0).astype(np.int64)[place], at)
                out.append(pa.Table.from_arrays(
                    [row.column("doc_ids")[i].values, row.column("held")[i].values, pa.array(lens), pa.array(known),
                     pa.array(np.full(len(lens), total)), pa.array(base), pa.array(scores)],
                    names=[x.split()[0] for x in _SCORED.split(", ")]))
        return pa.concat_tables(out)
    return run


def score_documents(docs: DataFrame, tokenizer: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    docs: doc_id and text; further columns are ignored. Documents whose crc32(doc_id as text) mod 7 is
    2 are held out; a null doc_id is not. A null text is empty: its one token is the end. Repeated
    rows count and are scored each for itself; without training documents all counts are 0 and
    the model stays as initialised; an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    rows = rows.select("*", held.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("draw"))
    parts = encoded(rows.select("doc_id", "text", "held_out", _turn("draw")), tokenizer, block_words)
    flat, vocabulary = fit(parts, tokenizer)
    send = spark.sparkContext.broadcast
    with _split_small(spark):
        scores = written(parts.filter("ids is not null").select("block", "first", "sizes", "n_ids", "ids")
                         .mapInArrow(_slice_scores(send(flat), send(vocabulary)), "block long, place int, c long, score double"), "scores")
    blocks = parts.filter("ids is null")
    own = blocks.select("block", "words", "counts").mapInArrow(_block_words, "block long, place int, word long, n long")
    counts = written(own.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "counts")
    n = counts.agg(F.sum("c").alias("total"), F.count("c").alias("distinct")).first()
    discard(spark, [])  # the shuffles of training and of counting
    back = own.select("block", "place", "word").join(counts, "word").select("block", "place", F.col("c").cast("long"), F.lit(0.0).alias("score"))
    blocks = blocks.select("block", "doc_ids", "held", "lens", F.expr("cast(octet_length(words) div 8 as int)").alias("distinct"), "places")
    return (blocks.groupBy("block").cogroup(back.union(scores).groupBy("block"))
            .applyInArrow(_scored(int(n["total"] or 0), int(n["distinct"] or 0)), _SCORED))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document."""
    return score_documents(source(spark, sf_dir, "documents", "doc_id", "text"), default_path())
