"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct word shingles. Two documents link when their sets' Jaccard
similarity reaches the threshold; the result is each document's component under these links.

1. Equal sets are one set (``set_id``, a hash of the set); everything below works on sets.
2. Sizes fall into bands [l, floor(l / t)]. A set takes part in its own band's instance and
   the next one's, so any two similar sets meet in one instance. There their Hamming distance
   is at most ``k = floor(2 u (1 - t) / (1 + t))`` (u: the instance's largest size).
3. PartEnum: shingles are hashed into ``n1`` parts of ``n2`` sub-parts. By the pigeonhole
   principle some part differs in at most ``k2`` shingles, so for some choice of ``n2 - k2`` of
   its sub-parts both sets hold the same shingles there: one signature in common. ``(n1, n2,
   k2)`` is picked per instance: fewest signatures with enough shingles behind each.
4. Shingles that many documents share (a license, a common passage) take no part in signatures at
   first: without them the distance of two sets is no larger, so the principle holds, and sets with
   nothing else in common no longer meet. Which shingles these are is estimated on a share of the
   documents; that decides cost only, never a result.
5. A choice of empty sub-parts says nothing and would gather all sets, so it gives no signature.
   ``n1`` has room for ``z`` parts lost that way. Two sets can miss each other only if both
   lose more; such sets meet again under another hash, then with all their shingles, and in the
   last round empty choices give signatures too. No similar pair is lost.
6. Sets with a common signature are candidates. First each group's sets are held against one of them
   (stars, linear in the group's size), then, in a share of the groups, against their nearest by
   histogram, unless they are in one component already; in the end, only pairs of a group's sets in different components are left,
   and only those that the bounds below let through. Where these are more than the group's sets, no pair leaves the
   task: the group's whole sets are brought together in blocks of bounded bytes, verified there, and only links that join
   two components are given, so what leaves a task is linear in the group's size.
   Sizes, the number of shingles that no other candidate has, and histograms bound the common
   shingles from above, and rule sets and pairs out without an error; the others are verified on
   the whole sets.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb, erfc, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import discard, filter_positions, hash_filter, hashes_in, made, membership_filter, ready, source, test_bits, written
from trustlens.llm.components import components
from trustlens.llm.words import hashed_rows, mix, shingles

SHINGLE = 5
#: the threshold as a fraction: 100 * intersection >= 80 * union
THRESHOLD = (80, 100)
#: hash rounds for sets with many empty parts, and how many of them leave frequent shingles out
ROUNDS, RARE_ROUNDS = 5, 2
#: one in so many documents is looked through for frequent shingles; so many of them must hold one
SAMPLE, FREQUENT = 16, 3
#: rounds in which a group's sets are held against one of them, another each time
STARS = 1
#: then each set is held against its nearest candidate in one in so many groups
NEAREST = 8
#: sets of a group that are held against one another in one piece, and their shingles
BLOCK, BLOCK_SHINGLES = 4000, 1 << 21
#: shingles expected behind a signature of an instance's smallest sets
LEAST_FEATURES = 2.5
#: signatures in one Arrow batch
OUT_ROWS = 200_000


# ------------------------------------------------------------------ sets

def document_sets(col: pa.Array, size: int = SHINGLE, wanted=None):
    """(row, sorted distinct shingle hashes) for each row (of those ``wanted``)."""
    for a, b, _, _, _, _, bounds, h in hashed_rows(col):
        windows = shingles(h, size)
        for i in range(b - a):
            if wanted is not None and not wanted[a + i]:
                continue
            s, e = int(bounds[i]), int(bounds[i + 1])
            if e - s >= size:
                yield a + i, np.unique(windows[s:e - size + 1])
            elif e > s:
                yield a + i, shingles(h[s:e], e - s) + np.uint64(e - s)
            else:
                yield a + i, np.zeros(0, np.uint64)


def set_id(elements: np.ndarray) -> int | None:
    """A signed 64-bit id of a set, None of the empty set."""
    if len(elements) == 0:
        return None
    total = mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(elements))
    return int(mix(np.array([total])).view(np.int64)[0])


# ------------------------------------------------------------------ PartEnum

@lru_cache(maxsize=None)
def bands(upto: int, num: int = THRESHOLD[0], den: int = THRESHOLD[1]) -> list[tuple[int, int]]:
    """Size bands [l, u] that reach ``upto``, from size 1 on."""
    out, low = [], 1
    while not out or out[-1][1] < upto:
        out.append((low, low * den // num))
        low = out[-1][1] + 1
    return out


def band_of(size: int, num: int = THRESHOLD[0], den: int = THRESHOLD[1]) -> int:
    table = bands(1 << max(10, size.bit_length()), num, den)
    return next(i for i, (_, u) in enumerate(table) if size <= u)


def _more_than(z: int, n: int, p: float) -> float:
    """Chance of more than z of n, each with chance p."""
    mean, sd = n * p, sqrt(n * p * (1 - p))
    if sd == 0:
        return float(mean > z)
    if n > 30:
        return 0.5 * erfc((z + 0.5 - mean) / (sd * sqrt(2)))
    return 1 - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(z + 1))


@lru_cache(maxsize=None)
def plan(instance: int, num: int = THRESHOLD[0], den: int = THRESHOLD[1]) -> tuple[int, int, int, int] | None:
    """(n1, n2, k2, z) of an instance; None where similar sets must be equal."""
    table = bands(1 << 10, num, den)
    while len(table) <= instance:
        table = bands(2 * table[-1][1], num, den)
    least, most = table[max(0, instance - 1)][0], table[instance][1]
    k = 2 * most * (den - num) // (den + num)
    if k == 0:
        return None
    options = []
    for k2 in range(min(k, 5) + 1):
        for n2 in range(k2 + 1, k2 + 4):
            start = k // (k2 + 1) + 1
            for n1 in range(start, 2 * start + 10):
                features = least * (n2 - k2) / (n1 * n2)
                void = min(1.0, comb(n2, k2) * exp(-features))
                again = _more_than(n1 - start, n1, void)  # the share of sets that need another round
                cost = n1 * comb(n2, k2) * (1 + again)
                options.append((cost * max(1.0, again / 0.05) * max(1.0, LEAST_FEATURES / features) ** 2, (n1, n2, k2, n1 - start)))
    return min(options)[1]


class Parts:
    """A set's elements and their places in [0, 2**32), round by round; worked out once for all instances."""

    def __init__(self, whole: np.ndarray, rare: np.ndarray):
        self.whole, self.rare, self.rounds = whole, rare, []

    def round(self, turn: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.rounds) <= turn:
            n = len(self.rounds)
            elements = self.rare if n < RARE_ROUNDS else self.whole
            # elements are hashes themselves; sums of them are mixed once more
            self.rounds.append((elements, mix(elements + np.uint64((n + 1) * 0x1000193)) >> np.uint64(32)))
        return self.rounds[turn]


def signatures(parts: Parts, instance: int, num: int, den: int) -> list[np.ndarray]:
    """The signatures of one set in one instance."""
    found = plan(instance, num, den)
    if found is None:
        return []
    n1, n2, k2, z = found
    out = []
    for turn in range(ROUNDS):
        own, place = parts.round(turn)
        place = ((place * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, place, own)
        held = np.bincount(place, minlength=n1 * n2).reshape(n1, n2)
        sums, lost = sums.reshape(n1, n2), np.zeros(n1, bool)
        for which, chosen in enumerate(combinations(range(n2), n2 - k2)):
            count = held[:, chosen].sum(1)
            lost |= count == 0
            ids = (np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(which)) * np.uint64(0xD1342543DE82EF95)
            ids += np.uint64((instance * ROUNDS + turn) * 0xAF251AF3B0F025B5 & 0xFFFFFFFFFFFFFFFF)
            sig = mix(mix(ids) + sums[:, chosen].sum(1, dtype=np.uint64))
            out.append(sig if turn == ROUNDS - 1 else sig[count > 0])
        if int(lost.sum()) <= z:
            break
    return out


# ------------------------------------------------------------------ passes over the texts

def _sizes(size: int):
    def run(batches):
        for batch in batches:
            n, ids = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for row, s in document_sets(batch.column("text"), size):
                n[row], ids[row] = len(s), set_id(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(ids, pa.int64())],
                                             names=["doc_id", "n_shingles", "set_id"])
    return run


def _counted(size: int):
    """(element, n): in how many sets of a batch."""
    def run(batches):
        for batch in batches:
            sets = [s for _, s in document_sets(batch.column("text"), size)]
            e, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(n)], names=["element", "n"])
    return run


def _signed(size: int, num: int, den: int, frequent):
    def run(batches):
        seen: set[int] = set()  # equal sets of one task are signed once
        sig, ids, held = [], [], 0
        out = lambda: pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(ids))], names=["sig", "set_id"])
        for batch in batches:
            for _, s in document_sets(batch.column("text"), size):
                own = set_id(s)
                if own is None or own in seen:
                    continue
                seen.add(own)
                parts, at = Parts(s, np.delete(s, hashes_in(frequent.value, s))), band_of(len(s), num, den)
                for instance in (at, at + 1):
                    got = signatures(parts, instance, num, den)
                    sig += got
                    made = sum(map(len, got))
                    ids.append(np.full(made, own, np.int64))
                    held += made
                if held > OUT_ROWS:
                    yield out()
                    sig, ids, held = [], [], 0
        if held:
            yield out()
    return run


def _sets(size: int, bits):
    """The whole sets of the documents that the filter lets through."""
    def run(batches):
        for batch in batches:
            at = batch.column("at").flatten().to_numpy().reshape(-1, 3)
            wanted = test_bits(bits.value, at)
            ids, blobs, counts, held = [], [], [], 0
            out = lambda: pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(counts, pa.binary()), pa.array(blobs, pa.binary())], names=["set_id", "counts", "elements"])  # noqa: B023
            for _, s in document_sets(batch.column("text"), size, wanted):
                if len(s):
                    ids.append(set_id(s))
                    blobs.append(s.tobytes())
                    counts.append(histogram(s).tobytes())
                    held += len(blobs[-1])
                if held > 1 << 23:
                    yield out()
                    ids, blobs, counts, held = [], [], [], 0
            if ids:
                yield out()
    return run


def _elements(batches):
    """(element, set_id) of whole sets."""
    for batch in batches:
        blobs, ids = batch.column("elements"), batch.column("set_id").to_numpy()
        for a in range(0, len(ids), 200):
            sets = [np.frombuffer(b.as_buffer(), np.int64) for b in blobs[a:a + 200]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(ids[a:a + 200], [len(s) for s in sets]))],
                                             names=["element", "set_id"])


def histogram(elements: np.ndarray) -> np.ndarray:
    """Counts of a set's elements by hash, in one to two buckets an element (at most 255 each)."""
    buckets = 1 << max(0, len(elements).bit_length() - 1)
    return np.minimum(np.bincount((elements >> np.uint64(20)).astype(np.int64) & (buckets - 1), minlength=buckets), 255).astype(np.uint8)


def at_least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the Hamming distance of two sets from their histograms."""
    if len(x) < len(y):
        x, y = y, x
    x = x.astype(np.int64).reshape(-1, len(y)).sum(0)
    return int(np.abs(np.minimum(x, 255) - y.astype(np.int64)).sum())


# ------------------------------------------------------------------ groups and candidates

def _shared(batches):
    """Rows sorted by sig -> (sig, leader, member) of signatures with two sets or more; the leader is
    the group's first. No group is held in memory; a set may come several times."""
    last_sig = leader = None
    for batch in batches:
        sig, own = batch.column("sig").to_numpy(), batch.column("set_id").to_numpy()
        n = len(sig)
        if n == 0:
            continue
        new = np.ones(n, bool)
        new[1:] = sig[1:] != sig[:-1]
        if last_sig is not None:
            new[0] = sig[0] != last_sig
        first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        lead = own[np.maximum(first, 0)]
        if leader is not None:
            lead = np.where(first < 0, leader, lead)
        keep = own != lead
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(lead[keep]), pa.array(own[keep])],
                                             names=["sig", "leader", "member"])
        last_sig, leader = sig[-1], lead[-1]


def _near(num: int, den: int):
    """Pairs that their histograms don't show to be too far apart."""
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in ("left_set", "right_set"))
                total = batch.column("total")[i].as_py()
                keep[i] = (den + num) * at_least_apart(x, y) <= (den - num) * total
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))
    return run


class Piece:
    """The rows of a group's one or two blocks, and which pairs of them neither sizes, nor shingles of their own, nor
    histograms rule out."""

    names = ("set_id", "root", "n", "common", "counts", "block", "i", "j")

    def __init__(self, rows: list, num: int, den: int):
        self.num, self.den = num, den
        self.ids, self.root, self.n, self.common = (np.array([r[c] for r in rows], np.int64) for c in range(4))
        sets = [np.frombuffer(r[4], np.uint8) for r in rows]
        width = min(map(len, sets))
        self.counts = np.stack([np.minimum(s.reshape(-1, width).sum(0, dtype=np.int64), 255) for s in sets]).astype(np.int16)
        self.block = np.array([r[5] for r in rows])
        self.crossing = rows[0][6] != rows[0][7]  # two blocks: pairs across them only

    def partners(self, x: int, root: np.ndarray, nearest: bool = False) -> np.ndarray:
        """Later rows in other components that row x may link with; ``nearest``: that of the nearest histogram."""
        y = np.arange(x + 1, len(self.ids))
        y = y[(root[y] != root[x]) & (self.ids[y] != self.ids[x])]
        if self.crossing:
            y = y[self.block[y] != self.block[x]]
        total = self.n[x] + self.n[y]
        y, total = (v[(self.num + self.den) * np.minimum(self.common[x], self.common[y]) >= self.num * total] for v in (y, total))
        apart = np.abs(self.counts[y] - self.counts[x]).sum(1)
        fits = (self.den + self.num) * apart <= (self.den - self.num) * total
        if nearest and fits.any():
            fits = np.arange(len(y)) == np.where(fits, apart, apart.max() + 1).argmin()
        return y[fits]


def _pieces(batches, columns: tuple[str, ...]):
    """((sig, i, j), rows) of rows sorted by them."""
    key, rows = None, []
    for batch in batches:
        for k, *row in zip(batch.column("sig").to_pylist(), *[batch.column(c).to_pylist() for c in columns], strict=True):
            own = k, row[6], row[7]
            if own != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = own, []
            rows.append(row)
    if len(rows) > 1:
        yield key, rows


def _pairs(found: list) -> pa.RecordBatch:
    kinds = (("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def _left_pairs(num: int, den: int, nearest: bool = False):
    """Rows sorted by (sig, i, j) -> the pairs (a, b) of a piece that may link, at most as many as its rows; a piece
    with more of them gives its key with each set that has a partner (a) instead. ``nearest``: one pair for each row at most."""
    def run(batches):
        found = []
        for key, rows in _pieces(batches, Piece.names):
            piece, own, met = Piece(rows, num, den), [], np.zeros(len(rows), bool)
            for x in range(len(rows) - 1):
                y = piece.partners(x, piece.root, nearest)
                met[y] = True
                met[x] |= len(y) > 0
                if len(own) <= len(rows):
                    own += [(min(piece.ids[x], piece.ids[z]), max(piece.ids[x], piece.ids[z]), None, None, None) for z in y.tolist()]
            if len(own) > len(rows):
                own = [(x, None, *key) for x in piece.ids[met].tolist()]
            found += own
            if len(found) > OUT_ROWS:
                yield _pairs(found)
                found = []
        yield _pairs(found)
    return run


def _joined(num: int, den: int):
    """Rows sorted by (sig, i, j) with whole sets -> links (a, b) that join components, at most a row less than a piece has."""
    def run(batches):
        for _, rows in _pieces(batches, (*Piece.names[:4], "elements", *Piece.names[5:])):
            found, sets = [], [np.frombuffer(r[4], np.uint64) for r in rows]
            piece = Piece([[*r[:4], histogram(s).tobytes(), *r[5:]] for r, s in zip(rows, sets, strict=True)], num, den)
            root = piece.root.copy()
            for x in range(len(rows) - 1):
                for y in piece.partners(x, root).tolist():
                    if root[x] == root[y]:
                        continue
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if den * common >= num * (len(sets[x]) + len(sets[y]) - common):
                        found.append((piece.ids[x], piece.ids[y], None, None, None))
                        root[root == root[y]] = root[x]
            yield _pairs(found).select(["a", "b"])
    return run


def _verified(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column("left_set"), batch.column("right_set")
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))
    return run


def _possible(num: int, den: int):
    """Whether sets of sizes na and nb, of which ca and cb shingles are in other sets too, may reach the
    threshold: they have at most min(ca, cb) in common, and need num / (num + den) of na + nb."""
    return F.lit(num + den) * F.least("ca", "cb") >= F.lit(num) * (F.col("na") + F.col("nb"))


def _with_sets(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    return (pairs.join(sets.select(F.col("set_id").alias("a"), F.col(column).alias("left_set")), "a")
            .join(sets.select(F.col("set_id").alias("b"), F.col(column).alias("right_set")), "b"))


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) of set ids, those whose sets reach the threshold. Pairs with ``total`` (both sizes) are held
    against their histograms first; of the others all bounds were looked at."""
    if "total" in pairs.columns:
        pairs = _with_sets(pairs, sets, "counts").mapInArrow(_near(num, den), "a long, b long")
    return _with_sets(pairs, sets, "elements").mapInArrow(_verified(num, den), "a long, b long")


def _blocked(members: DataFrame) -> DataFrame:
    """The groups' rows with ``block``, ``i`` and ``j``: a group of more than BLOCK sets or BLOCK_SHINGLES shingles is cut
    into blocks, and a row goes to each pair of blocks that holds its own."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = members.groupBy("sig").agg(blocks.alias("blocks")).filter("blocks > 1")
    rows = members.join(large, "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    one = rows.filter("blocks = 1").withColumn("other", F.lit(0))
    more = rows.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (one.unionByName(more).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            .drop("blocks", "other"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links (a, b) of nodes: only components that links join are worked on."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    up = components(links.join(of("a"), "a").join(of("b"), "b"), "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return written(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The groups (sig, set_id, n, common) with ``root``, but for those in one component."""
    rooted = members.join(roots.withColumnRenamed("node", "set_id"), "set_id")
    mixed = rooted.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("sig")
    return rooted.join(mixed, "sig", "left_semi")


def ngram_components(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) for every row of ``docs`` (doc_id, text, ...).

    A null or empty text, or one of white space, has the empty set, links with nothing and is its
    own component. Repeated texts and rows are in one component; the component's id is its least
    doc_id. An empty table gives an empty result; further columns are ignored.
    """
    spark = ready(docs.sparkSession)
    num, den = threshold
    begun = len(made())
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = written(texts.mapInArrow(_sizes(size), "doc_id long, n_shingles long, set_id long"), "sets")
    classes = (named.filter("set_id is not null").groupBy("set_id")
               .agg(F.min("doc_id").alias("first_doc"), F.max("n_shingles").alias("n")))

    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    often = (sample.mapInArrow(_counted(size), "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= FREQUENT).select(F.array("element").alias("elements")))
    frequent = spark.sparkContext.broadcast(hash_filter(often, "elements"))
    signed = texts.select("text").mapInArrow(_signed(size, num, den, frequent), "sig long, set_id long")
    groups = written(signed.repartition("sig").sortWithinPartitions("sig")
                     .mapInArrow(_shared, "sig long, leader long, member long"), "groups")
    discard(spark, [])  # the signatures' shuffle
    met = written(groups.select(F.col("leader").alias("set_id")).union(groups.select("member")).distinct()
                  .join(classes, "set_id"), "met")

    bits = spark.sparkContext.broadcast(membership_filter(met, "first_doc"))
    sets = written(texts.select("text", filter_positions("doc_id").alias("at"))
                   .mapInArrow(_sets(size, bits), "set_id long, counts binary, elements binary")
                   .join(met.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), "elements")

    discard(spark, [])
    # shingles that no other candidate has; sets with too many of them have no links
    alone = (sets.select("set_id", "elements").mapInArrow(_elements, "element long, set_id long")
             .groupBy("element").agg(F.count(F.lit(1)).alias("sets"), F.min("set_id").alias("set_id"))
             .filter("sets = 1").groupBy("set_id").agg(F.count(F.lit(1)).alias("alone")))
    met = written(met.join(alone, "set_id", "left").select("set_id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
                  .filter(F.lit(den) * F.col("common") >= F.lit(num) * F.col("n")), "met")

    members = written(groups.select("sig", F.col("member").alias("set_id")).unionByName(groups.select("sig", F.col("leader").alias("set_id")))
                      .distinct().join(met, "set_id"), "members")

    # stars: of every group's sets those not yet in the leader's component, and in the first round only
    # one leader for each set
    tested, roots = None, met.select(F.col("set_id").alias("node"), F.col("set_id").alias("root"))
    for turn in range(STARS):
        open_ = _open(members, roots)
        lead = open_.groupBy("sig").agg(F.min_by(F.struct("set_id", "root", "n", "common"), F.xxhash64("set_id", F.lit(turn))).alias("l"))
        pairs = (open_.join(lead, "sig").filter(F.col("root") != F.col("l.root"))
                 .select(F.least("set_id", "l.set_id").alias("a"), F.greatest("set_id", "l.set_id").alias("b"), F.col("set_id").alias("m"),
                         F.col("n").alias("na"), F.col("l.n").alias("nb"), F.col("common").alias("ca"), F.col("l.common").alias("cb"))
                 .filter(_possible(num, den)))
        pairs = pairs.withColumn("total", F.col("na") + F.col("nb"))
        if turn == 0:
            pairs = pairs.groupBy("m").agg(F.min(F.struct("a", "b", "total")).alias("p")).select("p.*")
        pairs = pairs.select("a", "b", "total").distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "stars")
        if not pairs.take(1):
            break
        links, pairs = _links(pairs, sets, num, den), pairs.select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = _merged(roots, written(links, "links"))

    def pieces(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(sets.select("set_id", column), "set_id").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def left(rows: DataFrame, nearest: bool) -> DataFrame:
        return pieces(rows, "counts").mapInArrow(_left_pairs(num, den, nearest), "a long, b long, sig long, i int, j int")

    some = _open(members.filter(F.pmod("sig", F.lit(NEAREST)) == 0), roots)
    pairs = left(_blocked(some), True).select("a", "b").distinct()
    pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "nearest")
    tested = pairs if tested is None else tested.unionByName(pairs)
    roots = _merged(roots, written(_links(pairs, sets, num, den), "links"))

    # what is left: pairs of a group's sets in different components; of groups of the same sets one
    open_ = written(_open(members, roots), "open")
    alike = (open_.groupBy("sig").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("sum"))
             .groupBy("sets", "sum").agg(F.min("sig").alias("sig")).select("sig"))
    if open_.take(1):
        blocked = written(_blocked(open_.join(alike, "sig", "left_semi")), "blocked")
        found = written(left(blocked, False), "left")
        rest = found.filter("b is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        links = _links(rest, sets, num, den)
        many = found.filter("b is null").select(F.col("a").alias("set_id"), "sig", "i", "j")
        if many.take(1):
            whole = pieces(blocked.join(many, ["set_id", "sig", "i", "j"], "left_semi"), "elements")
            links = links.unionByName(whole.mapInArrow(_joined(num, den), "a long, b long"))
        roots = _merged(roots, written(links, "links"))

    final = (classes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
             .select("set_id", "first_doc", F.coalesce("root", "set_id").alias("root")))
    least = final.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    ids = written(final.join(least, "root").select("set_id", "component_id"), "ids")
    discard(spark, made()[begun + 1:-1])  # all but ``named`` and ``ids``
    return (named.join(ids, "set_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under Jaccard >= 0.8 of 5-word shingles."""
    return ngram_components(source(spark, sf_dir, "documents", "doc_id", "text"))
