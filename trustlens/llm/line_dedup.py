"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without outer white space, A-Z lower-cased; keys of a least length count, by a 128-bit
digest. The index has three tables in the shared folder:

* ``refs`` (a, b, doc_id): a row for every key and document that holds it, the exact references;
* ``keys`` (shard, a, b, refs, first): their number and the least doc_id, exact;
* ``filters`` (shard, slots, stash): a cuckoo filter over each shard's keys.

An insertion tests the distinct keys of its documents against the shards' filters: keys that test negative are new
and go to the tables as they are; only the others are looked up in the exact tables. A deletion takes a document's
references away, counts the touched keys anew and removes the fingerprints of keys without references, so that
it undoes an insertion. Shards follow the digest, so they are even whatever the lines are; a line that a third of
all documents hold is one key, counted in the tasks that read it before anything moves.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import ready, source, written
from trustlens.llm.cuckoo import CuckooFilter, fingerprints

#: keys shorter than so many code points never count
LEAST_CHARS = 10
#: keys of a shard when an index is made; it is dealt anew when there are eight times as many
SHARD_KEYS = 1 << 14
#: parts in which the registered query inserts the table
INCREMENTS = 2

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = b" \t\n\x0b\x0c\r"
KEYS, FILTERS = "shard int, a long, b long, refs long, first long", "shard int, slots binary, stash binary"


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    keys: DataFrame
    filters: DataFrame
    shards: int
    least_chars: int = LEAST_CHARS


# ------------------------------------------------------------------ lines

def line_digests(raw: bytes, least_chars: int) -> list[bytes | None]:
    """The digest of each line's key, None for keys that are too short."""
    out = []
    for line in raw.translate(_LOWER).split(b"\n"):
        key = line.strip(_BLANK)
        short = len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode("utf-8")) < least_chars
        out.append(None if short else blake2b(key, digest_size=16).digest())
    return out


def _raw(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _references(least_chars: int):
    def run(batches):
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                own = set(line_digests(_raw(text), least_chars)) - {None}
                digests += own
                ids += [doc_id] * len(own)
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(ids, pa.int64())],
                                             names=["a", "b", "doc_id"])
    return run


def _cut(least_chars: int):
    """Rows with the digests ``gone`` of a document's lines to drop -> the kept text and the counts."""
    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column("text").cast(pa.large_binary()), batch.column("gone"), strict=True):
                raw = _raw(text)
                own = raw.split(b"\n")
                if gone.is_valid and len(gone.values):
                    pairs = np.stack([gone.values.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], 1).astype(np.int64)
                    drop = {x.tobytes() for x in pairs}
                    kept = [x for x, d in zip(own, line_digests(raw, least_chars), strict=True) if d not in drop]
                    raw = b"\n".join(kept)
                    dropped.append(len(own) - len(kept))
                else:
                    dropped.append(0)
                lines.append(len(own))
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                                              pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])
    return run


# ------------------------------------------------------------------ filters

def _one(filters: pa.Table) -> CuckooFilter:
    if filters.num_rows == 0:
        return CuckooFilter()
    return CuckooFilter.loads(filters.column("slots")[0].as_py(), filters.column("stash")[0].as_py())


def _prints(keys: pa.Table) -> np.ndarray:
    return fingerprints(keys.column("a").to_numpy() ^ keys.column("b").to_numpy())


def _test(keys: pa.Table, filters: pa.Table) -> pa.Table:
    return keys.append_column("seen", pa.array(_one(filters).contains(_prints(keys))))


def _change(filters: pa.Table, born: pa.Table, dead: pa.Table) -> pa.Table:
    out = _one(filters)
    out.delete(_prints(dead))
    out.insert(_prints(born))
    shard = next(t.column("shard")[0].as_py() for t in (filters, born, dead) if t.num_rows)
    slots, stash = out.dumps()
    return pa.table({"shard": pa.array([shard], pa.int32()), "slots": [slots], "stash": [stash]})


def _changed(filters: DataFrame, keys: DataFrame, born: bool) -> DataFrame:
    """The shards' filters with the new keys, or without the dead ones."""
    def run(own, keys):
        none = keys.slice(0, 0)
        return _change(own, keys, none) if born else _change(own, none, keys)
    return filters.groupBy("shard").cogroup(keys.select("shard", "a", "b").groupBy("shard")).applyInArrow(run, FILTERS)


# ------------------------------------------------------------------ the index

def _shard(shards: int):
    return F.pmod("a", F.lit(shards)).cast("int")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"))


def _indexed(refs: DataFrame, keys: DataFrame, shards: int, least_chars: int) -> LineIndex:
    """The index over exact tables, with filters from the keys."""
    keys = written(keys.withColumn("shard", _shard(shards)).select("shard", "a", "b", "refs", "first"), "line-keys")
    none = keys.sparkSession.createDataFrame([], FILTERS)
    return LineIndex(refs, keys, written(_changed(none, keys, True), "line-filters"), shards, least_chars)


def insert(index: LineIndex | None, docs: DataFrame, least_chars: int = LEAST_CHARS) -> LineIndex:
    """The index (None: an empty one) with the lines of ``docs`` (doc_id, text, ...) as well.

    Rows of one doc_id are one document. A document that is already in is not counted twice. Rows without doc_id
    count for nothing; a null or empty text has one empty line, which is too short to count. Further columns
    are ignored; an empty table changes nothing.
    """
    ready(docs.sparkSession)
    least_chars = index.least_chars if index else least_chars
    refs = _texts(docs).filter("doc_id is not null").mapInArrow(_references(least_chars), "a long, b long, doc_id long")
    refs = written(refs.distinct(), "line-refs")
    if index is None:
        # there are no more keys than references
        return _indexed(refs, _counted(refs), max(1, -(-refs.count() // SHARD_KEYS)), least_chars)

    own = _counted(refs).withColumn("shard", _shard(index.shards)).select("shard", "a", "b", "refs", "first")
    tested = own.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(_test, f"{KEYS}, seen boolean")
    maybe = written(tested.filter("seen").select("a", "b"), "line-maybe")
    # keys that may be known: their references that are not in the exact table yet; all references of the others
    more = refs.join(maybe, ["a", "b"], "left_semi").join(index.refs, ["a", "b", "doc_id"], "left_anti")
    more = written(refs.join(maybe, ["a", "b"], "left_anti").unionByName(more), "line-more")
    delta = _counted(more).withColumn("shard", _shard(index.shards))
    keys = (index.keys.unionByName(delta).groupBy("shard", "a", "b")
            .agg(F.sum("refs").alias("refs"), F.min("first").alias("first")))
    all_refs = index.refs.unionByName(more)
    keys = written(keys, "line-keys")
    n = keys.count()
    if n > 8 * SHARD_KEYS * index.shards:
        return _indexed(all_refs, keys, -(-n // SHARD_KEYS), least_chars)
    born = delta.join(index.keys, ["a", "b"], "left_anti")
    return LineIndex(all_refs, keys, written(_changed(index.filters, born, True), "line-filters"), index.shards, least_chars)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents in ``doc_ids`` (doc_id, ...); those that it does not hold change nothing."""
    ids = doc_ids.select(F.col("doc_id").cast("long")).distinct()
    touched = index.refs.join(ids, "doc_id", "left_semi").select("a", "b").distinct()
    touched = written(touched, "line-touched")
    refs = written(index.refs.join(ids, "doc_id", "left_anti").select("a", "b", "doc_id"), "line-refs")
    left = written(_counted(refs.join(touched, ["a", "b"], "left_semi")), "line-left")
    keys = index.keys.join(touched, ["a", "b"], "left_anti").unionByName(left.withColumn("shard", _shard(index.shards)))
    dead = touched.join(left, ["a", "b"], "left_anti").withColumn("shard", _shard(index.shards))
    return LineIndex(refs, written(keys.select("shard", "a", "b", "refs", "first"), "line-keys"),
                     written(_changed(index.filters, dead, False), "line-filters"), index.shards, index.least_chars)


def kept_lines(index: LineIndex, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of ``docs`` (doc_id, text, ...), whose documents the index
    holds: lines of keys with two references or more go, but in the least doc_id; the others stay as they are,
    joined by a newline. A row without doc_id keeps all lines, and so does a document that is not in the index."""
    ready(docs.sparkSession)
    shared = index.keys.filter("refs > 1").select("a", "b", "first")
    gone = (index.refs.join(shared, ["a", "b"]).filter("doc_id <> first")
            .groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("gone")))
    texts = _texts(docs)
    rows = texts.filter("doc_id is not null").join(gone, "doc_id", "left")
    rows = rows.unionByName(texts.filter("doc_id is null"), allowMissingColumns=True)
    return rows.mapInArrow(_cut(index.least_chars), "doc_id long, n_lines long, n_dropped long, kept string")


def deduped(docs: DataFrame, increments: int = INCREMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``kept_lines`` of ``docs`` after they were all inserted, in so many parts; their number changes no row."""
    index = None
    for i in range(increments):
        index = insert(index, docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(increments)) == i), least_chars)
    return kept_lines(index, docs)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the lines that a document of a smaller doc_id holds too."""
    out = deduped(source(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS holder FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT doc_id, pos, line, holder IS NOT NULL AND holder <> doc_id AS dropped FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
