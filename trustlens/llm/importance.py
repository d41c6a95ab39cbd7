"""Target-distribution importance resampling with segment deduplication.

Texts are cut into lines at newlines. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased;
features are the runs of up to ``size`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of
its UTF-8 bytes modulo ``buckets``. Newlines are no word characters, so every feature lies in one line or crosses lines:

* ``lines`` holds each distinct line of the corpus once, with the buckets of its features, worked out once, and its
  occurrences; corpus counts are the sums of buckets times occurrences;
* ``held`` holds which row has which line how often (a 128-bit digest stands for the line);
* features that cross lines depend on the lines around, so they are counted by row, apart from the lines.

A bucket's gain compares its smoothed share of the target (``benchmark``) and of the corpus. A line's weight is the
sum of its features' gains; a row's weight is the sum over its lines, by occurrences, and its crossing features. Gumbel
noise from a hash of the doc_id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens.llm.common import ready, source, written

#: longest feature in words, number of buckets
SIZE, BUCKETS = 1, 10_000
#: rows with so many words are drawn from; so many per cent of them; the hash's seed
LEAST_WORDS, PER_CENT, SEED = 20, 10, 2024
#: distinct words whose buckets a task remembers at a time
REMEMBERED = 1 << 18

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: in UTF-8 all bytes of other characters than ASCII's are 0x80 and above
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LINES = "a long, b long, n long, words int, features binary"


def _raw(text) -> bytes:
    return text.as_buffer().to_pybytes().translate(_LOWER) if text.is_valid else b""


def _digest(line: bytes) -> bytes:
    return blake2b(line, digest_size=16).digest()


def _pairs(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, i].copy()) for i in (0, 1)]


class Buckets:
    """Buckets of features; those of single words are remembered."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def word(self, word: bytes) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = crc32(word) % self.buckets
        return got

    def inside(self, words: list[bytes], size: int) -> list[int]:
        """Of all features of one line."""
        out = [self.word(w) for w in words]
        for k in range(2, size + 1):
            out += [crc32(b" ".join(words[i:i + k])) % self.buckets for i in range(len(words) - k + 1)]
        return out

    def across(self, lines: list[list[bytes]], size: int) -> list[int]:
        """Of the features that hold words of several lines."""
        words = [w for line in lines for w in line]
        line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        out = []
        for k in range(2, size + 1):
            for i in np.flatnonzero(line[k - 1:] != line[:len(line) - k + 1]).tolist():
                out.append(crc32(b" ".join(words[i:i + k])) % self.buckets)
        return out


# ------------------------------------------------------------------ passes over texts and lines

def _segments(batches):
    """(line, n): the distinct lines of a batch that hold a word."""
    for batch in batches:
        n: Counter = Counter()
        for text in batch.column("text").cast(pa.large_binary()):
            n.update(_raw(text).split(b"\n"))
        lines = [x for x in n if _WORD.search(x)]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array([n[x] for x in lines], pa.int64())], names=["line", "n"])


def _featured(size: int, buckets: int):
    def run(batches):
        of = Buckets(buckets)
        for batch in batches:
            digests, words, features = [], [], []
            for line in batch.column("line"):
                line = line.as_py()
                own = _WORD.findall(line)
                digests.append(_digest(line))
                words.append(len(own))
                features.append(np.array(of.inside(own, size), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([*_pairs(digests), batch.column("n"), pa.array(words, pa.int32()), pa.array(features, pa.binary())],
                                             names=["a", "b", "n", "words", "features"])
    return run


def _held(size: int, buckets: int):
    """(row, doc_id, a, b, n, crossing): a row's distinct lines with a word, and once, under no digest, the buckets of
    its features that cross lines."""
    def run(batches):
        of = Buckets(buckets)
        for batch in batches:
            at, digests, counts, crossing = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                lines = [x for x in _raw(text).split(b"\n") if _WORD.search(x)]
                n = Counter(lines)
                across = of.across([_WORD.findall(x) for x in lines], size) if size > 1 else []
                at += [i] * (1 + len(n))
                digests += [bytes(16), *map(_digest, n)]
                counts += [0, *n.values()]
                crossing += [np.array(across, np.uint32).tobytes(), *[None] * len(n)]
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pick), batch.column("doc_id").take(pick), *_pairs(digests),
                                              pa.array(counts, pa.int64()), pa.array(crossing, pa.binary())],
                                             names=["row", "doc_id", "a", "b", "n", "crossing"])
    return run


def _summed(buckets: int):
    """Rows (features, n) -> (bucket, n), summed in each task."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob, n in zip(batch.column("features"), batch.column("n").to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(blob.as_buffer(), np.uint32), n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    return run


def _weighed(gains, column: str, names: list[str]):
    """Rows with feature buckets -> their number and the sum of their gains."""
    def run(batches):
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(column)]
            sums = [int(gains.value[x].sum()) for x in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(x) for x in own], pa.int64()), pa.array(sums, pa.int64())],
                                             names=[*names, "features", "weight"])
    return run


# ------------------------------------------------------------------ operator

def line_table(docs: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """(a, b, n, words, features): each distinct line with a word, once."""
    lines = docs.select("text").mapInArrow(_segments, "line binary, n long").groupBy("line").agg(F.sum("n").alias("n"))
    return written(lines.mapInArrow(_featured(size, buckets), LINES), "lines")


def held_lines(docs: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return written(rows.mapInArrow(_held(size, buckets), "row long, doc_id long, a long, b long, n long, crossing binary"), "held")


def bucket_counts(lines: DataFrame, held: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; at most ``buckets`` rows come to the driver."""
    across = held.filter(F.length("crossing") > 0).select(F.col("crossing").alias("features"), F.lit(1).cast("long").alias("n"))
    found = (lines.select("features", "n").unionByName(across).mapInArrow(_summed(buckets), "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares), in doubles."""
    s, t, more = corpus.astype(float), target.astype(float), float(len(corpus))
    ratio = (t + 1) * (s.sum() + more) / ((s + 1) * (t.sum() + more))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed_rows(held: DataFrame, lines: DataFrame, gains: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every row."""
    shared = held.sparkSession.sparkContext.broadcast(gains)
    own = lines.mapInArrow(_weighed(shared, "features", ["a", "b", "words"]), "a long, b long, words int, features long, weight long")
    parts = (held.filter("n > 0").select("row", "doc_id", "a", "b", "n").join(own, ["a", "b"])
             .select("row", "doc_id", (F.col("n") * F.col("words")).alias("words"), (F.col("n") * F.col("features")).alias("features"),
                     (F.col("n") * F.col("weight")).alias("weight")))
    across = (held.filter("crossing is not null").select("row", "doc_id", "crossing", F.lit(0).cast("long").alias("words"))
              .mapInArrow(_weighed(shared, "crossing", ["row", "doc_id", "words"]), "row long, doc_id long, words long, features long, weight long"))
    return (parts.unionByName(across).groupBy("row", "doc_id")
            .agg(F.sum("words").alias("n_words"), F.sum("features").alias("n_features"), F.sum("weight").alias("weight")))


def _noise(seed: int):
    """floor(-1000 * ln(-ln(u))) with u from the first 32 bits of a hash of the doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``place`` from 0 on in the given order: range partitions, sorted one by one and written, and the
    rows before each partition (a row per partition)."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(spread, name).withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(before, "_part").withColumn("place", at).drop("_id", "_part", "_before")


def importance_draw(docs: DataFrame, target: DataFrame, size: int = SIZE, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
                    per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text, ...).

    ``target`` needs a column ``text``. Of the N rows with ``least_words`` words, floor(per_cent * N / 100) of the highest
    scores get ranks from 1 on; ties go to the smaller doc_id. A null or empty text has no features and weight 0.
    A null doc_id is hashed as an empty one and comes first among ties; rows of one doc_id are rows of their own with the same noise.
    An empty corpus gives no rows; an empty target leaves the corpus's own shares. Further columns are ignored.
    """
    ready(docs.sparkSession)
    texts = lambda df, key: df.select(key.cast("long").alias("doc_id"), F.col("text").cast("string"))
    docs, target = texts(docs, F.col("doc_id")), texts(target, F.lit(None))
    lines, held = line_table(docs, size, buckets), held_lines(docs, size, buckets)
    corpus = bucket_counts(lines, held, buckets)
    wanted = bucket_counts(line_table(target, size, buckets), held_lines(target, size, buckets), buckets)
    rows = weighed_rows(held, lines, bucket_gains(corpus, wanted))
    rows = rows.withColumn("score", F.col("weight") + _noise(seed)).withColumn("short", F.col("n_words") < least_words)
    rows = ranked(rows, [F.asc("short"), F.desc("score"), F.asc("doc_id"), F.asc("row")], "scores")
    drawn = per_cent * rows.filter(~F.col("short")).count() // 100
    rank = F.when(~F.col("short") & (F.col("place") < drawn), F.col("place") + 1)
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every one of ``documents`` with its weight towards ``benchmark`` and its rank in the draw."""
    out = importance_draw(source(spark, sf_dir, "documents", "doc_id", "text"), source(spark, sf_dir, "benchmark", "text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte: c shifted by eight bits, and the polynomial for each bit that falls out
_CRC = ("list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(strlen(word)), lambda i: "
        "('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::UBIGINT)), lambda c, x: list_reduce(list_concat([xor(c, x)], "
        "[1::UBIGINT, 2::UBIGINT, 3::UBIGINT, 4::UBIGINT, 5::UBIGINT, 6::UBIGINT, 7::UBIGINT, 8::UBIGINT]), "
        "lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END))")

ORACLE = rf"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
aimed AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
corpus AS (SELECT word, count(*) AS n FROM found GROUP BY word),
target AS (SELECT word, count(*) AS n FROM aimed GROUP BY word),
hashed AS MATERIALIZED (
  SELECT word, xor({_CRC}, 4294967295::UBIGINT) % 10000 AS bucket FROM (SELECT word FROM corpus UNION SELECT word FROM target)),
s AS (SELECT bucket, sum(n) AS s FROM corpus JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain) AS weight
  FROM found JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5)
                                                    / 4294967296))))::BIGINT AS score
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""
