"""Phrase collocations by multikey quicksort of suffix pointers.

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``, A-Z lower-cased. The suffix
of a word is the language and the next words of its piece, as many as the longest phrase has.

1. A task counts the equal suffixes of a block of texts and deals the distinct ones to buckets by their leading words, a
   compressed row for each bucket. Where the first word is hot, the second leads as well, and so on, so no
   bucket gathers a hot word's suffixes. Which words are hot is estimated on a share of the documents; it decides the route only.
2. A bucket's suffixes are sorted by multikey three-way quicksort up to the longest phrase (``suffixes.equal_parts``).
   Equal parts are the phrases, their sizes the counts; parts with fewer members than a candidate needs are abandoned. A part of
   fewer places than the route of some of its suffixes is counted in several buckets and summed up afterwards.
3. Scores come from joins of the counted phrases: a candidate needs the counts of its two parts for each cut, which
   are at least its own and so were counted too. Products are decimals of 38 digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens.llm.common import give_back, hash_filter, hashes_in, ready, source, written
from trustlens.llm.suffixes import equal_parts
from trustlens.llm.words import mix, row_slices, text_buffer, word_hashes

#: words of a candidate, its least count, phrases in the report, the share of a phrase that a longer one may hold
WORDS, LEAST, TOP, HELD = (2, 3), 10, 2000, (50, 100)
#: bytes of text that are counted together before they are dealt out, and bytes of text behind a bucket
BLOCK_BYTES, BUCKET_BYTES = 1 << 23, 6 << 20
#: one in so many documents is looked through for hot words, which stand so often in the whole
SAMPLE, HOT = 16, 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: of a word, 1: blank, 2: end of a piece
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
#: before a language's name, to tell it from words
_LANG = b" "
_CODEC = "zstd"


# ------------------------------------------------------------------ suffixes of a block

def block_words(offsets: np.ndarray, raw: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row, piece) of a block of texts; equal numbers in ``piece`` mark words of one piece."""
    raw = _LOWER[raw]
    kind = _KIND[raw]
    solid = np.zeros(len(raw) + 1, bool)  # a byte more, so that cuts at the end need no care
    solid[:-1] = kind == 0
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    first[cuts] |= solid[cuts]
    cuts = cuts[cuts > 0]
    last[cuts - 1] |= solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == 2)[starts] + row if len(starts) else row
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[solid[:-1]])])
    return words, row, piece


def distinct_rows(columns: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct row, its count) of columns of codes below ``top``."""
    key, held = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        if held * top >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            held = int(key.max(initial=0)) + 1
        key, held = key * top + c, held * top
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return at, n


def dictionary_hashes(words: pa.Array) -> np.ndarray:
    offsets, raw = text_buffer(words)
    return word_hashes(raw, offsets[:-1], offsets[1:])


def lead_of(columns: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """How many leading places route a suffix: language and first word, and one more for each hot leading word."""
    lead, go_on = np.full(len(columns[0]), 2, np.int8), np.ones(len(columns[0]), bool)
    for c in columns[1:-1]:
        go_on &= hot[c]
        lead += go_on
    return lead


def block_suffixes(texts: pa.Array, langs: pa.Array, places: int):
    """(dictionary, columns, counts): the distinct suffixes of a block, language first; code 0 is no word, code i is
    entry i - 1 of the dictionary."""
    words, row, piece = block_words(*text_buffer(texts))
    coded = words.dictionary_encode()
    c = coded.indices.to_numpy() + np.int32(1)
    names = langs.take(pa.array(row)).dictionary_encode()
    lang = names.indices.to_numpy() + np.int32(1 + len(coded.dictionary))
    columns = [lang, c]
    for k in range(1, places):
        more = np.zeros(len(c), np.int32)
        if len(c) > k:
            more[:-k] = np.where(piece[:-k] == piece[k:], c[k:], 0)
        columns.append(more)
    dictionary = pa.concat_arrays([coded.dictionary.cast(pa.large_binary()),
                                   pa.array([_LANG + x for x in names.dictionary.to_pylist()], pa.large_binary())])
    at, n = distinct_rows(columns, len(dictionary) + 1)
    return dictionary, [x[at] for x in columns], n


# ------------------------------------------------------------------ rows between tasks

def packed(dictionary: pa.Array, columns: list[np.ndarray], n: np.ndarray) -> tuple[bytes, int]:
    """(bytes, their number before compression): suffixes with the words that they use; codes in byte planes, which compress
    well. A block has fewer than 2**32 words, since an Arrow text has fewer bytes."""
    used, codes = np.unique(np.concatenate(columns), return_inverse=True)
    own = dictionary.take(pa.array(used[used > 0] - 1))
    codes = (codes + (used[0] > 0)).astype(np.uint32).reshape(len(columns), -1)
    offsets, raw = text_buffer(own)
    head = np.array([len(own), len(n), len(raw)], np.int64)
    planes = np.concatenate([codes, n.astype(np.uint32)[None]]).view(np.uint8).reshape(-1, 4).T
    body = [head.tobytes(), np.diff(offsets).astype(np.int32).tobytes(), raw.tobytes(), np.ascontiguousarray(planes).tobytes()]
    body = b"".join(body)
    return pa.compress(body, _CODEC, asbytes=True), len(body)


def unpacked(blob: bytes, size: int) -> tuple[pa.Array, np.ndarray]:
    """(words, codes and counts: a row each) of ``packed``; ``size``: its bytes before compression."""
    data = pa.decompress(blob, size, _CODEC, asbytes=True)
    words, n, length = np.frombuffer(data, np.int64, 3)
    offsets = np.zeros(words + 1, np.int64)
    np.cumsum(np.frombuffer(data, np.int32, words, 24), out=offsets[1:])
    at = 24 + 4 * int(words)
    own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(words), [None, pa.py_buffer(offsets), pa.py_buffer(data[at:at + int(length)])])
    planes = np.frombuffer(data, np.uint8, offset=at + int(length)).reshape(4, -1)
    return own, np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1, int(n))


def _dealt(places: int, buckets: int, hot):
    """Texts -> (bucket, size, suffixes), block by block."""
    def deal(texts: list[pa.Array], langs: list[pa.Array]):
        dictionary, columns, n = block_suffixes(pa.concat_arrays(texts), pa.concat_arrays(langs), places)
        if len(n) == 0:
            return
        hashes = np.concatenate([np.zeros(1, np.uint64), dictionary_hashes(dictionary)])
        is_hot = np.zeros(len(hashes), bool)
        is_hot[hashes_in(hot.value, hashes)] = True
        is_hot[0] = False
        lead, route = lead_of(columns, is_hot), np.zeros(len(n), np.uint64)
        for k, c in enumerate(columns):
            route = np.where(lead > k, mix(route + hashes[c] + np.uint64(k + 1)), route)
        bucket = (route % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
            own = order[a:b]
            yield int(bucket[own[0]]), *packed(dictionary, [c[own] for c in columns], n[own])

    def run(batches):
        texts, langs, held = [], [], 0

        def out():
            rows = list(deal(texts, langs))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "size", "suffixes"])
        for batch in batches:
            text, lang = batch.column("text").cast(pa.large_binary()), batch.column("lang").cast(pa.large_binary())
            offsets, _ = text_buffer(text)
            for a, b in row_slices(offsets, BLOCK_BYTES // 4):
                texts.append(text.slice(a, b - a))
                langs.append(lang.slice(a, b - a))
                held += int(offsets[b] - offsets[a])
                if held >= BLOCK_BYTES:
                    yield from out()
                    texts, langs, held = [], [], 0
                    give_back()
        if texts:
            yield from out()
            give_back()
    return run


def _counted_words(batches):
    """(word hash, n) of a batch."""
    for batch in batches:
        words, _, _ = block_words(*text_buffer(batch.column("text").cast(pa.large_binary())))
        found = words.value_counts()
        h = dictionary_hashes(found.field("values"))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), found.field("counts")], names=["word", "n"])


def _mined(least: int, hot):
    """Rows sorted by bucket -> (lang, words, phrase, n) of the frequent parts of each bucket, and of those that other
    buckets may hold members of; no words: all suffixes of the language."""
    def mine(blobs: list):
        words, parts, at = [], [], 0
        for own, codes in blobs:
            words.append(own)
            parts.append(np.where(codes[:-1] > 0, codes[:-1].astype(np.int32) + np.int32(at), np.int32(0)))
            at += len(own)
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        to = np.concatenate([np.zeros(1, np.int32), coded.indices.to_numpy().astype(np.int32) + 1])
        columns = np.concatenate([to[p] for p in parts], axis=1)
        weights = np.concatenate([codes[-1] for _, codes in blobs]).astype(np.int64)
        is_hot = np.zeros(len(coded.dictionary) + 1, bool)
        is_hot[hashes_in(hot.value, dictionary_hashes(coded.dictionary)) + 1] = True
        lead = lead_of(list(columns), is_hot)
        entries = coded.dictionary.to_pylist()
        for pointer, places, size in equal_parts(columns, weights, lead, least):
            rows = columns[:, pointer]
            langs = [entries[c - 1][len(_LANG):] for c in rows[0]]
            phrases = [b" ".join([entries[c - 1] for c in own[1:k]]) for own, k in zip(rows.T.tolist(), places.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()).cast(pa.string()), pa.array(places - 1, pa.int32()),
                                              pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(size)], names=["lang", "words", "phrase", "n"])

    def run(batches):
        last, blobs = None, []
        for batch in batches:
            for bucket, size, blob in zip(batch.column("bucket").to_pylist(), batch.column("size").to_pylist(), batch.column("suffixes"), strict=True):
                if bucket != last and blobs:
                    yield from mine(blobs)
                    blobs = []
                    give_back()
                last = bucket
                blobs.append(unpacked(blob.as_buffer(), size))
        if blobs:
            yield from mine(blobs)
            give_back()
    return run


# ------------------------------------------------------------------ operator

def phrase_counts(docs: DataFrame, longest: int = WORDS[1], least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, n): all phrases of up to ``longest`` words found ``least`` times or more in a language, and
    with no words the number of its words."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    often = (some.mapInArrow(_counted_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
             .filter(F.col("n") * SAMPLE >= HOT).select(F.array("word").alias("hashes")))
    hot = spark.sparkContext.broadcast(hash_filter(often, "hashes"))
    dealt = rows.select("lang", "text").mapInArrow(_dealt(longest, buckets, hot), "bucket long, size long, suffixes binary")
    found = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_mined(least, hot), "lang string, words int, phrase string, n long")
    sums = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return written(sums.filter((F.col("n") >= least) | (F.col("words") == 0)), "phrases")


def _slice(first, length):
    return F.concat_ws(" ", F.slice("w", first, length))


def scored_phrases(counts: DataFrame, shortest: int = WORDS[0], longest: int = WORDS[1]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates among ``counts``, with the cut that scores lowest."""
    own = counts.filter(F.col("words") >= max(2, shortest)).select("lang", "words", "phrase", F.col("n").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = own.select("lang", "phrase", "a", "words", F.split("phrase", " ").alias("w"), cut)
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), _slice(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), _slice(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("p"))
    known = counts.filter("words > 0").select("lang", F.col("phrase").alias("part"), "n")
    parts = parts.select("lang", "phrase", "a", "k", "p.side", "p.part").join(known, ["lang", "part"])
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("n"))).alias(f"{side}{k}")
    wide = parts.groupBy("lang", "phrase", "a").agg(*[of(k, s) for k in range(1, longest) for s in "lr"])
    big = lambda c: f"cast({c} as decimal(38,0))"
    structs = [F.expr(f"CASE WHEN l{k} IS NOT NULL THEN struct((1000000 * {big('a')} * {big('a')}) div ({big(f'l{k}')} * {big(f'r{k}')}) AS score, "
                      f"{k} AS k, l{k} AS l, r{k} AS r) END") for k in range(1, longest)]
    lowest = F.array_min(F.filter(F.array(*structs), lambda x: x.isNotNull()))
    return wide.select("lang", "phrase", "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def without_held(scored: DataFrame, counts: DataFrame, shortest: int = WORDS[0], held: tuple[int, int] = HELD) -> DataFrame:
    """Candidates but for those that a longer candidate holds, which stands ``held`` of their times or more."""
    longer = counts.filter(F.col("words") > max(2, shortest)).select("lang", "words", F.col("n").alias("long_n"), F.split("phrase", " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(max(2, shortest)), F.col("words") - 1),
                                  lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.concat_ws(" ", F.slice("w", i, m)))))
    inside = (longer.select("lang", "long_n", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("long_n").alias("long_n")))
    rows = scored.join(inside, ["lang", "phrase"], "left")
    return rows.filter(F.col("long_n").isNull() | (F.lit(held[1]) * F.col("long_n") < F.lit(held[0]) * F.col("a"))).drop("long_n")


def collocations(docs: DataFrame, words: tuple[int, int] = WORDS, least: int = LEAST, top: int = TOP, held: tuple[int, int] = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` collocations of each language in ``docs`` (doc_id, text, lang).

    By score descending, count descending, phrase ascending in the order of UTF-8 bytes, so there are no ties. A null
    language is ``und``; a null or empty text has no words, and a text of any length counts whole. Repeated rows
    count each; a null doc_id is as good as any. Further columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", "lang")
    counts = phrase_counts(docs, words[1], least)
    rows = without_held(scored_phrases(counts, *words), counts, words[0], held)
    # each task keeps its first ``top`` of a language before anything is gathered
    docs.sparkSession.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(max(1000, top)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    rows = rows.join(counts.filter("words = 0").select("lang", "n"), "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of ``documents``."""
    return collocations(source(spark, sf_dir, "documents", "doc_id", "text", "lang"))


ORACLE = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS v(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, v.cut, array_to_string(w[1:v.cut], ' ') AS first, array_to_string(w[v.cut + 1:c.k], ' ') AS rest
  FROM candidates c, (VALUES (1), (2)) AS v(cut) WHERE v.cut < c.k),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, cut, x.n AS l, y.n AS r, ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3)
  GROUP BY lang, phrase),
kept AS (
  SELECT o.* FROM lowest o LEFT JOIN held h ON h.lang = o.lang AND h.phrase = o.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * o.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000
"""
