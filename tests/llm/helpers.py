"""Small tables and plain re-computations that the operators are held against."""

from __future__ import annotations

import re
import zlib

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wise men watch from a very old stone bridge near town"
ODD = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "b"), (2, PROSE, "en", "b"), (3, None, "en", "a"), (4, "", None, "a"),
    (5, " \t\n ", "en", None), (6, "one", "fr", "b"), (7, "One", "fr", "b"), (8, LONG, "de", "a"), (None, "no id here at all", "de", "c"),
    (10, "a\x00b    café \U0001f600 <|endoftext|> it's 3.5% don't", None, None), (11, "a " * 400, "en", "a"),
    (12, PROSE.replace("lazy", "sleepy"), "en", "a"), (13, "x" * 20_000, "es", "a"),
]
#: columns whose names the operators use themselves
CLASH = "n long, g string, k long, row long, sig long, node long, kept boolean, n_words long, doc string, lang string, source string, size long, same long"


def odd_docs(spark):
    rows = [(d, t, d, "g", 1, 2, 3, 4, False, 9, "doc", lang, src, 5, 6) for d, t, lang, src in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def texts(sf: str = SF) -> dict[int, str]:
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    w = words(lower(text))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
