"""Tokenisers as Column expressions.

Python's ``str.split()`` and ``\\s`` treat Unicode spaces and the separators
U+001C..U+001F as white space; Java's ``(?U)\\s`` covers the former only, so the
class below adds the separators explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlens import fixed_values as fv

WS = r"\s\x1c-\x1f"


@dataclass(frozen=True)
class Alphabets:
    """Regex character-class bodies for each tokeniser.

    lemma:    letters kept by lemma cleaning (others become spaces)
    score:    letters kept for the diversity tokens (others are removed)
    lexicon:  letters kept for lexicon look-ups (others are removed)
    quality:  letters counted by the quality signal
    capitals: capital letters counted by the quality signal
    """

    lemma: str = fv.CYRILLIC
    score: str = fv.CYRILLIC_LATIN
    lexicon: str = fv.CYRILLIC
    quality: str = fv.CYRILLIC_LATIN
    capitals: str = fv.CAPITALS


DEFAULT_ALPHABETS = Alphabets()

_LATIN = "a-zà-öø-ÿA-ZÀ-ÖØ-Þ"
# for Latin-script tables (the driver's test tables hold no Cyrillic)
LATIN_ALPHABETS = Alphabets(lemma=_LATIN, score=_LATIN, lexicon=_LATIN, quality=_LATIN,
                            capitals="A-ZÀ-ÖØ-Þ")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    An outer expression referenced inside a higher-order-function lambda is evaluated
    again for every element; binding it as a lambda variable evaluates it once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text) -> Column:
    """Python ``text.split()``: white-space separated words, no empty strings."""
    return F.filter(F.split(_col(text), rf"(?U)[{WS}]+"), lambda x: x != "")


def word_count(text) -> Column:
    """``len(text.split())``: the number of matches of a word."""
    return F.regexp_count(_col(text), F.lit(rf"(?U)[^{WS}]+"))


def letter_tokens(text, letters: str) -> Column:
    """Lower-case, delete every char outside ``letters`` and white space, split."""
    cleaned = F.regexp_replace(F.lower(_col(text)), rf"(?U)[^{letters}{WS}]", "")
    return words(cleaned)


def lemma_forms(text, letters: str) -> Column:
    """Lower-case, turn every char outside ``letters`` and white space into a space, split."""
    cleaned = F.regexp_replace(F.lower(_col(text)), rf"(?U)[^{letters}{WS}]", " ")
    return words(cleaned)


def vector_tokens(text) -> Column:
    """Vectoriser tokens: lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def term_counts(tokens) -> Column:
    """array<string> -> array<struct<term string, tf int>>, one entry per distinct term.

    Sort, then cut the sorted array at the positions where the value changes;
    O(n log n) per row and no shuffle.
    """
    def on_sorted(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                          lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))

        def runs(st_arr):
            return F.transform(st_arr, lambda st, k: F.struct(
                F.get(s, st - 1).alias("term"),
                (F.coalesce(F.get(st_arr, k + 1), n + 1) - st).cast("int").alias("tf")))
        return F.when(n > 0, let(starts, runs)).otherwise(
            F.array().cast("array<struct<term:string,tf:int>>"))
    return let(F.sort_array(_col(tokens)), on_sorted)
