"""Per-row signals as Column expressions (no shuffle, whole-stage friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlens import fixed_values as fv
from trustlens.functions.text import let, letter_tokens, word_count, _col


def rnd(x, digits: int) -> Column:
    """Half-up rounding as floor(x * 10^d + 0.5) / 10^d.

    Built from IEEE operations only, so every engine that evaluates the same formula
    gets the same double (Spark's ``round`` works on the decimal string of the value
    and other engines multiply first; the two differ on near-ties).
    """
    scale = 10 ** digits
    return F.floor(_col(x) * scale + 0.5) / F.lit(scale)


def _clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def length_score(text, min_words: int = fv.MIN_WORDS, max_words: int = fv.MAX_WORDS) -> Column:
    """n < min -> n/min; n > max -> max(0, 1 - (n-max)/max); else 1. Null text -> 0."""
    def on_count(n):
        return (F.when(n < min_words, n / F.lit(float(min_words)))
                .when(n > max_words, F.greatest(F.lit(0.0), 1 - (n - max_words) / F.lit(float(max_words))))
                .otherwise(F.lit(1.0)))
    # the count is bound once: it is referenced by several branches
    return F.when(_col(text).isNull(), F.lit(0.0)).otherwise(let(word_count(text), on_count))


def diversity_of_tokens(tokens) -> Column:
    """Type-token ratio of a token array; above the window size the mean ratio of full
    sliding windows (size 20, step 10)."""
    win, step = fv.DIVERSITY_WINDOW, fv.DIVERSITY_STEP

    def on_tokens(w):
        n = F.size(w)
        ratios = F.transform(F.sequence(F.lit(0), F.greatest(n - win, F.lit(0)), F.lit(step)),
                             lambda i: F.size(F.array_distinct(F.slice(w, i + 1, win))) / F.lit(float(win)))
        mean = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x) / F.size(ratios)
        return (F.when(n < fv.DIVERSITY_MIN_TOKENS, F.lit(0.0))
                .when(n <= win, F.size(F.array_distinct(w)) / n)
                .otherwise(mean))
    return let(_col(tokens), on_tokens)


def diversity_score(text, letters: str) -> Column:
    """Diversity of the scoring tokens of ``text``; null text -> 0."""
    return F.when(_col(text).isNull(), F.lit(0.0)).otherwise(diversity_of_tokens(letter_tokens(text, letters)))


def quality_score(text, letters: str, capitals: str) -> Column:
    """Mean of four penalties: letter share, runs of >= 4 equal chars, links, capitals."""
    t = _col(text)
    L = F.length(t)
    # letters = length minus what is left after deleting runs of letters (one regex match
    # per run instead of one per letter)
    letters_n = L - F.length(F.regexp_replace(t, f"[{letters}]+", ""))
    caps_n = L - F.length(F.regexp_replace(t, f"[{capitals}]+", ""))
    repeats = F.regexp_count(t, F.lit(r"(?d)(.)\1{3,}"))
    links = t.rlike(fv.LINK_PATTERN).cast("int")

    def on_counts(c):
        ln, let_n, cap_n, rep, link = c[0], c[1], c[2], c[3], c[4]
        p1 = F.least(let_n / F.greatest(ln, F.lit(1)) / fv.QUALITY_LETTER_RATIO, F.lit(1.0))
        p2 = F.greatest(F.lit(0.0), 1 - rep * fv.QUALITY_REPEAT_PENALTY)
        p3 = F.when(link == 1, F.lit(fv.QUALITY_LINK_SCORE)).otherwise(F.lit(1.0))
        caps_ratio = cap_n / F.greatest(let_n, F.lit(1))
        p4 = F.greatest(F.lit(0.0),
                        1 - F.greatest(F.lit(0.0), caps_ratio - fv.QUALITY_CAPS_FREE) * fv.QUALITY_CAPS_PENALTY)
        return (((p1 + p2) + p3) + p4) / 4
    # each count is computed once and bound as one array
    counts = F.array(L, letters_n, caps_n, repeats, links)
    return F.when(t.isNull() | (L < 2), F.lit(0.0)).otherwise(let(counts, on_counts))


def emotion_score(hits, mean, std) -> Column:
    """< 3 lexicon hits -> 0.5; else clip(1 - |mean| * (1 - min(std, .5)/.5), 0, 1)."""
    hits, mean, std = _col(hits), _col(mean), _col(std)
    cap = fv.EMOTION_STD_CAP
    s = _clip01(1 - F.abs(mean) * (1 - F.least(std, F.lit(cap)) / cap))
    return F.when(hits.isNull() | (hits < fv.EMOTION_MIN_HITS), F.lit(fv.EMOTION_NEUTRAL)).otherwise(s)


def similarity_score(max_sim, threshold: float = fv.SIMILARITY_THRESHOLD) -> Column:
    """max cosine m <= threshold -> 1; else clip(1 - (m - t)/(1 - t), 0, 1). No partner -> 1."""
    m = _col(max_sim)
    s = F.when(m > threshold, _clip01(1 - (m - threshold) / (1 - threshold))).otherwise(F.lit(1.0))
    return F.coalesce(s, F.lit(1.0))


def trust_score(length, diversity, emotion, quality, similarity) -> Column:
    """Weighted sum in the fixed order, x100, one decimal."""
    parts = dict(length=_col(length), diversity=_col(diversity), emotion=_col(emotion),
                 quality=_col(quality), similarity=_col(similarity))
    acc = None
    for name, weight in fv.TRUST_WEIGHTS:
        term = parts[name] * weight
        acc = term if acc is None else acc + term
    return rnd(acc * 100, 1)


def pct(x) -> Column:
    """Fraction -> percent with one decimal."""
    return rnd(_col(x) * 100, 1)


def rating_sentiment(rating) -> Column:
    """>= 4 positive, <= 2 negative, else neutral; NaN and null are neutral."""
    r = _col(rating)
    ok = r.isNotNull() & ~F.isnan(r)
    return (F.when(ok & (r >= fv.RATING_POSITIVE_MIN), F.lit("positive"))
            .when(ok & (r <= fv.RATING_NEGATIVE_MAX), F.lit("negative"))
            .otherwise(F.lit("neutral")))


def sentiment_label(sentiment) -> Column:
    """negative -> 0, positive -> 1, other -> null."""
    s = _col(sentiment)
    out = None
    for name, code in fv.SENTIMENT_LABELS:
        out = (F.when(s == name, F.lit(code)) if out is None else out.when(s == name, F.lit(code)))
    return out.cast("int")
