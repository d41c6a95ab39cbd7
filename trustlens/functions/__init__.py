"""Column -> Column building blocks (JVM-side expressions only, no Python UDFs)."""

from trustlens.functions.text import (
    Alphabets, DEFAULT_ALPHABETS, LATIN_ALPHABETS, words, word_count, letter_tokens,
    lemma_forms, vector_tokens, term_counts,
)
from trustlens.functions.scores import (
    length_score, diversity_score, quality_score, emotion_score, similarity_score,
    trust_score, pct, rating_sentiment, sentiment_label, rnd,
)

__all__ = [
    "Alphabets", "DEFAULT_ALPHABETS", "LATIN_ALPHABETS", "words", "word_count", "letter_tokens",
    "lemma_forms", "vector_tokens", "term_counts", "length_score", "diversity_score",
    "quality_score", "emotion_score", "similarity_score", "trust_score", "pct",
    "rating_sentiment", "sentiment_label", "rnd",
]
