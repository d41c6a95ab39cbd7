"""Inputs built from the driver's tables, plus the small parameter tables the queries
use (stop words, aspect seeds, form->lemma pairs, head coefficients).

The parameter lists are this project's own choices over the Latin-script test
documents; the defaults of the original system are in ``fixed_values``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.functions.text import LATIN_ALPHABETS
from trustlens.operators.lexicon import lexicon_from_labels
from trustlens.operators.partitioning import dealt, spread
from trustlens.session import materialised

ALPHABETS = LATIN_ALPHABETS
LANGUAGE = "en"

STOPWORDS = ["the", "and", "that", "for", "was", "with", "this", "are", "from", "than",
             "les", "des", "une", "der", "die", "und", "los", "las", "por", "para"]

ASPECT_CLASSES = ["quality", "price", "delivery", "service", "conformity", "other"]
ASPECT_SEEDS = [
    ("quality", ["thatin", "orantion", "tion", "erble"]),
    ("price", ["inoran", "ononst", "thanedble"]),
    ("delivery", ["hehely", "rewh", "thwh"]),
    ("service", ["orre", "ering", "onhe"]),
    ("conformity", ["ble", "thsh", "anea"]),
]
FORM_LEMMA = [("thing", "thin"), ("ering", "erin"), ("oning", "onin"), ("reing", "rein"),
              ("ones", "one"), ("eron", "be"), ("thes", "the"), ("thtion", "tion")]

SENTIMENT_CLASSES = ["negative", "positive"]
# (head, class, term, coef); term None = bias
COEFS = [
    ("sentiment", "negative", None, 0.0), ("sentiment", "positive", None, 0.0),
    ("sentiment", "positive", "hehely", 0.9), ("sentiment", "positive", "orantion", 0.4),
    ("sentiment", "positive", "thatin", 0.3), ("sentiment", "positive", "the", 0.02),
    ("sentiment", "negative", "orre", 0.7), ("sentiment", "negative", "rewh", 0.5),
    ("sentiment", "negative", "worthless", 2.0), ("sentiment", "negative", "ononst", 0.35),
    ("aspect", "quality", None, -0.4), ("aspect", "price", None, -0.6),
    ("aspect", "delivery", None, -0.5), ("aspect", "service", None, -0.3),
    ("aspect", "conformity", None, 0.0), ("aspect", "other", None, -1.0),
    ("aspect", "quality", "thatin", 0.5), ("aspect", "quality", "tion", 0.3),
    ("aspect", "price", "inoran", 0.8), ("aspect", "price", "ononst", 0.2),
    ("aspect", "delivery", "hehely", 0.7), ("aspect", "delivery", "rewh", 0.6),
    ("aspect", "service", "orre", 0.45), ("aspect", "service", "ering", 0.3),
    ("aspect", "conformity", "ble", 0.25), ("aspect", "conformity", "thsh", -0.4),
    ("aspect", "other", "the", 0.01),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as its file is laid out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table for work that is heavy per byte, on all cores also from one small file."""
    return spread(table(spark, sf_dir, name))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) from ``documents``."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reviews`` for work that is heavy per byte of text: on all cores also from one small file."""
    return spread(reviews(spark, sf_dir))


def dealt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch`` for a job that reads the texts several times."""
    return dealt(reviews(spark, sf_dir))


def rating_expr():
    return (F.when(F.col("quality") == 0, F.lit(1.0))
            .when(F.col("toxic") == 1, F.lit(3.0)).otherwise(F.lit(5.0)))


def corpus(spark: SparkSession, sf_dir: str, dealt=lambda df: df) -> DataFrame:
    """(doc_id, language, text, rating) = documents joined with labels; ``dealt`` may spread the documents."""
    d = dealt(table(spark, sf_dir, "documents")).select("doc_id", F.col("lang").alias("language"), "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", rating_expr().alias("rating"))
    return d.join(lab, "doc_id")


def lexicon(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(pos, term, tag, value) from the quality labels, as a prepared table: written once and read again, so that its
    size is known when a join with the tokens is planned. ``docs``: the documents' (doc_id, text) where a job has them dealt already."""
    docs = batch_table(spark, sf_dir, "documents") if docs is None else docs
    return materialised(lexicon_from_labels(docs, table(spark, sf_dir, "labels"), ALPHABETS.lexicon), "lexicon")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small parameter table as VALUES of the plan itself: its size is known, and no Python is run for it."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    if not rows:
        return spark.createDataFrame([], schema)
    def literal(v):
        return "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    body = ", ".join("(" + ", ".join(f"CAST({literal(v)} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(f'`{n}`' for n in names)})")


def stopwords(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(w,) for w in STOPWORDS], "token string")


def aspect_seeds(spark: SparkSession) -> DataFrame:
    rows = [(i, a, s) for i, (a, seeds) in enumerate(ASPECT_SEEDS) for s in seeds]
    return local_table(spark, rows, "aspect_pos int, aspect string, seed string")


def form_lemma(spark: SparkSession) -> DataFrame:
    return local_table(spark, FORM_LEMMA, "form string, lemma string")


#: factors of the positive and the negative class in the candidate heads of ``model_selection``
VARIANTS = [(1.0, 1.0), (0.5, 2.0), (2.0, 0.5)]


def variant(v: int = 0) -> list[tuple]:
    """The head's coefficients, those of the sentiment classes times the variant's factors."""
    factor = dict(zip(("positive", "negative"), VARIANTS[v]))
    return [(h, c, t, x * factor.get(c, 1.0) if h == "sentiment" else x) for h, c, t, x in COEFS]


def coefs(spark: SparkSession, v: int = 0) -> DataFrame:
    return local_table(spark, variant(v), "head string, class string, term string, coef double")
