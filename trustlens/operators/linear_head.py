"""Scoring with a fixed coefficient table: logit = bias + sum(tf * coef).

The coefficient table has columns (head, class, term, coef); rows with a null term
are the biases. Head ``sentiment`` has the classes (negative, positive) and is read by
softmax; head ``aspect`` has one sigmoid per class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.functions.scores import rnd

from trustlens import fixed_values as fv
from trustlens.functions.text import letter_tokens

_DP = 6
_UNIT = 10 ** 9
#: characters of text that the batch scorer tokenises at once, in whole texts
PART_CHARS = 1 << 20


def _keys(sentiment_classes, aspect_classes):
    return ([("sentiment", c) for c in sentiment_classes] + [("aspect", c) for c in aspect_classes])


def head_logits(docs: DataFrame, coefs: DataFrame, sentiment_classes: list[str],
                aspect_classes: list[str], letters: str) -> DataFrame:
    """(doc_id, z0..zK-1) for every review, in the key order sentiment classes then aspects."""
    keys = _keys(sentiment_classes, aspect_classes)
    k = None
    for n, (h, c) in enumerate(keys):
        cond = (F.col("head") == h) & (F.col("class") == c)
        k = F.when(cond, F.lit(n)) if k is None else k.when(cond, F.lit(n))
    c = coefs.withColumn("k", k).filter(F.col("k").isNotNull())
    biases = c.filter(F.col("term").isNull())
    weights = c.filter(F.col("term").isNotNull()).select("term", "k", "coef")
    toks = docs.select("doc_id", F.explode(letter_tokens("text", letters)).alias("term"))
    # exact sums in integer units of 1e-9: the result does not depend on the order rows
    # are added in (a tie at p = 0.5 stays a tie), and 64-bit sums stay in generated code
    units = F.round(F.col("coef") * _UNIT).cast("long")
    sums = (toks.join(weights, "term").groupBy("doc_id")
            .pivot("k", list(range(len(keys)))).agg(F.sum(units)))
    out = docs.select("doc_id").join(sums.hint("shuffle_hash"), "doc_id", "left")
    zero = F.lit(0).cast("long")

    def bias(n):  # a scalar subquery: no job while the plan is built
        own = biases.filter(F.col("k") == n).select(F.round(F.sum("coef") * _UNIT).cast("long"))
        return F.coalesce(own.scalar(), zero)
    return out.select("doc_id", *[(F.coalesce(F.col(str(n)), zero) + bias(n)).alias(f"z{n}") for n in range(len(keys))])


def read_heads(logits: DataFrame, sentiment_classes: list[str], aspect_classes: list[str],
               threshold: float = fv.ASPECT_THRESHOLD, other: str | None = None) -> DataFrame:
    """Logits -> sentiment (positive iff p > .5), confidence, aspect list (p > threshold,
    not ``other``, highest probability first)."""
    other = other or aspect_classes[-1]
    neg, pos = F.col("z0"), F.col("z1")
    p_pos = 1.0 / (1.0 + F.exp((neg - pos) / F.lit(float(_UNIT))))
    p_neg = 1.0 / (1.0 + F.exp((pos - neg) / F.lit(float(_UNIT))))
    off = len(sentiment_classes)
    probs = [(1.0 / (1.0 + F.exp(-(F.col(f"z{off + a}") / F.lit(float(_UNIT))))))
             for a in range(len(aspect_classes))]
    arr = F.array(*[F.struct(p.alias("prob"), F.lit(a).alias("pos"), F.lit(name).alias("aspect"))
                    for a, (p, name) in enumerate(zip(probs, aspect_classes))])
    kept = F.filter(arr, lambda x: (x["prob"] > threshold) & (x["aspect"] != other))
    ordered = F.transform(F.sort_array(kept, asc=False), lambda x: x["aspect"])
    return logits.select(
        "doc_id",
        F.when(p_pos > 0.5, F.lit(sentiment_classes[1])).otherwise(F.lit(sentiment_classes[0]))
        .alias("sentiment"),
        rnd(p_pos, _DP).alias("p_positive"),
        F.greatest(p_pos, p_neg).alias("confidence"),
        ordered.alias("aspect_list"),
        F.array(*[(p > threshold).cast("int") for p in probs]).alias("aspect_pred"),
        *[rnd(p, _DP).alias(f"p_aspect{a}") for a, p in enumerate(probs)])


def aspects_text(aspect_list) -> F.Column:
    """', '-joined aspect names, or the dash when there are none."""
    a = F.col(aspect_list) if isinstance(aspect_list, str) else aspect_list
    return F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise(F.lit(fv.NO_ASPECTS))


def linear_head_scores(docs: DataFrame, coefs: DataFrame, sentiment_classes: list[str],
                       aspect_classes: list[str], letters: str,
                       threshold: float = fv.ASPECT_THRESHOLD) -> DataFrame:
    logits = head_logits(docs, coefs, sentiment_classes, aspect_classes, letters)
    return read_heads(logits, sentiment_classes, aspect_classes, threshold)


def batch_scorer(path: str, sentiment_classes: list[str], aspect_classes: list[str], letters: str,
                 threshold: float = fv.ASPECT_THRESHOLD):
    """The same head as a batch model read from a coefficient table's folder: term ids of an
    Arrow batch, in parts of about ``PART_CHARS`` characters, one sparse product with the weights in exact integer units of 1e-9, then the
    same double formulas as the column version."""
    import re

    import numpy as np
    import pandas as pd
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    table = ds.dataset(name, filesystem=store, format="parquet").to_table().to_pylist()
    place = {k: n for n, k in enumerate(_keys(sentiment_classes, aspect_classes))}
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in table if r["term"] is not None}))}
    bias, weights = np.zeros(len(place)), np.zeros((len(terms), len(place)), np.int64)
    for r in table:
        n = place.get((r["head"], r["class"]))
        if n is not None and r["term"] is None:
            bias[n] += r["coef"]
        elif n is not None:
            weights[terms[r["term"]], n] += int(round(r["coef"] * _UNIT))
    bias = np.round(bias * _UNIT).astype(np.int64)
    strip, off, names = re.compile(f"[^{letters}\\s]"), len(sentiment_classes), np.array(aspect_classes, object)

    def rounded(x, digits):
        return np.floor(x * 10 ** digits + 0.5) / 10 ** digits

    def sigmoid(z):
        return 1.0 / (1.0 + np.exp(-(z / float(_UNIT))))

    def part_scores(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = [strip.sub("", t.lower()).split() for t in pdf["text"]]
        ids = [[terms[t] for t in row if t in terms] for row in tokens]
        rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        z = np.tile(bias, (len(ids), 1))
        np.add.at(z, rows, weights[np.fromiter((i for x in ids for i in x), np.int64, len(rows))])
        p_pos, p_neg = sigmoid(z[:, 1] - z[:, 0]), sigmoid(z[:, 0] - z[:, 1])
        probs = sigmoid(z[:, off:])
        probs[:, -1] = -1.0  # the last class is never listed
        # most probable first, of equal ones the later class
        order = np.lexsort((-np.tile(np.arange(probs.shape[1]), (len(probs), 1)), -probs), axis=1)
        listed = np.take_along_axis(probs, order, 1) > threshold
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy(np.int64),
            "sentiment": np.where(p_pos > 0.5, sentiment_classes[1], sentiment_classes[0]),
            "p_positive": rounded(p_pos, _DP), "confidence_pct": rounded(np.maximum(p_pos, p_neg) * 100, 1),
            "aspects": [", ".join(names[o[m]]) if m.any() else fv.NO_ASPECTS for o, m in zip(order, listed)]})

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        # texts' tokens are Python objects: those of some texts at a time, cut by characters
        cut = np.cumsum(pdf["text"].str.len().to_numpy(np.int64)) // PART_CHARS
        ends = [0, *(np.flatnonzero(np.diff(cut)) + 1), len(pdf)]
        return pd.concat([part_scores(pdf.iloc[i:j]) for i, j in zip(ends[:-1], ends[1:])], ignore_index=True)
    return score


SCORE_SCHEMA = "doc_id long, sentiment string, p_positive double, confidence_pct double, aspects string"
