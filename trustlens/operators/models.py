"""Spark ML heads: a sentiment classifier and one binary classifier per aspect class
(binary relevance) on shared TF-IDF features, packed into one ``PipelineModel``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens import fixed_values as fv
from trustlens.functions.scores import rnd
from trustlens.functions.text import WS


def _tokens_sql(letters: str) -> str:
    """The scoring tokeniser as SQL, so the fitted pipeline carries it when saved."""
    keep = f"(?U)[^{letters}{WS}]".replace("\\", "\\\\")
    split = f"(?U)[{WS}]+".replace("\\", "\\\\")
    return (f"SELECT *, filter(split(regexp_replace(lower(text), '{keep}', ''), '{split}'), "
            f"x -> x != '') AS tokens FROM __THIS__")


def featurizer(letters: str, num_features: int = 1 << 18) -> Pipeline:
    return Pipeline(stages=[
        SQLTransformer(statement=_tokens_sql(letters)),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
    ])


@dataclass
class TrainConfig:
    letters: str = fv.CYRILLIC_LATIN
    reg_params: tuple = (0.0, 0.01, 0.1)
    aspect_reg: float = 0.01
    max_iter: int = 30
    num_features: int = 1 << 18
    parallelism: int = 4          # independent fits submitted concurrently
    weight_col: str | None = "weight"


def _sentiment_lr(reg: float, cfg: TrainConfig) -> LogisticRegression:
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=cfg.max_iter,
                            probabilityCol="p_sent", rawPredictionCol="raw_sent", predictionCol="pred_sent")
    if cfg.weight_col:
        lr.setWeightCol(cfg.weight_col)
    return lr


def _aspect_lr(k: int, reg: float, cfg: TrainConfig) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol=f"y{k}", regParam=reg, maxIter=cfg.max_iter,
                              probabilityCol=f"p_a{k}", rawPredictionCol=f"raw_a{k}",
                              predictionCol=f"pred_a{k}")


def aspect_columns(df: DataFrame, n_classes: int, labels_col: str = "aspect_labels") -> DataFrame:
    return df.select("*", *[F.col(labels_col)[k].cast("double").alias(f"y{k}") for k in range(n_classes)])


def featurize(feats: PipelineModel, rows: DataFrame, n_classes: int) -> DataFrame:
    """Feature vectors plus one double label column per aspect class."""
    return aspect_columns(feats.transform(rows), n_classes)


def fit_aspect_heads(ft: DataFrame, n_classes: int, reg: float, cfg: TrainConfig) -> list:
    """One LR per aspect class on shared features (binary relevance). A class that never
    (or always) occurs gets zero weights and an infinite intercept."""
    return fit_all([_aspect_lr(k, reg, cfg) for k in range(n_classes)], ft, cfg.parallelism)


def fit_all(estimators: list, df: DataFrame, parallelism: int) -> list:
    """Fit independent estimators on one DataFrame, ``parallelism`` at a time: each fit
    is a series of small distributed jobs, and concurrent jobs keep the cluster busy."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(lambda e: e.fit(df), estimators))


def assemble(feats: PipelineModel, sentiment_head, aspect_heads: list) -> PipelineModel:
    """One saveable model: tokens -> TF -> IDF -> sentiment head -> aspect heads."""
    return PipelineModel(stages=list(feats.stages) + [sentiment_head] + list(aspect_heads))


def predict(model: PipelineModel, docs: DataFrame, aspect_classes: list[str],
            sentiment_classes=("negative", "positive"), threshold: float = fv.ASPECT_THRESHOLD,
            other: str | None = None, carry: tuple = ()) -> DataFrame:
    """(doc_id, *carry, sentiment, p_positive, confidence, aspect_list, aspect_pred) from a fitted model;
    ``carry`` names columns of ``docs`` to keep.

    positive iff p(positive) > 0.5; confidence = the larger class probability;
    aspects with p > threshold except ``other``, most probable first.
    """
    other = other or aspect_classes[-1]
    out = model.transform(docs)
    ps = vector_to_array("p_sent")
    p_pos, p_neg = ps[1], ps[0]
    arr = F.array(*[F.struct(vector_to_array(f"p_a{k}")[1].alias("prob"), F.lit(k).alias("pos"),
                             F.lit(name).alias("aspect"))
                    for k, name in enumerate(aspect_classes)])
    kept = F.filter(arr, lambda x: (x["prob"] > threshold) & (x["aspect"] != other))
    return out.select(
        "doc_id", *carry,
        F.when(p_pos > 0.5, F.lit(sentiment_classes[1])).otherwise(F.lit(sentiment_classes[0])).alias("sentiment"),
        rnd(p_pos, 6).alias("p_positive"),
        F.greatest(p_pos, p_neg).alias("confidence"),
        F.transform(F.sort_array(kept, asc=False), lambda x: x["aspect"]).alias("aspect_list"),
        F.array(*[(vector_to_array(f"p_a{k}")[1] > threshold).cast("double")
                  for k in range(len(aspect_classes))]).alias("aspect_pred"))


def evaluation_table(pred: DataFrame, n_classes: int, label_col: str = "label", pred_col: str = "pred",
                     truth_arr: str = "aspect_labels", pred_arr: str = "aspect_pred") -> DataFrame:
    """One aggregation, one row: binary counts and F1s, accuracy, aspect micro-F1."""
    y, p = F.col(label_col), F.col(pred_col)
    t, q = F.col(truth_arr), F.col(pred_arr)
    atp = sum(((t[k] == 1) & (q[k] == 1)).cast("long") for k in range(n_classes))
    afp = sum(((t[k] == 0) & (q[k] == 1)).cast("long") for k in range(n_classes))
    afn = sum(((t[k] == 1) & (q[k] == 0)).cast("long") for k in range(n_classes))
    a = pred.agg(F.count(F.lit(1)).alias("n"),
                 F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
                 F.sum(atp).alias("atp"), F.sum(afp).alias("afp"), F.sum(afn).alias("afn"))

    def f1(tp, fp, fn):
        d = 2 * F.col(tp) + F.col(fp) + F.col(fn)
        return F.when(d > 0, rnd(2 * F.col(tp) / d, 9)).otherwise(F.lit(0.0))
    n = F.col("n")
    return a.select("n", "tp", "fp", "fn", "tn", f1("tp", "fp", "fn").alias("f1_positive"),
                    f1("tn", "fn", "fp").alias("f1_negative"),
                    F.when(n > 0, rnd((F.col("tp") + F.col("tn")) / n, 9)).otherwise(F.lit(0.0)).alias("accuracy"),
                    f1("atp", "afp", "afn").alias("aspect_micro_f1"))


def first_best(figures: DataFrame, order_col: str, f1_col: str) -> DataFrame:
    """``figures`` (a row per candidate) with ``chosen``: true for the first with the highest F1."""
    best = figures.agg(F.max(f1_col)).scalar()
    first = figures.filter(F.col(f1_col) == best).agg(F.min(order_col)).scalar()
    return figures.withColumn("chosen", F.col(order_col) == first)


def select_best(candidates: list[tuple[float, PipelineModel, float]]):
    """The first candidate with the strictly highest validation F1 (ties keep the earlier)."""
    best = None
    for reg, model, f1 in candidates:
        if best is None or f1 > best[2]:
            best = (reg, model, f1)
    return best


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


#: rows of a batch that goes to a scorer
BATCH_ROWS = 2000


def score_partitions(df: DataFrame, make_scorer, schema: str) -> DataFrame:
    """Batch-score with a caller-supplied model function: ``make_scorer()`` is called once
    per partition (load the model there), then applied to each Arrow batch."""
    from trustlens.session import ship_package
    ship_package(df.sparkSession)
    # texts are long: a worker holds so many rows at once
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(key))
    df.sparkSession.conf.set(key, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)

    def run(batches):
        scorer = make_scorer()
        for pdf in batches:
            yield scorer(pdf)
    return df.mapInPandas(run, schema=schema)
