"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; stages but the
last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again for the next.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import discard, made, source, written
from trustlens.llm.ngram_jaccard import ngram_components
from trustlens.llm.packing import pack_documents
from trustlens.llm.pii import redacted
from trustlens.llm.quality_mcd import judged
from trustlens.llm.subwords import default_path
from trustlens.llm.tiling import contaminated


_left: list[str] = []


def _stage(function):
    """A stage. Its scratch tables are deleted when the next one is called, for by then its rows
    have been written."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left)
        begun = len(made())
        out = function(spark, docs, sf_dir)
        _left[:] = made()[begun:]
        return out
    return run_stage


def _key():
    """What tells rows apart: doc_id and text (nulls differ from all values)."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and wordless texts fail them; null languages and sources are groups
    of their own; texts are read whole; repeated rows are judged alike; an empty table stays one. Columns travel in a struct,
    so none clashes with a name of the operator's."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text", "lang", "source")
    return judged(rows, "doc").filter("kept").select("doc.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; of repeated rows one. Documents without
    words are duplicates of nothing. Which member stays is decided by a hash of doc_id and text, so ties are rows that are
    equal in both; null ids are told apart by their texts. An empty table stays one; other columns travel in a struct."""
    named = written(ngram_components(docs.select(_key().alias("doc_id"), "text")), "components")
    verdict = (named.groupBy(F.col("doc_id").alias("k"))
               .agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count(F.lit(1)).alias("rows"))
               .filter("gone or rows > 1"))
    rows = (docs.select(F.struct(*docs.columns).alias("doc"), _key().alias("k")).join(verdict, "k", "left")
            .filter("gone is null or not gone"))
    once = rows.filter("rows is null").select("doc")
    return once.unionByName(rows.filter("rows > 1").groupBy("k").agg(F.first("doc").alias("doc")).select("doc")).select("doc.*")


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Texts are searched whole; null and empty ones hold none; rows equal in doc_id
    and text go or stay together; an empty table on either side changes nothing; other columns travel in a struct."""
    pairs = contaminated(docs.select(_key().alias("doc_id"), "text"), source(spark, sf_dir, "benchmark", "item_id", "text"))
    held = written(pairs.select(F.col("doc_id").alias("k")).distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), _key().alias("k"))
    return rows.join(held, "k", "left_anti").select("doc.*")


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind. Texts are searched whole; null and empty ones stay
    as they are; repeated rows are changed alike; an empty table stays one; of the other columns only ``n_chars`` follows."""
    return redacted(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of token ids. A null or empty text is one piece with the end id alone; a null source
    is the source ""; long texts are cut into pieces; repeated rows are packed each for itself; an empty table gives no rows."""
    return pack_documents(docs.select("doc_id", "text", "source"), default_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("personal_data", personal_data), ("packing", packing)]

#: the stages' methods (robust estimates, links of sets, tiling, expectation-maximisation) are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, before)
        before = made()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
