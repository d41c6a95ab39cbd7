"""Structured Streaming entry points.

The near-duplicate signal compares a review with the rest of *its batch*, so a stream is
scored one micro-batch at a time with ``foreachBatch``: each micro-batch is a batch.
Output goes to one folder per epoch, overwritten on replay, so a restarted query that
re-runs an epoch leaves exactly one copy of it (the checkpoint records progress).
The row-local signals need no batch and also run as a plain streaming projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trustlens.functions.scores import diversity_score, length_score, quality_score
from trustlens.functions.text import Alphabets, DEFAULT_ALPHABETS
from trustlens.plans.jobs import Predictor, analyze
from trustlens.session import cached, caching


def row_signals(stream: DataFrame, alphabets: Alphabets = DEFAULT_ALPHABETS) -> DataFrame:
    """Length, diversity and quality on a streaming DataFrame (stateless, no shuffle)."""
    return stream.select("doc_id", "text",
                         length_score("text").alias("length"),
                         diversity_score("text", alphabets.score).alias("diversity"),
                         quality_score("text", alphabets.quality, alphabets.capitals).alias("quality"))


def score_stream(stream: DataFrame, lexicon: DataFrame, predict: Predictor, sink_path: str,
                 checkpoint_path: str, alphabets: Alphabets = DEFAULT_ALPHABETS,
                 with_similarity: bool = True, available_now: bool = True,
                 processing_time: str | None = None) -> StreamingQuery:
    """Score every micro-batch of (doc_id, text) rows as a batch and write it as parquet
    under ``sink_path/epoch=<id>``. ``checkpoint_path`` must be a shared folder."""
    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        with caching() as tables:
            scored = analyze(batch, lexicon, predict, alphabets, with_similarity)
            scored.write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch_id}")
        tables.release()  # this micro-batch's own tables, before the next one

    lexicon = cached(lexicon)  # read by every micro-batch
    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()
