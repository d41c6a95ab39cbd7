"""Scoring review streams: every micro-batch is scored as one batch."""

from trustlens.streaming.scoring import row_signals, score_stream

__all__ = ["row_signals", "score_stream"]
