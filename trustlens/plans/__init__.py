"""Composite jobs: analyse a batch, report on it, score single reviews, train."""
