"""Column expressions for scoring predicted locations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def combined_score(error, percent) -> Column:
    """``1 / (1 + error) + percent / 100``; NULL when there is no error to score."""
    error = F.col(error) if isinstance(error, str) else error
    percent = F.col(percent) if isinstance(percent, str) else percent
    return 1 / (1 + error) + percent / 100


def percentage(part, whole) -> Column:
    """``100 * part / whole``, NULL for an empty whole."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))
