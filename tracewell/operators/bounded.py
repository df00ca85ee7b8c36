"""Broadcast hints that hold only after a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``max_rows`` rows, else ``df`` as it is.

    Pass a table that is cheap to count (one already written out). Without the hint the join
    is an ordinary shuffle join, whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df``, narrow and of distinct keys, for a join with wide rows: broadcast when it has at most ``max_rows`` rows, else hashed
    partition by partition behind the shuffle, so that the wide rows are never sorted and do not spill."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("shuffle_hash")
