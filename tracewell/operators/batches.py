"""Bounds on what one Arrow batch of texts holds in a Python worker, and groups of sorted rows across batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Lower the session's batch limits where they are higher: texts of 100 kB in batches of 10,000 rows would be a gigabyte."""
    now = int(spark.conf.get(ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(ROWS, str(rows))
    spark.conf.set(BYTES, str(megabytes << 20))


def release_memory() -> None:
    """Give back what this Python worker holds unused, in Arrow's pool and in the C heap; called at the end of a task.

    Workers outlive their tasks: without this each keeps the peak of every task it has run, beside those that run now.
    """
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def first_of_equal(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by ``keys``, less those that repeat the row before them; nothing is held between batches but one row."""
    last = None
    for pdf in parts:
        if not len(pdf):
            continue
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        if last is not None:
            new[0] = tuple(pdf[keys].iloc[0]) != last
        last = tuple(pdf[keys].iloc[-1])
        yield pdf[new]


def by_key(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come sorted by ``keys``, across batches."""
    held: list[pd.DataFrame] = []
    for pdf in parts:
        if not len(pdf):
            continue
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        if held:
            new[0] = bool((held[-1][keys].iloc[-1] != pdf[keys].iloc[0]).any())
        cuts = [*np.flatnonzero(new), len(pdf)]
        if cuts[0] > 0:
            held.append(pdf.iloc[: cuts[0]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [pdf.iloc[a:b]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
