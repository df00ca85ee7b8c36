"""A stored index of vectors in cells: a search leaves out the cells whose bound is below the k-th score found so far."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.batches import bound_batches
from tracewell.operators.search import BASE_BLOCK, QUERY_BLOCK, best_of_tiles
from tracewell.sources.shared import write_shared


def fit_centres(x: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """At most ``cells`` centres: distinct rows, moved to the means of what is nearest to them."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.linspace(0, len(distinct) - 1, min(cells, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        mine = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(mine, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, mine, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def open_cells(q: np.ndarray, floor: np.ndarray, centres: np.ndarray, radius: np.ndarray, low: int, high: int) -> list[np.ndarray]:
    """Of each query's cells in the order of their bounds those at places ``low`` to ``high`` whose bound reaches its ``floor``.

    No row of a cell scores more than query · centre + |query| * radius; the slack covers rounding.
    """
    size = np.linalg.norm(q, axis=1)[:, None]
    bound = q @ centres.T + size * radius + 1e-9 * size * (np.linalg.norm(centres, axis=1) + radius)
    order = np.argsort(-bound, axis=1, kind="stable")[:, low:high]
    return [o[b[o] >= f] for o, b, f in zip(order, bound, floor, strict=True)]


class VectorIndex:
    """Vectors by key in the cells of at most ``cells`` centres, as Parquet folders below ``path``, with exact searches by dot product.

    Centres are fitted once, at the first ``add``, on at most ``cells * sample`` rows chosen by the hash of their keys, and never move; every row is
    indexed. ``add`` appends the rows whose key is not stored and notes how far a cell's rows lie from its centre; these distances are
    written first, so a driver that stops between the two leaves bounds that are too wide and nothing wrong. ``search`` gives what
    ``vector_search`` gives. The driver and the tasks hold the centres (``cells`` vectors) and no rows.

    Vectors that are null, of another length than ``dim``, or that hold null or non-finite components are not indexed, and as queries they have no
    rows; rows without a key are passed over. Of rows that share a key the smallest vector counts. An empty index finds nothing.
    """

    def __init__(self, spark, path: str, dim: int, cells: int = 64, sample: int = 32):
        self.spark, self.path, self.dim, self.cells, self.sample = spark, path.rstrip("/"), dim, cells, sample
        self.figures: list[dict] = []

    def _read(self, name: str, kind: str) -> DataFrame:
        try:
            return self.spark.read.schema(kind).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing added yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], kind)

    def rows(self) -> DataFrame:
        return self._read("rows", "k long, v array<double>, cell int")

    def balls(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centres, radius, rows) by cell; the radius of a cell without rows is 0."""
        found = sorted(self._read("centres", "cell int, centre array<double>").collect(), key=lambda r: r["cell"])
        centres = np.array([r["centre"] for r in found], dtype=np.float64).reshape(-1, self.dim)
        radius, n = np.zeros(len(found)), np.zeros(len(found), dtype=np.int64)
        for r in self._read("balls", "cell int, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
            radius[r["cell"]], n[r["cell"]] = r["radius"], r["n"]
        return centres, radius, n

    def _usable(self, df: DataFrame, key: str, embedding: str) -> DataFrame:
        """(k, v), one row a key."""
        rows = df.select(F.col(key).cast("long").alias("k"), F.col(embedding).cast("array<double>").alias("v")).filter("k IS NOT NULL AND v IS NOT NULL")
        bad: Column = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
        return rows.filter((F.size("v") == self.dim) & ~bad).groupBy("k").agg(F.min("v").alias("v"))

    def add(self, vectors: DataFrame, key: str, embedding: str, rows_a_file: int = 100_000) -> int:
        """Append the rows whose key is not stored yet; how many there were."""
        bound_batches(self.spark)
        rows = self._usable(vectors, key, embedding).join(self.rows().select("k"), "k", "left_anti")
        rows = write_shared(rows, "new-rows")
        centres = self.balls()[0]
        if not len(centres):
            some = rows.orderBy(F.xxhash64("k"), "k").limit(self.cells * self.sample).select("v").collect()
            if not some:
                return 0
            centres = fit_centres(np.array([r["v"] for r in some], dtype=np.float64), self.cells)
            made = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
            made.coalesce(1).write.parquet(f"{self.path}/centres")

        @F.pandas_udf("cell int, d double")
        def place(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vs in parts:
                x = np.stack(vs.to_list()) if len(vs) else np.zeros((0, centres.shape[1]))
                cell = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "d": np.linalg.norm(x - centres[cell], axis=1)})

        placed = write_shared(rows.select("k", "v", place("v").alias("p")).select("k", "v", "p.*"), "placed-rows")
        balls = write_shared(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")), "new-balls")
        balls.coalesce(1).write.mode("append").parquet(f"{self.path}/balls")
        # as many rows as cells, so the hint is bounded; a full cell is cut into several files
        files = balls.select("cell", F.ceil(F.col("n") / rows_a_file).cast("int").alias("files"))
        dealt = placed.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("k"), F.col("files"))).repartition("cell", "file")
        dealt.select("k", "v", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        return placed.count()

    def search(
        self, queries: DataFrame, key: str, k: int = 10, min_score: float = 0.0, query_id: str = "query_id", query_vector: str = "query_vector",
        growth: int = 4, query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK,
    ) -> DataFrame:
        """(query_id, rank, key, score): the k largest dot products, then those of at least ``min_score``; ties to the smaller key.

        A query asks its cells in the order of their bounds, one, then ``growth`` more, ``growth`` times as many, and so on; from round to round its k-th
        score goes along, and cells below it are neither read nor sent. A round reads the folders of the cells that some query asks,
        and deals a cell's rows and queries into tiles of bounded size. ``figures`` has a round's pairs of query and cell, and its cells.
        """
        bound_batches(self.spark)
        centres, radius, n = self.balls()
        full = np.flatnonzero(n)
        centres, radius, numbers = centres[full], radius[full], full.astype(np.int32)
        asked = write_shared(self._usable(queries, query_id, query_vector).withColumnRenamed("k", "query_id"), "asked-vectors")
        top = self.spark.createDataFrame([], "query_id long, _k long, _s double")
        self.figures, low, step, tile = [], 0, 1, ["cell", "_bb", "_qb"]
        by_score = Window.partitionBy("query_id").orderBy(F.desc("_s"), "_k")

        def asks(low: int, high: int):
            @F.pandas_udf("array<int>")
            def cells(vs: pd.Series, floor: pd.Series) -> pd.Series:
                found = open_cells(np.stack(vs.to_list()), floor.to_numpy(), centres, radius, low, high) if len(vs) else []
                return pd.Series([numbers[c] for c in found], dtype=object)

            return cells

        while low < len(full):
            high = min(len(full), low + step)

            last = top.groupBy("query_id").agg(F.count("*").alias("n"), F.min("_s").alias("s"))
            floor = F.greatest(F.lit(float(min_score)), F.when(F.col("n") == k, F.col("s")).otherwise(-math.inf))
            pairs = asked.join(last, "query_id", "left").select("query_id", "v", F.explode(asks(low, high)("v", floor)).alias("cell"))
            pairs = write_shared(pairs, "open-cells")
            counts = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}  # at most ``cells`` rows
            self.figures.append({"pairs": sum(counts.values()), "cells": len(counts), "of": len(full)})
            if not counts:  # bounds fall along a query's cells: none is open later either
                break
            cut = [(c, -(-int(n[c]) // base_block), -(-m // query_block)) for c, m in counts.items()]
            cut = F.broadcast(self.spark.createDataFrame(cut, "cell int, bs int, qs int"))
            each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
            part = lambda x, c: F.pmod(F.xxhash64(x), F.col(c)).cast("int")
            base = self.rows().filter(F.col("cell").isin(list(counts))).join(cut, "cell")
            base = base.select("cell", part("k", "bs").alias("_bb"), each("qs").alias("_qb"), F.lit(1).alias("_side"), F.col("k").alias("_k"), F.col("v").alias("_v"))
            mine = pairs.join(cut, "cell").select("cell", each("bs").alias("_bb"), part("query_id", "qs").alias("_qb"), F.lit(0).alias("_side"), F.col("query_id").alias("_k"), F.col("v").alias("_v"))
            found = best_of_tiles(mine.unionByName(base), tile, k)
            top = top.unionByName(found).withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") <= k).drop("_r")
            top = write_shared(top, "best-so-far")
            low, step = high, step * growth
        ranked = top.withColumn("rank", F.row_number().over(by_score)).filter(F.col("_s") >= min_score)
        return ranked.select("query_id", "rank", F.col("_k").alias(key), F.round("_s", 4).alias("score"))
