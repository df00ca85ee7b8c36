"""Compare sets of shingles in tiles: groups of candidates, bands of sizes, blocks, and exact links inside a tile."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources.shared import write_shared

TILE = ["component", "low", "i", "high", "j"]


def local_components(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes, on top of earlier labels."""
    labels = np.arange(n) if labels is None else labels
    while True:
        low = np.minimum(labels[u], labels[v])
        new = labels.copy()
        np.minimum.at(new, labels[u], low)
        np.minimum.at(new, labels[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def exact_links(sets: list[np.ndarray], split: int, threshold: float, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with a Jaccard similarity of ``threshold`` or more: all, or across ``split`` if it is positive."""
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = np.array([[n[0], len(np.intersect1d(*sets, assume_unique=True))], [0, n[1]]], dtype=np.float64)
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        number = np.cumsum(new) - 1
        shared = np.bincount(number) > 1
        keep = shared[number]
        number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
        common = np.zeros((len(sets), len(sets)), dtype=np.float64)
        for at in range(0, int(number[-1]) + 1 if len(number) else 0, chunk):
            a, b = np.searchsorted(number, [at, at + chunk])
            x = np.zeros((len(sets), chunk), dtype=np.float32)
            x[owner[a:b], number[a:b] - at] = 1
            common += x @ x.T
    ok = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9
    i, j = np.nonzero(np.triu(ok, 1))
    if split > 0:
        across = (i < split) & (j >= split)
        i, j = i[across], j[across]
    return i, j


def deal_bands(members: DataFrame, threshold: float, tile_docs: int, tile_shingles: int, spread: list[str]) -> DataFrame:
    """``members`` (component, n, ...) with band, block, blocks, above and below: what ``tiles_of`` makes each row's tiles from.

    Two linked sets differ in size by the threshold's factor at most. A group is cut into bands of sizes, of which only
    neighbours can hold a pair, and a band into blocks by the hash of ``spread``; two blocks are one tile of about
    2 * ``tile_docs`` sets at most. A crowd makes more tiles and not larger ones; every two sets share one tile at most.
    """
    # a little wider than the factor, so that rounding never puts two sets of that ratio two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / (1e-4 - 1.001 * math.log(threshold))).cast("int")
    members = write_shared(members.withColumn("band", band), "group-members")
    sizes = members.groupBy("component", "band").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    blocks = F.greatest(F.ceil(F.col("m") / tile_docs), F.ceil(F.col("t") / tile_shingles)).cast("int")
    sizes = write_shared(sizes.select("component", "band", blocks.alias("blocks")), "band-sizes")
    near = lambda by, name: sizes.select("component", (F.col("band") + by).alias("band"), F.col("blocks").alias(name))
    # the few sizes are joined to each other first: a member needs one lookup
    sizes = sizes.join(near(-1, "above"), ["component", "band"], "left").join(near(1, "below"), ["component", "band"], "left")
    sizes = sizes.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("above", "below")})
    members = members.join(write_shared(sizes, "band-blocks"), ["component", "band"])
    return members.withColumn("block", F.pmod(F.xxhash64(*spread), F.col("blocks")).cast("int"))


DEALT = ["component", "band", "block", "blocks", "above", "below"]


def tiles_of() -> Column:
    """The tiles in which a row that ``deal_bands`` has dealt meets all it can be linked with."""
    here, mine = F.col("band"), F.col("block")

    def tile(low: Column, i: Column, high: Column, j: Column) -> Column:
        return F.struct(low.alias("low"), i.cast("int").alias("i"), high.alias("high"), j.cast("int").alias("j"))

    none = F.array().cast("array<struct<low:int,i:int,high:int,j:int>>")
    each = lambda c, f: F.when(F.col(c) > 0, F.transform(F.sequence(F.lit(0), F.col(c) - 1), f)).otherwise(none)
    return F.concat(
        each("blocks", lambda x: tile(here, F.least(mine, x), here, F.greatest(mine, x))),
        each("above", lambda x: tile(here, mine, here + 1, x)),
        each("below", lambda x: tile(here - 1, x, here, mine)),
    )


def tile_split(pdf) -> int | None:
    """How many of a tile's rows, which come by band and block, are on its first side: 0 if it has one side, None if it holds no pair."""
    at = pdf.iloc[0]
    one = at["low"] == at["high"] and at["i"] == at["j"]
    split = 0 if one else int(((pdf["band"] == at["low"]) & (pdf["block"] == at["i"])).sum())
    return None if len(pdf) < 2 or (not one and split in (0, len(pdf))) else split
