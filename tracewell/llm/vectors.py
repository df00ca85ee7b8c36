"""Near-duplicate vectors by int8 tile products, and exact top-k by KD-trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.batches import by_key
from tracewell.operators.bounded import broadcast_if_small
from tracewell.operators.components import connected_components
from tracewell.operators.tiles import local_components
from tracewell.sources.shared import write_shared


def usable(embedding: str) -> Column:
    """No null, no NaN and no infinity in the vector, and at least one component."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite, F.lit(False))


# ---------------------------------------------------------------- near duplicates


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled by a power of two, unit rows): the scale keeps norms of very small and very large components in range."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, norm of what rounding lost) of each unit vector."""
    scale = np.abs(unit).max(axis=1) / 127
    values = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - values * scale[:, None], axis=1)
    return values, scale, lost


Quantised = tuple[np.ndarray, np.ndarray, np.ndarray]


def tile_products(a: Quantised, b: Quantised, threshold: float, same: bool, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i in a, j in b, sure): pairs of quantised vectors that can reach ``threshold``, and whether they surely do; ``same``: i < j only.

    With x = s q + e the product of two unit vectors differs from s s' q.q' by at most |e| (1 + |e'|) + |e'|.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    exact = np.float32 if 127 * 127 * qa.shape[1] < 1 << 24 else np.float64  # whole sums are exact in it
    qb = qb.astype(exact).T
    slack = 1e-5
    for at in range(0, len(qa), rows):
        near = (qa[at : at + rows].astype(exact) @ qb) * (sa[at : at + rows, None] * sb).astype(np.float32)
        bound = ea[at : at + rows, None].astype(np.float32) * (1 + eb).astype(np.float32) + eb.astype(np.float32)
        i, j = np.nonzero(near + bound >= threshold - slack)
        sure = (near - bound)[i, j] >= threshold + slack
        i += at
        if same:
            i, j, sure = i[i < j], j[i < j], sure[i < j]
        yield i, j, sure


def _unit(centres: np.ndarray) -> np.ndarray:
    """Centres as doubles of length one."""
    c = centres.astype(np.float64)
    return c / np.linalg.norm(c, axis=-1, keepdims=True)


def _sums(cid: np.ndarray, weight: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(cid, links, root) of the vectors that the pairs link: sums and a spanning forest."""
    links, labels = np.zeros(len(cid)), None
    for u, v in pairs:
        links += np.bincount(u, weights=weight[v], minlength=len(cid)) + np.bincount(v, weights=weight[u], minlength=len(cid))
        labels = local_components(len(cid), u, v, labels)
    hit = np.flatnonzero(links)
    return pd.DataFrame({"cid": cid[hit], "links": links[hit].astype(np.int64), "root": cid[labels[hit]] if len(hit) else cid[:0]})


def link_vectors(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9,
    block: int = 8192, max_pivots: int = 1024, max_centre_bytes: int = 64 << 20, max_broadcast: int = 100_000,
) -> DataFrame:
    """(key, n_links, component_id, kept): links are pairs of rows with cosine >= ``threshold`` in doubles.

    Equal vectors become one weighted row first, so copies cost no products. The rest is dealt into
    blocks around at most ``max_pivots`` sampled pivots; each pair of blocks is a tile, and a tile whose
    blocks are too far apart for any link (angle of centres less both radii) is left out, as long
    as the centres are small enough to hand out (``max_centre_bytes`` in all, as single floats); beyond that all
    tiles are computed. Only int8 values, scales and error norms travel to the tiles. Pairs that the error bounds decide
    are counted there; for the others the tile names the vectors, which are then brought in full precision, once a tile, and
    only pairs that the bounds leave open are computed in doubles. A tile gives sums of links and a spanning forest, never its pairs.

    Vectors that are null, empty, zero or hold null or non-finite components have no link and are
    their own component. Vectors of different lengths have no link. Rows are told apart by their vectors: those
    that share a key have their own links each. A null key gets no links and a null component and is kept. Repeated rows link
    with each other. Other columns are left out. An empty table gives an empty one.
    """
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"  # floats travel as they came
    raw = vectors.select(F.col(key).cast("long").alias("_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("_v"))
    good = usable("_v") & F.exists("_v", lambda x: x != 0) & F.col("_id").isNotNull()
    distinct = (
        raw.filter(good).groupBy("_v").agg(F.min("_id").alias("rep"), F.count("*").alias("n"))
        .withColumn("dim", F.size("_v")).withColumn("cid", F.monotonically_increasing_id())  # fixed by the write
    )
    distinct = write_shared(distinct, "vectors")
    total = distinct.count()
    pivots = max(1, min(max_pivots, -(-total // block)))
    chosen = distinct.orderBy(F.xxhash64(F.lit(5), "cid"), "cid").limit(pivots).select("_v").collect()
    by_dim: dict[int, list] = {}
    for r in chosen:
        by_dim.setdefault(len(r["_v"]), []).append(r["_v"])
    centres = {d: unit_rows(np.array(v))[1] for d, v in by_dim.items()}

    @F.pandas_udf("pivot int, q binary, s double, e double")
    def small(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """The nearest pivot and the quantised form of each vector."""
        for vs in parts:
            dims = vs.map(len).to_numpy()
            pivot, q = np.zeros(len(vs), dtype=np.int32), np.empty(len(vs), dtype=object)
            s, e = np.zeros(len(vs)), np.zeros(len(vs))
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                _, unit = unit_rows(np.stack([vs.iloc[i] for i in mine]))
                if d in centres:
                    pivot[mine] = np.argmax(unit @ centres[d].T, axis=1)
                values, s[mine], e[mine] = quantise(unit)
                q[mine] = [x.tobytes() for x in values]
            yield pd.DataFrame({"pivot": pivot, "q": q, "s": s, "e": e})

    near = write_shared(distinct.select("cid", "n", "dim", "_v", small("_v").alias("_q")).select("cid", "n", "dim", "_q.*", "_v"), "quantised")
    parts = near.groupBy("dim", "pivot").count().select(
        "dim", "pivot", F.ceil(F.col("count") / (0.75 * block)).cast("int").alias("parts")
    )
    # as many rows as pivots, for each vector length that occurs
    placed = near.join(parts, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))

    def bring(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(at[0])
        q, s, e = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(-1, dim), pdf["s"].to_numpy(), pdf["e"].to_numpy()
        about = q * s[:, None]  # each unit vector to within e
        centre = about.mean(axis=0)
        centre = (centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-9 else about[0] / np.linalg.norm(about[0])).astype("<f4")
        # against the centre as it is read back, so that its rounding is in the radius
        radius = float(np.arccos(np.clip(about @ _unit(centre) - e - 1e-9, -1, 1)).max())
        return pd.DataFrame([{
            "dim": dim, "block": f"{dim}/{at[1]}/{at[2]}", "cids": pdf["cid"].to_numpy("<i8").tobytes(), "ns": pdf["n"].to_numpy("<i8").tobytes(),
            "q": q.tobytes(), "s": s.astype("<f8").tobytes(), "e": e.astype("<f8").tobytes(), "centre": centre.tobytes(), "radius": radius,
        }])

    blocks = placed.groupBy("dim", "pivot", "part").applyInPandas(
        bring, "dim int, block string, cids binary, ns binary, q binary, s binary, e binary, centre binary, radius double"
    )
    blocks = write_shared(blocks, "blocks")
    # short rows: one for thousands of vectors, without their centres
    number = F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1
    names = write_shared(blocks.select("dim", "block").withColumn("no", number), "block-names")
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    few = (blocks.agg(F.sum(F.length("centre"))).first()[0] or 0) <= max_centre_bytes
    summary: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if few:
        found = blocks.select("dim", "block", "centre", "radius").join(names, ["dim", "block"]).toPandas().sort_values("no")
        for d, own in found.groupby("dim"):
            summary[int(d)] = (np.frombuffer(b"".join(own["centre"]), "<f4").reshape(-1, int(d)), own["radius"].to_numpy())

    @F.pandas_udf("array<int>")
    def partners(dims: pd.Series, no: pd.Series) -> pd.Series:
        """Blocks that can hold a link with this one."""
        out, units = [], {d: _unit(summary[d][0]) for d in set(dims)}
        for d, k in zip(dims, no, strict=True):
            cs, rs = units[d], summary[d][1]
            apart = np.arccos(np.clip(cs @ cs[k], -1, 1))
            out.append(np.flatnonzero(apart - rs - rs[k] <= reach).astype(np.int32))
        return pd.Series(out)

    totals = names.groupBy("dim").count()
    every = names.join(totals, "dim").select("block", "dim", "no", F.sequence(F.lit(0), (F.col("count") - 1).cast("int")).alias("with"))
    pairs = names.select("block", "dim", "no", partners("dim", "no").alias("with")) if few else every
    pairs = pairs.select("block", "dim", "no", F.explode("with").alias("other")).select(
        "block", "no", "dim", F.least("no", "other").alias("i"), F.greatest("no", "other").alias("j")
    ).distinct()
    tiles = blocks.select("block", "cids", "ns", "q", "s", "e").join(pairs, "block")

    def tile(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        ids, ns, ss, es = ([np.frombuffer(x, k) for x in pdf[c]] for c, k in (("cids", "<i8"), ("ns", "<i8"), ("s", "<f8"), ("e", "<f8")))
        sides = [(np.frombuffer(q, np.int8).reshape(-1, int(at[0])), s, e) for q, s, e in zip(pdf["q"], ss, es, strict=True)]
        cid, shift = np.concatenate(ids), len(ids[0]) if len(ids) > 1 else 0
        open_ = np.zeros(len(cid), dtype=bool)

        def sure() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j, yes in tile_products(sides[0], sides[-1], threshold, len(sides) == 1):
                j = j + shift
                open_[i[~yes]] = open_[j[~yes]] = True
                yield i[yes], j[yes]

        found = _sums(cid, np.concatenate(ns), sure())
        more = np.flatnonzero(open_)
        asked = pd.DataFrame({"cid": cid[more], "side": (more >= shift).astype(np.int32) if shift else np.zeros(len(more), np.int32)})
        made = pd.concat([found, asked])
        made["dim"], made["i"], made["j"] = int(at[0]), int(at[1]), int(at[2])
        return made.astype({c: "Int64" for c in ("links", "root", "side")})[["dim", "i", "j", "cid", "links", "root", "side"]]

    done = tiles.groupBy("dim", "i", "j").applyInPandas(tile, "dim int, i int, j int, cid long, links long, root long, side int")
    done = write_shared(done, "tile-links")
    # what the bounds leave open, in full precision; a tile's sides come in the order of their vectors
    asked = done.filter("side IS NOT NULL").select("dim", "i", "j", "side", "cid")
    asked = near.select("cid", "n", "q", "s", "e", "_v").join(broadcast_if_small(asked, max_broadcast), "cid").repartition("dim", "i", "j").sortWithinPartitions("dim", "i", "j", "side", "cid")

    def compute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_key(parts, ["dim", "i", "j"]):
            dim, one = int(pdf["dim"].iloc[0]), pdf["i"].iloc[0] == pdf["j"].iloc[0]
            q = (np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(-1, dim), pdf["s"].to_numpy(), pdf["e"].to_numpy())
            x, _ = unit_rows(np.stack(pdf["_v"].to_list()))
            norm, shift = np.linalg.norm(x, axis=1), 0 if one else int((pdf["side"] == 0).sum())
            sides = [q] if one else [tuple(c[:shift] for c in q), tuple(c[shift:] for c in q)]

            def exact(sides=sides, x=x, norm=norm, shift=shift) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i, j, yes in tile_products(sides[0], sides[-1], threshold, len(sides) == 1):
                    i, j = i[~yes], j[~yes] + shift
                    for k in range(0, len(i), 1 << 16):
                        u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                        near_ = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= threshold
                        yield u[near_], v[near_]

            yield _sums(pdf["cid"].to_numpy(np.int64), pdf["n"].to_numpy(), exact())

    later = write_shared(asked.mapInPandas(compute, "cid long, links long, root long"), "open-links")
    found = done.filter("links IS NOT NULL").select("cid", "links", "root").unionByName(later)
    groups = connected_components(found, "cid", "root").withColumnRenamed("node", "cid")
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = write_shared(sums.join(groups, "cid").join(distinct.select("cid", "rep"), "cid"), "linked-vectors")
    linked = linked.join(linked.groupBy("component").agg(F.min("rep").alias("first")), "component").select("cid", "links", "first")
    classes = (
        distinct.join(broadcast_if_small(write_shared(linked, "vector-links"), max_broadcast), "cid", "left")
        .select("_v", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "rep").alias("component"), "n")
    )
    # rows that link with nothing have no class: their ids join the key, so that they are not one hot key
    bare = raw.select("_id", F.when(good, F.col("_v")).alias("_v"))
    bare = bare.withColumn("_spread", F.when(F.col("_v").isNull(), F.xxhash64("_id")).otherwise(F.lit(0).cast("long")))
    joined = bare.join(classes.withColumn("_spread", F.lit(0).cast("long")), ["_v", "_spread"], "left").select(
        F.col("_id").alias(key),
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "_id").alias("component_id"),
    )
    return joined.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

# ---------------------------------------------------------------- exact top-k


class KdTree:
    """Median splits on the widest dimension, with the tight bounding box and the smallest id of each node."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 256):
        lo, hi, child, span, low_id = [], [], [], [], []
        order = np.arange(len(points))

        def build(a: int, b: int) -> int:
            at, mine = len(lo), points[order[a:b]]
            lo.append(mine.min(axis=0))
            hi.append(mine.max(axis=0))
            low_id.append(ids[order[a:b]].min())
            child.append((-1, -1))
            span.append((a, b))
            if b - a > leaf and points.shape[1]:
                axis = int(np.argmax(hi[at] - lo[at]))
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(mine[:, axis], middle)]
                child[at] = (build(a, a + middle), build(a + middle, b))
            return at

        if len(points):
            build(0, len(points))
        self.lo, self.hi, self.child, self.span = np.array(lo), np.array(hi), child, span
        self.low_id = low_id
        self.points, self.ids = points[order], ids[order]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """Up to k (score, -id) of each query that are better than or join ``floor``, its best so far.

        Nodes are visited best first by the largest inner product that their box allows; a node is
        left out when even that cannot beat the k-th best found here or handed over. Sums of large numbers are whole in no
        double: bounds then get a margin, and scores are computed in integers.
        """
        bounds = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        large = np.abs(queries) @ np.maximum(np.abs(self.lo), np.abs(self.hi)).T
        big = bool(large.size and not large.max() < 1 << 51)
        if big:
            bounds = np.minimum(np.nan_to_num(bounds + 1e-12 * (1 + queries.shape[1]) * large, nan=math.inf), float(1 << 63))
        found = []
        for q in range(len(queries)):
            best = list(floor[q])
            heapq.heapify(best)
            start = set(best)
            limit, heap = bounds[q], [(-bounds[q][0], 0)]
            while heap:
                low, node = heapq.heappop(heap)
                if len(best) == k and (-low, -self.low_id[node]) < best[0]:
                    if -low < best[0][0]:
                        break
                    continue
                left, right = self.child[node]
                if left >= 0:
                    heapq.heappush(heap, (-limit[left], left))
                    heapq.heappush(heap, (-limit[right], right))
                    continue
                a, b = self.span[node]
                scores = _inner(self.points[a:b], queries[q], big)
                ids = self.ids[a:b]
                if len(best) == k:
                    some = np.flatnonzero(scores >= best[0][0])
                    scores, ids = scores[some], ids[some]
                if len(scores) > 4 * k:
                    some = np.array(sorted(range(len(ids)), key=lambda x: (-scores[x], ids[x]))[: k + 1]) if big else np.lexsort((ids, -scores))[: k + 1]
                    scores, ids = scores[some], ids[some]
                for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                    if i == own[q]:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (int(s), -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (int(s), -i))
            found.append([x for x in best if x not in start])
        return found


TOP = (1 << 63) - 1


def _inner(points: np.ndarray, query: np.ndarray, big: bool) -> np.ndarray:
    """Exact inner products of whole numbers; where doubles could round, as Python integers held within the range of a long."""
    if not big:
        return points @ query
    q = [int(x) for x in query.tolist()]
    exact = [sum(int(x) * y for x, y in zip(p, q, strict=True)) for p in points.tolist()]
    return np.array([max(-TOP, min(TOP, x)) for x in exact], dtype=object)


def _whole(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * v), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def top_k_products(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = 5,
    shard_rows: int = 8192, query_rows: int = 256, leaf: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(256 x), ties to the smaller id.

    Rows are dealt to shards by hash; a shard builds its KD-tree once and answers blocks of queries.
    A block first visits the shard its queries were hashed to and takes the k-th scores found there
    along to all others, which then leave out most boxes and return only what can still enter.
    Queries and shards both grow with the input, so both move in blocks and nothing is broadcast.

    Null vectors and ones with null or non-finite components take no part; zero and empty vectors do. Rows
    with a query's own key are never its result; vectors of another length neither. Rows without a
    key take no part; repeated rows with one key and vector count once. A score is exact while it fits a long;
    beyond that it is the nearest long, and such scores tie.
    """
    rows = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(
        (usable("v") | (F.size("v") == 0)) & F.col("id").isNotNull()
    ).distinct()
    base, asked = write_shared(rows(vectors), "points"), write_shared(rows(queries), "asked")
    shards = max(1, -(-base.count() // shard_rows))
    place = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")

    def bring(kind: str):
        def run(k_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = _whole(np.stack(pdf["v"].to_list())).astype("<f8")
            return pd.DataFrame([{
                "dim": k_[0], "shard": k_[1], "block": k_[2] if kind == "q" else -1,
                "ids": pdf["id"].to_numpy("<i8").tobytes(), "data": x.tobytes(), "best": None,
            }])

        return run

    packed = "dim int, shard int, block int, ids binary, data binary, best array<array<struct<score:long,id:long>>>"
    keyed = lambda df: df.withColumn("dim", F.size("v")).withColumn("shard", place)
    trees = write_shared(keyed(base).groupBy("dim", "shard", F.lit(-1).alias("block")).applyInPandas(bring("t"), packed), "shards")
    parts = max(1, -(-asked.count() // (shards * query_rows)))
    blocks = keyed(asked).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)).cast("int"))
    blocks = write_shared(blocks.groupBy("dim", "shard", "block").applyInPandas(bring("q"), packed), "query-blocks")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.frombuffer(row.ids, "<i8")
                x = np.frombuffer(row.data, "<f8").reshape(len(ids), row.dim)
                if row.block < 0:
                    at, tree = (row.dim, row.shard), KdTree(x, ids, leaf)
                    continue
                if at != (row.dim, row.shard):
                    continue
                floor = [[(int(b["score"]), -int(b["id"])) for b in q] for q in row.best] if row.best is not None else [[] for _ in ids]
                got = tree.search(x, ids, k, floor)
                out = [(int(q), -i, s, row.home) for q, best in zip(ids, got, strict=True) for s, i in best]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score", "home"])

    def visit(sent: DataFrame) -> DataFrame:
        both = trees.withColumn("home", F.lit(-1)).unionByName(sent)
        near = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block", "home")
        return near.mapInPandas(answer, "query_id long, vec_id long, score long, home int")

    first = write_shared(visit(blocks.withColumn("home", F.col("shard"))), "first-answers")
    best = first.groupBy("query_id").agg(F.collect_list(F.struct("score", F.col("vec_id").alias("id"))).alias("best"))

    # the k best of each query go into its block, in the order of its ids
    def with_best(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {int(q): list(b) for q, b in zip(right["query_id"], right["best"], strict=True)}
        left = left.copy()
        left["best"] = [[known.get(int(i), []) for i in np.frombuffer(x, "<i8")] for x in left["ids"]]
        return left

    place_of = F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")
    block_of = F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(parts)).cast("int")
    best = best.withColumn("shard", place_of).withColumn("block", block_of)
    informed = blocks.groupBy("shard", "block").cogroup(best.groupBy("shard", "block")).applyInPandas(with_best, packed)
    informed = write_shared(informed, "informed-blocks")
    others = informed.withColumn("home", F.col("shard")).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    others = others.filter("to <> home").withColumn("shard", F.col("to").cast("int")).drop("to")
    every = first.select("query_id", "vec_id", "score").unionByName(visit(others).select("query_id", "vec_id", "score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        every.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k_products(rows, rows.filter("vec_id % 50 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256.0::DOUBLE * x) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
