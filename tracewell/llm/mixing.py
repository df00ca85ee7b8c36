"""Mixing sources to target weights by capped water-filling.

Sources share a total in proportion to their weights; a source that would need more than
``max_epochs`` repetitions is clamped there and the excess goes to the others by weight until
none is above. Each source then takes whole repetitions of all its documents and, in a seeded
order, one more repetition of as many as the remaining fraction needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.bounded import broadcast_if_small
from tracewell.sources.shared import write_shared

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the seeded hash in which a source's sizes are first summed; only the range that holds
#: the cut is then put in order.
RANGE_DIGITS = 3


def water_fill(sources: DataFrame, weight: str = "weight", cap: str = "cap", total: Column | None = None) -> DataFrame:
    """``sources`` with ``target``: weight * level, at most ``cap``, where the targets sum to ``total``.

    In the order of cap / weight the sources fill up one after the other, so the level is read
    from prefix sums: with the first k full it is (total - their caps) / (other weights), and k is
    the first for which the next source is not full. One row a source; no loop. ``total`` is an
    expression over all rows, by default the sum of the caps; from there on every source is
    full. A weight of zero gets zero.
    """
    order = Window.orderBy(F.col("_ratio").asc_nulls_last(), F.col("_row"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("_ratio", F.col(cap) / F.when(F.col(weight) > 0, F.col(weight)))
    rows = rows.withColumn("_row", F.xxhash64(*[F.col(c) for c in sources.columns]))
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("_total", total if total is not None else F.sum(cap).over(everything))
        .withColumn("_full", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("_open", F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.when(F.col("_open") > 0, F.col("_open")))
    )
    first = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_row", "_level"))).over(everything)
    rows = rows.withColumn("_level", first["_level"])
    level = F.when(F.col("_ratio") > F.col("_level"), F.col(weight) * F.col("_level")).otherwise(F.col(cap))
    target = F.when(F.col(weight) > 0, F.least(F.col(cap), level)).otherwise(F.lit(0.0))
    return rows.withColumn("target", target.cast("double")).select(*sources.columns, "target")


def cycled_weights(sources: DataFrame, source: str, cycle: tuple[float, ...]) -> DataFrame:
    """``sources`` with the weights of ``cycle`` in turn, by code point, null last."""
    turn = (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(cycle)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), turn.cast("int") + 1))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_epochs: float = 3.0,
    seed: str = "mix-1",
    max_broadcast_sources: int = 100_000,
    keep: bool = False,
) -> DataFrame:
    """(key, source, size, source_size, target, repeats, part) for every row of ``docs``; with ``keep`` all columns of ``docs`` and the
    last five, in place of any of the same name.

    The size is the number of words. ``repeats`` whole repetitions of the document are in the mix
    and ``part`` words of one more, which only the document at the cut of its source has; so each
    source takes its target to the word (rounded down) and no document more than
    ``max_epochs`` times. The seeded order is md5 of seed and key, then the size;
    equal rows share an order and are taken in turn. A null or empty text has size 0 and is never
    taken; null sources are one source, a null key is hashed as "". The documents are read
    once for their sizes, and with ``keep`` once more for their columns; a hot source is spread over hash ranges before any ordering,
    and of the range at its cut only counts by (order, size, part of the table) are put in order, so that neither null keys nor
    repeated ones gather their rows. Sources are few, one row each, and are put in order in one task.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    hash_range = F.substring("_order", 1, RANGE_DIGITS).alias("_range")
    own = {"_key": F.col(key), "_source": F.col(source), "size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"), "_order": order}
    sizes = write_shared(docs.select(*[c.alias(n) for n, c in own.items()]), "mix-sizes")
    ranges = write_shared(sizes.groupBy("_source", hash_range).agg(F.sum("size").alias("words")), "mix-ranges")
    sources = ranges.groupBy("_source").agg(F.sum("words").alias("source_size"))
    sources = cycled_weights(sources, "_source", cycle).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    sources = water_fill(sources, total=F.sum("source_size").over(Window.partitionBy()).cast("double"))
    wanted = F.floor(F.col("target") + F.lit(1e-6))
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.select(
        "_source", "source_size", "target", whole.alias("whole"), (wanted - whole * F.col("source_size")).cast("long").alias("rest")
    )
    sources = write_shared(sources, "mix-targets")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    few = broadcast_if_small(sources, max_broadcast_sources)
    # the range in which the running sum passes what is left to take
    running = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    cut = (
        before.withColumnRenamed("_source", "_s").join(few, same("_s", "_source"))
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        .select("_source", F.col("_range").alias("cut_range"), "before")
    )
    plan = sources.withColumnRenamed("_source", "_s").join(cut, same("_s", "_source"), "left").drop("_source")
    plan = broadcast_if_small(write_shared(plan, "mix-plan"), max_broadcast_sources)
    made = ["source_size", "target", "repeats", "part"]
    if keep:  # a text is counted again only where its size is asked for
        columns = [c for c in docs.columns if c not in ("size", *made)]
        rows, some = docs.select(*columns, *[own[c].alias(c) for c in ("_key", "_source", "_order")]), F.coalesce(F.col(text).rlike(WORD), F.lit(False))
        shown, size = [*columns, own["size"].alias("size")], own["size"]
    else:
        rows, some, size = sizes, F.col("size") > 0, F.col("size")
        shown = [F.col("_key").alias(key), F.col("_source").alias(source), "size"]
    rows = rows.withColumn("_range", hash_range).join(plan, same("_source", "_s"))
    at_cut = (F.col("_range") == F.col("cut_range")) & some
    outside = rows.filter(F.coalesce(~at_cut, F.lit(True)))
    outside = outside.withColumn("more", F.when((F.col("_range") < F.col("cut_range")) & some, 1).otherwise(0)).withColumn("part", F.lit(0).cast("long"))
    # one range of 16 ** RANGE_DIGITS of a source: which of its groups of equal rows holds the cut, then which row
    inside = rows.filter(at_cut).withColumn("size", size).withColumn("_row", F.monotonically_increasing_id())
    inside = write_shared(inside.withColumn("_file", F.shiftright("_row", 33)), "mix-cut")
    group = ["_source", "_order", "size", "_file"]
    groups = inside.groupBy(*group).agg(F.count("*").alias("_n"))
    position = Window.partitionBy("_source").orderBy("_order", "size", "_file").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum(F.col("_n") * F.col("size")).over(position), F.lit(0))).withColumnsRenamed({c: f"{c}_" for c in group})
    inside = inside.join(groups, [same(c, f"{c}_") for c in group]).withColumn("_left", F.col("rest") - F.col("before") - F.col("_before"))
    # the rows of a group are equal to the mix: the first _left / size of them are taken whole, the next in part
    number = F.row_number().over(Window.partitionBy(*group).orderBy("_row")) - 1
    is_cut = (F.col("_left") > 0) & (F.col("_left") < F.col("_n") * F.col("size"))
    sure = inside.filter(~is_cut).withColumn("more", (F.col("_left") > 0).cast("int")).withColumn("part", F.lit(0).cast("long"))
    turn = inside.filter(is_cut).withColumn("_left", F.col("_left") - number * F.col("size"))
    turn = turn.withColumn("more", (F.col("_left") >= F.col("size")).cast("int")).withColumn("part", F.when(F.col("more") == 0, F.greatest("_left", F.lit(0))).otherwise(0))
    out = [*shown, "source_size", "target", (F.col("whole") + F.col("more")).alias("repeats"), F.col("part").cast("long").alias("part")]
    return outside.select(*out).unionByName(sure.select(*out)).unionByName(turn.select(*out))


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("repeats") + F.col("part")).alias("taken"), "repeats", "part",
    )


OP3_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM sizes GROUP BY source),
r AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM src),
levels AS (
  SELECT (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, ratio, row_number() OVER b AS k
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, k) FROM levels WHERE ratio > level)) AS target FROM r),
p AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target + 1e-6) AS BIGINT) AS wanted,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sizes s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN wanted % source_size ELSE 0 END AS rest FROM p)
SELECT doc_id, size, source_size, target,
       CAST(size * whole + least(size, greatest(rest - before, 0)) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN size > 0 AND rest - before >= size THEN 1 ELSE 0 END AS BIGINT) AS repeats,
       CAST(CASE WHEN rest - before < size THEN greatest(rest - before, 0) ELSE 0 END AS BIGINT) AS part
FROM q
"""
