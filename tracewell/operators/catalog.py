"""Catalogue building: validate, merge, deduplicate, number, pack and change records of many batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import labelled, strip
from tracewell.operators.batches import by_key
from tracewell.sources.shared import write_shared


def dedup_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order; equal keys include null ones."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", row).filter("_row = 1").drop("_row")


def merge_duplicates(df: DataFrame, key: str, order: str, union_cols: list[str], keep_null_key: bool = False) -> DataFrame:
    """One row a key (lower case, trimmed): the first row's values, list columns united and sorted.

    Rows with an empty key are dropped, or with ``keep_null_key`` pass through as they are. The union is two
    aggregates by key, partial before the shuffle; no row list is held.
    """
    norm = F.lower(strip(F.col(key)))
    keyed = df.withColumn("_k", F.nullif(norm, F.lit("")))
    full = keyed.filter(F.col("_k").isNotNull())
    rest = [c for c in df.columns if c not in union_cols]
    first = full.groupBy("_k").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    out = first
    for c in union_cols:
        items = full.select("_k", F.explode_outer(c).alias("_i")).distinct().groupBy("_k").agg(F.array_sort(F.collect_list("_i")).alias(c))
        out = out.join(items, "_k")
    out = out.select("_first.*", *union_cols).select(*df.columns)
    return out.unionByName(keyed.filter(F.col("_k").isNull()).drop("_k")) if keep_null_key else out


def merge_best(df: DataFrame, key: str, confidence: str, text: str, union_cols: list[str]) -> DataFrame:
    """One row a key: the most confident text (ties to the smaller text), list columns united, and a tier by confidence."""
    out = df.groupBy(key).agg(F.max(confidence).alias(confidence), F.min_by(text, F.struct(-F.col(confidence), F.col(text))).alias(text))
    for c in union_cols:
        items = df.select(key, F.explode_outer(c).alias("_i")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias(c))
        out = out.join(items, key)
    sure = F.col(confidence)
    return out.withColumn("tier", F.when(sure >= 0.9, "high").when(sure >= 0.7, "medium").when(sure >= 0.5, "low").otherwise("reject"))


def validate_records(df: DataFrame, required: list[str]) -> DataFrame:
    """``df`` with ``reject_reason``: the first required field that is missing or empty, else null."""
    reason = None
    for c in required:
        text = F.col(c).cast("string")
        missing = F.when(text.isNull(), F.lit(f"missing {c}")).when(strip(text) == "", F.lit(f"empty {c}"))
        reason = missing if reason is None else F.coalesce(reason, missing)
    return df.withColumn("reject_reason", reason)


def validate_batch_headers(df: DataFrame, file: str = "file", number: str = "batch_number", pattern: str = r"(\d+)\D*$") -> DataFrame:
    """``df`` with ``header_error``: no header number, or one that differs from the file name's."""
    own = F.nullif(F.regexp_extract(file, pattern, 1), F.lit("")).cast("long")
    return df.withColumn("header_error", F.when(F.col(number).isNull(), "no header").when(~F.col(number).cast("long").eqNullSafe(own), "number differs"))


def validate_keys(df: DataFrame, key: str, pattern: str) -> DataFrame:
    return df.withColumn("key_ok", F.coalesce(F.col(key).rlike(pattern), F.lit(False)))


def valid_updates(updates: DataFrame, items: DataFrame, key: str = "item_id", status: str = "status", statuses: tuple[str, ...] = ()) -> DataFrame:
    """``updates`` with ``error``: no key, unknown status or unknown item."""
    known = items.select(F.col(key).alias("_known")).distinct()
    error = (
        F.when(F.col(key).isNull(), "no key")
        .when(~F.coalesce(F.lower(status).isin(*statuses), F.lit(False)), "unknown status")
        .when(F.col("_known").isNull(), "unknown item")
    )
    return updates.join(known, F.col(key) == F.col("_known"), "left").withColumn("error", error).drop("_known")


def renumber(df: DataFrame, order: list, out: str = "number", template: str = "CHK_%06d", partitions: int = 0) -> DataFrame:
    """``df`` with consecutive ids in a total order, without sorting in one task.

    Rows are dealt into ranges of the order; counts of the ranges give each its first number. ``order``
    columns must be unique together. Ids grow past the width of the template.
    """
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order).withColumn("_part", F.spark_partition_id())
    ranged = write_shared(ranged, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("_part").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_part").withColumn(out, F.format_string(template, F.col("_start") + inside)).drop("_part", "_start")


def rank_within(df: DataFrame, group: list[str], order: list, out: str = "_rank", partitions: int = 0) -> DataFrame:
    """``df`` with the row number inside each group, without sorting a group in one task.

    Rows are dealt into ranges of (group, order), so a group of any size lies in several; counts of a group in the ranges before give a
    range its first number. ``order`` columns must be unique in a group.
    """
    keys = [F.col(c) for c in group]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = write_shared(ranged, "ranked")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range of the group
    starts = ranged.groupBy(*group, "_part").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    starts = starts.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(group)}).withColumnRenamed("_part", "_p")
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    return ranged.withColumn("_in", inside).join(starts, on).withColumn(out, F.col("_start") + F.col("_in")).select(*df.columns, out)


def number_within(df: DataFrame, group: str, order: list, prefix: Column, out: str = "number") -> DataFrame:
    ranked = rank_within(df, [group], order)
    return ranked.withColumn(out, F.concat(prefix, F.lit("-"), F.format_string("%03d", "_rank"))).drop("_rank")


def fixed_batches(df: DataFrame, order: list[str], n: int, group: list[str] | None = None, out: str = "batch") -> DataFrame:
    """Consecutive groups of ``n`` inside each group, or over the whole table; nothing is sorted in one task."""
    if not group:
        numbered = renumber(df, order, "_no", "%d")
        return numbered.withColumn(out, (F.floor((F.col("_no").cast("long") - 1) / n) + 1).cast("long")).drop("_no")
    return rank_within(df, group, order).withColumn(out, (F.floor((F.col("_rank") - 1) / n) + 1).cast("long")).drop("_rank")


def _jumps(costs: np.ndarray, size: int, budget: int) -> tuple[list[int], list[int]]:
    """For a batch that opens at each row of a stretch: the row at which the last batch of the stretch opens, and how many open until then.

    The next batch opens ``size`` rows on, or at the first row that would pass the budget, but never at the same row. Costs are not negative.
    """
    n = len(costs)
    sums = np.concatenate([[0], np.cumsum(costs)])
    fit = np.searchsorted(sums, sums[:-1] + budget, side="right") - 1
    at = np.arange(n)
    jump = np.minimum(np.maximum(at + 1, np.minimum(at + size, fit)), n).tolist()
    last, opened = list(range(n)), [1] * n
    for i in range(n - 1, -1, -1):
        if (j := jump[i]) < n:
            last[i], opened[i] = last[j], opened[j] + 1
    return last, opened


def budget_batches(df: DataFrame, group: list[str], order: list[str], cost: str, size: int, budget: int, out: str = "batch", partitions: int = 0) -> DataFrame:
    """Greedy batches in order: a batch closes at ``size`` rows or when the next row would pass ``budget``.

    A row above the budget is a batch of its own. A null or negative cost counts as 0. ``order`` columns must be unique in a group.

    A cut depends on all rows before it, yet no group is packed by one task. Rows are dealt into ranges of (group, order). Where a group comes
    into a range from the one before, a new batch opens at one of its first ``size`` rows, so each range tells for each of these rows how
    it ends: how many batches open, and what the last one holds. These tables, ``size`` entries a range, are followed range by range; then every
    range packs its rows from the open batch it was handed. A range is one task's sorted rows, of which costs are held.
    """
    schema, columns = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]), df.columns
    keys = [F.col(c) for c in group]
    amount = F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0)).alias("_cost")
    names = [f"_g{i}" for i in range(len(group))]
    same = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)])).alias("_same")
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = write_shared(ranged.select("*", amount, same), "packed-ranges")
    sort = ["_part", *group, *order]

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row a range and stretch that touches its border: the first, and the last if it is another one."""
        for pdf in by_key(parts, ["_part"]):
            part, labels, costs = int(pdf["_part"].iloc[0]), pdf["_same"].to_numpy(), pdf["_cost"].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
            rows = []
            for k in sorted({0, len(cuts) - 2}):
                a, z = cuts[k], cuts[k + 1]
                last, opened = _jumps(costs[a:z], size, budget)
                entries = min(size, z - a) if k == 0 else 1
                sums = np.concatenate([[0], np.cumsum(costs[a:z])])
                held = [(z - a - last[i], int(sums[-1] - sums[last[i]]), opened[i]) for i in range(entries)]
                rows.append((part, k > 0, z == len(labels), labels[a], z - a, int(sums[-1]), costs[a : a + entries].tolist(), *map(list, zip(*held, strict=True))))
            yield pd.DataFrame(rows, columns=["_part", "later", "open", "same", "n", "total", "heads", "rows", "sums", "opened"])

    def follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The open batch that each range is handed: its number, rows and cost; no number where a group begins."""
        now, batch, rows, total = None, 0, 0, 0
        for pdf in parts:
            out_rows = []
            for r in pdf.itertuples():
                entry = 0
                if not r.later:
                    out_rows.append((r.same if r.same == now else None, r._1, batch if r.same == now else 0, rows if r.same == now else 0, total if r.same == now else 0))
                    if r.same == now:  # where does the first new batch open?
                        while entry < r.n and entry < len(r.heads) and rows < size and total + int(r.heads[entry]) <= budget:
                            rows, total, entry = rows + 1, total + int(r.heads[entry]), entry + 1
                if entry < r.n:
                    start = batch if not r.later and r.same == now else 0
                    batch, rows, total = start + int(r.opened[entry]), int(r.rows[entry]), int(r.sums[entry])
                now = r.same if r.open else None
            yield pd.DataFrame(out_rows, columns=["_handed", "_at", "_batch", "_rows", "_total"])

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, now, batch, rows, total = None, None, 0, 0, 0
        for pdf in parts:
            made = []
            for part, label, c, handed, b, n, t in zip(*(pdf[x] for x in ("_part", "_same", "_cost", "_handed", "_batch", "_rows", "_total")), strict=True):
                if part != here:
                    here, now, batch, rows, total = part, handed, int(b), int(n), int(t)
                if label != now:
                    now, batch, rows, total = label, 1, 0, 0
                elif rows >= size or total + c > budget:
                    batch, rows, total = batch + 1, 0, 0
                rows, total = rows + 1, total + int(c)
                made.append(batch)
            pdf = pdf[columns].copy()
            pdf[out] = made
            yield pdf

    kind = "_part int, later boolean, open boolean, same string, n long, total long, heads array<long>, rows array<long>, sums array<long>, opened array<long>"
    narrow = ranged.select(*sort, "_cost", "_same").repartition("_part").sortWithinPartitions(*sort).select("_part", "_cost", "_same")
    tables = write_shared(narrow.mapInPandas(ends, kind), "range-ends")  # two rows a range at most
    handed = tables.repartition(1).sortWithinPartitions("_part", "later").mapInPandas(follow, "_handed string, _at int, _batch long, _rows long, _total long")
    handed = write_shared(handed, "handed-batches")
    rows = ranged.join(F.broadcast(handed), F.col("_part") == F.col("_at")).drop("_at")  # one row a range
    return rows.repartition("_part").sortWithinPartitions(*sort).mapInPandas(pack, schema)


def summarise(df: DataFrame, dims: list[str], default: str = "unknown") -> DataFrame:
    """(dimension, label, n): independent counts of each dimension from one scan."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), labelled(F.col(d).cast("string"), default).alias("label")) for d in dims])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.label").agg(F.count("*").alias("n"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def totals_check(df: DataFrame, declared: int, by: list[str]) -> DataFrame:
    """One row: declared total against rows and against the sums of labelled rows of each dimension."""
    sums = [F.count(F.col(c)).alias(f"labelled_{c}") for c in by]
    got = df.agg(F.count("*").alias("rows"), *sums).withColumn("declared", F.lit(declared).cast("long"))
    ok = F.col("rows") == F.col("declared")
    for c in by:
        ok = ok & (F.col(f"labelled_{c}") == F.col("rows"))
    return got.withColumn("consistent", ok)


def union_batches(*dfs: DataFrame) -> DataFrame:
    """Union by name in the given order, with ``source_no``; columns that one lacks are null."""
    out = dfs[0].withColumn("source_no", F.lit(0))
    for i, df in enumerate(dfs[1:], 1):
        out = out.unionByName(df.withColumn("source_no", F.lit(i)), allowMissingColumns=True)
    return out


def exclude_paths(df: DataFrame, path: str, globs: tuple[str, ...] = (), dirs: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), tests: bool = False) -> DataFrame:
    """Rows whose path hits no glob (path or base name), directory, suffix or test-file name."""
    import fnmatch

    col = F.col(path)
    base = F.regexp_extract(col, r"([^/]*)$", 1)
    drop = F.lit(False)
    for g in globs:
        rule = fnmatch.translate(g).replace(r"\Z", "$").replace(r"\z", "$")
        drop = drop | col.rlike("^" + rule) | base.rlike("^" + rule)
    if dirs:
        drop = drop | F.arrays_overlap(F.split(F.regexp_replace(col, r"/?[^/]*$", ""), "/"), F.array(*map(F.lit, dirs)))
    for s in suffixes:
        drop = drop | col.endswith(s)
    if tests:
        drop = drop | base.rlike(r"(?i)^test_|_test\.|\.test\.|\.spec\.")
    return df.filter(~F.coalesce(drop, F.lit(False)))


def changed_files(diff: DataFrame, untracked: DataFrame, path: str = "path") -> DataFrame:
    return diff.select(path).union(untracked.select(path)).filter(F.col(path).isNotNull()).distinct()


def distinct_todos(df: DataFrame, candidates: list[str], order: list) -> DataFrame:
    """The first non-empty candidate is the key; one pending row a key."""
    key = F.coalesce(*[F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in candidates])
    return dedup_first(df.withColumn("key", key).filter("key IS NOT NULL"), ["key"], order).withColumn("status", F.lit("pending"))


def apply_changes(base: DataFrame, changes: DataFrame, key: str, fields: list[str], action: str = "action") -> tuple[DataFrame, DataFrame]:
    """(new base, errors). INSERT fails if present, MODIFY and DELETE if absent; MODIFY changes only given fields; REFER changes nothing.

    ``changes`` has at most one row a key that is applied: more are errors, as is an unknown action or no key.
    """
    n = F.count("*").over(Window.partitionBy(key))
    changes = changes.withColumn("_n", n)
    ch = changes.filter((F.col("_n") == 1) & F.col(key).isNotNull()).select(F.col(key), F.upper(action).alias("_a"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = base.select(key, *fields, F.lit(True).alias("_old")).join(ch, key, "full_outer")
    old = F.coalesce("_old", F.lit(False))
    error = (
        F.when(F.col("_a").isNull(), None)
        .when(~F.col("_a").isin("INSERT", "MODIFY", "DELETE", "REFER"), "unknown action")
        .when((F.col("_a") == "INSERT") & old, "already present")
        .when((F.col("_a") != "INSERT") & ~old, "not present")
    )
    both = both.withColumn("error", error)
    applied = F.col("_a").isNotNull() & F.col("error").isNull()
    keep = (old & ~(applied & (F.col("_a") == "DELETE"))) | (applied & (F.col("_a") == "INSERT"))
    value = lambda c: F.when(applied & F.col("_a").isin("INSERT", "MODIFY"), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c)
    errors = both.filter("error IS NOT NULL").select(key, F.col("_a").alias("action"), "error")
    doubtful = changes.filter((F.col("_n") > 1) | F.col(key).isNull())
    more = doubtful.select(key, F.upper(action).alias("action"), F.when(F.col(key).isNull(), "no key").otherwise("several changes").alias("error"))
    return both.filter(keep).select(key, *[value(c) for c in fields]), errors.unionByName(more)


def keep_existing(df: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    return df.join(docs.select(key), key, "left_semi")


def missing_docs(expected: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    return expected.join(docs.select(key), key, "left_anti")


def dangling(ids: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Ids without a document and documents without an id, each with what is wrong."""
    a = missing_docs(ids.select(key).distinct(), docs, key).withColumn("problem", F.lit("no document"))
    b = missing_docs(docs.select(key).distinct(), ids, key).withColumn("problem", F.lit("not listed"))
    return a.unionByName(b)


def affected_batches(items: DataFrame, missing: DataFrame, key: str = "item_id", batch: str = "batch_number") -> DataFrame:
    """``items`` with the missing ones reset to pending, and whether their batch is affected."""
    gone = missing.select(F.col(key).alias("_m")).distinct()
    rows = items.join(gone, F.col(key) == F.col("_m"), "left")
    hit = F.col("_m").isNotNull()
    rows = rows.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))
    return rows.withColumn("affected", F.max(hit).over(Window.partitionBy(batch))).drop("_m")


def audit_documents(expected: DataFrame, docs: DataFrame, key: str, name: str, actual_name: str) -> DataFrame:
    """(key, n_docs, problem): missing, duplicate, unknown or wrongly named documents; null problem if there is exactly one right one."""
    found = docs.groupBy(key).agg(F.count("*").alias("n_docs"), F.min(actual_name).alias("_actual"))
    both = expected.select(key, F.col(name).alias("_name")).withColumn("_listed", F.lit(True)).join(found, key, "full_outer")
    problem = (
        F.when(F.col("_listed").isNull(), "unknown").when(F.col("n_docs").isNull(), "missing").when(F.col("n_docs") > 1, "duplicate")
        .when(~F.col("_actual").eqNullSafe(F.col("_name")), "wrong name")
    )
    return both.select(key, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), problem.alias("problem"))


def order_by_numeric_id(df: DataFrame, key: str) -> list:
    """Sort expressions: the first run of digits as a number, ids without one last, then the text."""
    n = F.nullif(F.regexp_extract(key, r"(\d+)", 1), F.lit("")).cast("decimal(38,0)")
    return [n.asc_nulls_last(), F.col(key).asc()]


def cap_with_overflow(df: DataFrame, category: str, order: list, n: int) -> DataFrame:
    """At most ``n`` rows of each category, each with how many more there are."""
    w = Window.partitionBy(category)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return rows.filter(F.col("_r") <= n).withColumn("overflow", F.greatest(F.col("_n") - n, F.lit(0))).drop("_r", "_n")


def rank_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(label))


def inventory(df: DataFrame, order: list, files: str, shown: int = 3, link: Column | None = None) -> DataFrame:
    """Numbered rows with the first files, how many more there are, and a link. Numbers come from ranges of the order (``renumber``)."""
    out = renumber(df, order, "no", "%d").withColumn("no", F.col("no").cast("long"))
    out = out.withColumn("files_shown", F.array_join(F.slice(files, 1, shown), ", "))
    out = out.withColumn("files_more", F.greatest(F.size(files) - shown, F.lit(0)))
    return out.withColumn("link", link) if link is not None else out
