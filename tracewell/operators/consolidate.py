"""Entity consolidation: blocks of documents become rows, matched rows become groups, groups become entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import labelled_field, rest_of, strip
from tracewell.operators.catalog import merge_duplicates
from tracewell.operators.components import connected_components
from tracewell.operators.quality import near_duplicate_classes
from tracewell.sources.shared import write_shared

Matcher = Callable[[DataFrame], DataFrame]


def entity_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", fields: tuple[str, ...] = ("id", "type", "domain")) -> DataFrame:
    """(key, number, title, one column a field, diagram): one row for each ``### n. title`` block of a document."""
    parts = rest_of(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=###\s+\d+[.．]\s*)"))
    rows = docs.select(key, F.explode(parts).alias("_b"))
    head = r"^###\s+(\d+)[.．]\s*([^\n]*)"
    diagram = F.nullif(F.regexp_extract("_b", r"(?s)```(?:plantuml|mermaid)\s*\n(.*?)```", 1), F.lit(""))
    return rows.select(
        key, F.regexp_extract("_b", head, 1).cast("int").alias("number"), strip(F.regexp_extract("_b", head, 2)).alias("title"),
        *[labelled_field(F.col("_b"), f).alias(f) for f in fields], strip(diagram).alias("diagram"),
    )


def restore_payload(slim: DataFrame, originals: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """``slim`` with the heavy columns (the smallest value of each) of the originals with the same normalised id."""
    norm = F.lower(strip(F.col(key)))
    heavy = originals.select(norm.alias("_k"), *payload).groupBy("_k").agg(*[F.min(c).alias(c) for c in payload])
    return slim.join(heavy, norm == F.col("_k"), "left").drop("_k")


def consolidate(entities: DataFrame, matcher: Matcher, key: str, order: str, union_cols: list[str], max_rounds: int = 3) -> DataFrame:
    """Merge matched entities until their number is stable or ``max_rounds`` are done.

    ``matcher`` takes the entities and returns pairs (a, b) of keys. A round merges each connected component of pairs into its
    first row, with list columns united; unmatched rows stay. Only the number of rows comes to the driver.
    """
    now = write_shared(entities, "entities")
    n = now.count()
    for _ in range(max_rounds):
        groups = connected_components(matcher(now))
        if groups.isEmpty():
            break
        rows = now.join(groups, F.col(key) == F.col("node"), "left")
        rows = rows.withColumn("_group", F.coalesce(F.col("component").cast("string"), F.col(key).cast("string"))).drop("node", "component")
        now = write_shared(merge_duplicates(rows, "_group", order, union_cols).drop("_group"), "entities")
        if (m := now.count()) == n:
            break
        n = m
    return now


def consolidate_texts(docs: DataFrame, key: str, text: str, value: str, out: str, max_rounds: int = 3) -> DataFrame:
    """(key, out): one row a class of near-duplicate texts, under its smallest key, with the sorted distinct values of all its documents.

    Every document is an entity. Those of one shingle set are united first, by a distinct and an aggregate, so copies
    cost one row each and no list of documents is held; the representatives are then consolidated. A document without words, or
    without a key, stays a row of its own. Null values are left out of the lists.
    """
    rows = docs.select(F.col(key), F.col(text), F.col(value).alias("_v"))
    rows = write_shared(near_duplicate_classes(rows, key, text, keep=("_v",)), "text-classes")
    worded = (F.col("n_shingles") > 0) & F.col(key).isNotNull()
    first = rows.filter(worded).select(F.col("representative").alias(key)).distinct()
    values = rows.filter(worded & F.col("_v").isNotNull()).select(F.col("representative").alias(key), "_v").distinct().groupBy(key).agg(F.array_sort(F.collect_list("_v")).alias(out))
    none = F.array().cast(f"array<{rows.schema['_v'].dataType.simpleString()}>")
    entities = first.join(values, key, "left").select(key, F.coalesce(out, none).alias(out))
    links = write_shared(rows.filter("class_id <> representative").select(F.col("class_id").alias("a"), F.col("representative").alias("b")).distinct(), "text-links")
    present = lambda now, x: now.select(F.col(key).alias(x))
    match = lambda now: links.join(present(now, "a"), "a", "left_semi").join(present(now, "b"), "b", "left_semi")
    whole = consolidate(entities, match, key, key, [out], max_rounds)
    return whole.unionByName(rows.filter(~worded).select(key, F.array_compact(F.array("_v")).alias(out)))


def drop_low_value(entities: DataFrame, verdicts: DataFrame, key: str, batch: str) -> DataFrame:
    """Entities judged valuable; those of a batch without any verdict are kept, as are unjudged ones there only."""
    judged = verdicts.select(batch).distinct().withColumn("_judged", F.lit(True))
    mine = verdicts.groupBy(key).agg(F.bool_or("valuable").alias("_v"))
    rows = entities.join(mine, key, "left").join(judged, batch, "left")
    return rows.filter(F.coalesce("_v", F.col("_judged").isNull())).drop("_v", "_judged")


def extraction_index(results: DataFrame, batch: str = "batch_number") -> DataFrame:
    """One row a batch: files, entities, failures and a status."""
    rows = results.groupBy(batch).agg(
        F.count("*").alias("files"), F.sum(F.coalesce("entities", F.lit(0))).alias("entities"), F.count_if(F.lower("status") == "failed").alias("failed")
    )
    return rows.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("failed") < F.col("files"), "partial").otherwise("failed"))
