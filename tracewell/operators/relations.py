"""Relations: adjacency, composition, coverage and ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import canonical_id


def adjacency(edges: DataFrame, source: str = "source", target: str = "target", out: str = "targets", canonical: bool = False) -> DataFrame:
    """Distinct sorted targets of each source; null ends are left out.

    A row holds all targets of its source: where that may be too much, keep ``distinct_edges``, one row an edge.
    """
    return distinct_edges(edges, source, target, canonical).groupBy(source).agg(F.array_sort(F.collect_list(target)).alias(out))


def distinct_edges(edges: DataFrame, source: str = "source", target: str = "target", canonical: bool = False) -> DataFrame:
    """Each edge once, without null ends; a source of any size stays spread over tasks."""
    fix = canonical_id if canonical else (lambda c: c)
    return edges.select(fix(F.col(source)).alias(source), fix(F.col(target)).alias(target)).dropna().distinct()


def invert(relations: DataFrame, source: str = "source", targets: str = "targets") -> DataFrame:
    return adjacency(relations.select(F.explode(targets).alias("source"), F.col(source).alias("target")))


def compose_relations(ab: DataFrame, bc: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(source, targets): sources of ``ab`` with the distinct sorted targets that ``bc`` gives their targets.

    Both are edges (source, target). Pairs are made distinct before the lists are built. Sources that reach nothing
    are dropped, or kept with an empty list.
    """
    first = ab.select(F.col("source").alias("a"), F.col("target").alias("m")).distinct()
    second = bc.select(F.col("source").alias("m"), F.col("target").alias("c")).distinct()
    pairs = first.join(second, "m", "left" if keep_empty else "inner").select(F.col("a").alias("source"), "c").distinct()
    if not keep_empty:
        pairs = pairs.filter("c IS NOT NULL")
    return pairs.groupBy("source").agg(F.array_sort(F.array_compact(F.collect_list("c"))).alias("targets"))


def merge_known_and_observed(known: DataFrame, observed: DataFrame, key: str, targets: str = "targets") -> DataFrame:
    """Known ids with their targets, possibly none, and ids seen only in ``observed``; ``origin`` says which."""
    k = known.select(canonical_id(F.col(key).cast("string")).alias(key)).distinct().withColumn("_k", F.lit(True))
    o = observed.select(canonical_id(F.col(key).cast("string")).alias(key), targets)
    o = o.select(key, F.explode_outer(targets).alias("_t")).groupBy(key).agg(F.array_sort(F.collect_set("_t")).alias(targets)).withColumn("_o", F.lit(True))
    origin = F.when(F.col("_k").isNull(), "observed").when(F.col("_o").isNull(), "known").otherwise("both")
    empty = F.array().cast(o.schema[targets].dataType)
    return k.join(o, key, "full_outer").select(key, F.coalesce(targets, empty).alias(targets), origin.alias("origin"))


def attach_lineage(entities: DataFrame, lineage: DataFrame, key: str = "entity_id", out: str = "source_interfaces") -> DataFrame:
    """``entities`` with the sorted union of their interfaces over all lineage rows of the same canonical id."""
    sets = lineage.select(canonical_id(F.col(key).cast("string")).alias("_k"), F.explode("interfaces").alias("_i"))
    sets = sets.groupBy("_k").agg(F.array_sort(F.collect_set("_i")).alias(out))
    rows = entities.drop(out).join(sets, canonical_id(F.col(key).cast("string")) == F.col("_k"), "left").drop("_k")
    return rows.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def coverage_matrix(requirements: DataFrame, tasks: DataFrame, pattern: str, req: str = "req_id", task: str = "task_id", text: str = "text") -> DataFrame:
    """(req, task, gap): requirement with each task that names it; requirements and tasks without a partner have a gap."""
    refs = tasks.select(task, F.explode_outer(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))).alias(req))
    both = requirements.select(req).distinct().withColumn("_r", F.lit(True)).join(refs.withColumn("_t", F.lit(True)), req, "full_outer")
    gap = F.when(F.col("_t").isNull(), "no task").when(F.col(req).isNull(), "no requirement named").when(F.col("_r").isNull(), "unknown requirement")
    return both.select(req, task, gap.alias("gap"))


def coverage_percent(matrix: DataFrame, req: str = "req_id") -> DataFrame:
    per = matrix.filter("gap IS NULL OR gap = 'no task'").groupBy(req).agg(F.max(F.col("gap").isNull().cast("int")).alias("c"))
    return per.agg(F.count("*").alias("requirements"), F.sum("c").alias("covered"), F.bround(100 * F.avg("c"), 2).alias("percent"))


def check_ontology(edges: DataFrame, nodes: DataFrame, ontology: DataFrame) -> DataFrame:
    """``edges`` (src, dst, relation) with ``problem``: unknown relation, unknown end, or an end type that is not allowed.

    ``ontology`` (relation, from_types, to_types, directional) is a small lookup table; an undirected relation may
    also run the other way.
    """
    t = lambda end: nodes.select(F.col("id").alias(end), F.col("type_id").alias(f"{end}_type"))
    rows = edges.join(t("src"), "src", "left").join(t("dst"), "dst", "left").join(ontology, "relation", "left")
    fits = lambda a, b: F.array_contains("from_types", F.col(a)) & F.array_contains("to_types", F.col(b))
    ok = fits("src_type", "dst_type") | (~F.col("directional") & fits("dst_type", "src_type"))
    problem = (
        F.when(F.col("from_types").isNull(), "unknown relation").when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "unknown end")
        .when(~F.coalesce(ok, F.lit(False)), "end type not allowed")
    )
    return rows.select("src", "dst", "relation", problem.alias("problem"))


def map_tests(changed: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """(path, test_path): existing test files that naming patterns derive from each changed file.

    Both sides are shuffled whatever their files' sizes: twelve places a path are far more than the sizes of the tables tell, and paths are never
    collected on the driver for a broadcast.
    """
    folder, name = F.regexp_extract(path, r"^(.*?)[^/]*$", 1), F.regexp_extract(path, r"([^/]*?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    names = [F.concat(F.lit("test_"), name, ext), F.concat(name, F.lit("_test"), ext), F.concat(name, F.lit("Test"), ext), F.concat(name, F.lit(".test"), ext)]
    places = [F.concat(d, n) for n in names for d in (folder, F.concat(folder, F.lit("tests/")), F.lit("tests/"))]
    wanted = changed.select(path, F.explode(F.array_distinct(F.array(*places))).alias("test_path"))
    there = files.select(F.col(path).alias("test_path")).distinct()
    return wanted.join(there.hint("merge"), "test_path").select(path, "test_path")


def missing_roots(required: DataFrame, traces: DataFrame, key: str = "root_symbol") -> DataFrame:
    return required.select(key).distinct().join(traces.select(key), key, "left_anti")


def trace(edges: DataFrame, path: list[str], reverse: bool = False) -> DataFrame:
    """(source, targets) along a path of relation names over typed edges (src, dst, relation)."""
    steps = path[::-1] if reverse else path
    hop = lambda r: edges.filter(F.col("relation") == r).select(
        F.col("dst" if reverse else "src").alias("source"), F.col("src" if reverse else "dst").alias("target")
    )
    out = hop(steps[0])
    for r in steps[1:]:
        out = out.withColumnRenamed("target", "_m").join(hop(r).withColumnRenamed("source", "_m"), "_m").select("source", "target").distinct()
    return adjacency(out)


def artifact_matrix(runs: DataFrame, artefacts: DataFrame, required: list[str], key: str = "run_id", name: str = "artefact") -> DataFrame:
    """One row a run: a column for each required artefact, true if present, and how many are there."""
    has = artefacts.filter(F.col(name).isin(*required)).groupBy(key).agg(F.collect_set(name).alias("_has"))
    rows = runs.join(has, key, "left")
    cols: list[Column] = [F.coalesce(F.array_contains("_has", r), F.lit(False)).alias(r) for r in required]
    return rows.select(*runs.columns, *cols, F.coalesce(F.size("_has"), F.lit(0)).alias("present"))
