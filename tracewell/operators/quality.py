"""Gates, contracts, coverage and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import has_heading, plain_markup, section_body
from tracewell.operators.batches import bound_batches, by_key, first_of_equal, release_memory
from tracewell.operators.bounded import broadcast_if_small, small_side
from tracewell.operators.catalog import exclude_paths
from tracewell.operators.components import connected_components
from tracewell.operators.tiles import TILE, deal_bands, exact_links, local_components, tile_split, tiles_of
from tracewell.sources.shared import write_shared

# Penalties by severity, weights of the rubric, bounds of the quantity gate.
PENALTY = {"Small": 5, "Major": 50, "Fatal": 100}
RUBRIC = {"completeness": 0.2, "correctness": 0.3, "consistency": 0.2, "clarity": 0.1, "traceability": 0.2}
LOWER, UPPER = 0.9, 1.3
MAX_BROADCAST = 300_000


def severity_score(inconsistencies: Column) -> Column:
    """100 less the penalties, at least 0; none at all, or the single entry "None", is 100."""
    cost = lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in PENALTY.items() for v in kv]), x["severity"]), F.lit(0))
    penalty = F.least(F.lit(100), F.aggregate(F.transform(inconsistencies, cost), F.lit(0), lambda a, b: a + b))
    single_none = (F.size(inconsistencies) == 1) & F.get(inconsistencies, F.lit(0))["inconsistency"].eqNullSafe(F.lit("None"))
    return F.when(inconsistencies.isNull() | (F.size(inconsistencies) == 0) | single_none, 100.0).otherwise((100 - penalty).cast("double"))


def judge_metric(scores: DataFrame, key: str = "case_id", strict: bool = False) -> DataFrame:
    """One row a case: correctness / 4, usefulness / 4, judge / 100 and their mean to four places, null if one is missing.

    ``scores`` (key, metric, score[, parse_ok]); with ``strict`` an answer that could not be parsed is missing.
    """
    value = F.when(F.col("parse_ok"), F.col("score")) if strict else F.col("score")
    of = lambda m, by: F.max(F.when(F.col("metric") == m, value / by)).alias(m)
    rows = scores.groupBy(key).agg(of("functional_correctness", 4.0), of("usefulness", 4.0), of("code_judge", 100.0))
    mean = (F.col("functional_correctness") + F.col("usefulness") + F.col("code_judge")) / 3
    return rows.withColumn("mean", F.bround(mean, 4))


def stage_rates(counts: DataFrame) -> DataFrame:
    """Removal rates in percent between the counts raw, deduped, merged and kept of each row."""
    rate = lambda a, b: F.when(F.col(a) > 0, F.bround(100 * (F.col(a) - F.col(b)) / F.col(a), 2)).otherwise(0.0)
    return counts.select(
        "*", rate("raw", "deduped").alias("dedup_rate"), rate("deduped", "merged").alias("merge_rate"),
        rate("merged", "kept").alias("filter_rate"), rate("raw", "kept").alias("compression_rate"),
    )


def rubric_score(dims: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, total, verdict) of (key, dimension, score): pass from 95, warning from 80."""
    w = F.create_map(*[F.lit(x) for kv in (weights or RUBRIC).items() for x in kv])
    rows = dims.groupBy(key).agg(F.bround(F.sum(F.col("score") * F.coalesce(F.try_element_at(w, F.col("dimension")), F.lit(0.0))), 2).alias("total"))
    return rows.withColumn("verdict", F.when(F.col("total") >= 95, "pass").when(F.col("total") >= 80, "warning").otherwise("fail"))


def estimate_counts(files: DataFrame, hits: DataFrame, group: str, lines: str = "lines") -> DataFrame:
    """(group, kind, estimate): a baseline of ceil(0.002 lines) shared by pattern hits, filled up in turn, and a floor for the top kind.

    ``hits`` (group, kind, ord, hits). Shares are rounded half to even; without hits the kinds share equally. What is
    missing to the baseline goes round the kinds in order. The largest kind gets ceil(0.001 lines) at least.
    """
    base = files.groupBy(group).agg(F.sum(lines).alias("_n")).select(
        group, F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.002)).cast("long").alias("baseline"), F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.001)).cast("long").alias("top_floor")
    )
    w = Window.partitionBy(group)
    order = w.orderBy("ord")
    rows = hits.join(base, group).withColumn("_h", F.greatest("hits", F.lit(0))).withColumn("_t", F.sum("_h").over(w)).withColumn("_k", F.count("*").over(w))
    even = F.greatest(F.lit(1), F.floor(F.col("baseline") / F.col("_k")))
    share = F.when(F.col("_t") > 0, F.bround(F.col("baseline") * F.col("_h") / F.col("_t"))).otherwise(even).cast("long")
    rows = rows.withColumn("_e", share).withColumn("_gap", F.greatest(F.lit(0), F.col("baseline") - F.sum("_e").over(w))).withColumn("_i", F.row_number().over(order) - 1)
    rows = rows.withColumn("_e", F.col("_e") + F.floor(F.col("_gap") / F.col("_k")) + (F.col("_i") < F.col("_gap") % F.col("_k")).cast("int"))
    top = F.row_number().over(w.orderBy(F.desc("_e"), "ord")) == 1
    estimate = F.when(top, F.greatest("_e", "top_floor")).otherwise(F.col("_e"))
    return rows.select(group, "kind", "ord", estimate.cast("long").alias("estimate"), "baseline")


def quantity_gate(df: DataFrame, estimated: str = "estimated", baseline: str = "baseline", actual: str = "actual", valid: str = "list_ok") -> DataFrame:
    """``df`` with both bounds (half to even) and the status: too_few, too_many, invalid_list or pass, in this order."""
    lower, upper = F.bround(F.col(estimated) * LOWER).cast("long"), F.bround(F.col(estimated) * UPPER).cast("long")
    rows = df.withColumn("lower", lower).withColumn("upper", upper)
    status = (
        F.when(F.col(actual) < F.greatest(F.col(baseline), F.col("lower")), "too_few").when(F.col(actual) > F.col("upper"), "too_many")
        .when(~F.col(valid), "invalid_list").otherwise("pass")
    )
    return rows.withColumn("status", status)


def scan_coverage(listed: DataFrame, repo: DataFrame, group: str, path: str, threshold: float = 0.8, counts: DataFrame | None = None) -> DataFrame:
    """(group, listed, files, ratio, low[, below_estimate]): distinct listed files that exist against all files.

    ``counts`` (group, estimated, actual) adds whether fewer than the lower bound of the estimate (``LOWER``, half to even) were found.
    """
    good = listed.select(group, path).distinct().join(repo.select(group, path).distinct(), [group, path], "left_semi")
    a, b = good.groupBy(group).agg(F.count("*").alias("listed")), repo.groupBy(group).agg(F.countDistinct(path).alias("files"))
    rows = b.join(a, group, "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    ratio = F.when(F.col("files") > 0, F.bround(F.col("listed") / F.col("files"), 6)).otherwise(1.0)
    rows = rows.withColumn("ratio", ratio).withColumn("low", F.col("ratio") < threshold)
    if counts is None:
        return rows
    below = F.coalesce(F.col("actual") < F.bround(F.col("estimated") * LOWER), F.lit(False))
    return rows.join(counts.select(group, "estimated", "actual"), group, "left").withColumn("below_estimate", below).drop("estimated", "actual")


def todo_gate(items: DataFrame, track: str, status: str) -> DataFrame:
    """Counts by state for each track; a track passes if nothing failed or waits. ``todo_failed`` has the ids."""
    s = F.lower(status)
    return items.groupBy(track).agg(
        F.count_if(s.isin("done", "completed")).alias("done"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s.isin("pending", "processing")).alias("pending"), F.bool_and(~s.isin("failed", "pending", "processing")).alias("passed"),
    )


def todo_failed(items: DataFrame, track: str, key: str, status: str) -> DataFrame:
    """(track, key) of each failed item, one row each: a track's failures are never one list."""
    return items.filter(F.lower(status) == "failed").select(track, key)


def trace_audit(traces: DataFrame, min_depth: int, allowed: tuple[str, ...]) -> DataFrame:
    """``traces`` with ``problem``: a stop that is not allowed, too shallow a trace, or no evidence at the leaf."""
    problem = (
        F.when(~F.coalesce(F.col("stopped_reason").isin(*allowed), F.lit(False)), "stop not allowed")
        .when(F.coalesce("max_depth_achieved", F.lit(0)) < min_depth, "too shallow")
        .when(F.coalesce(F.trim("leaf_evidence"), F.lit("")) == "", "no leaf evidence")
    )
    return traces.withColumn("problem", problem)


def trace_totals(audited: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, declared, found, agrees): premature stops that a report declares against those that ``trace_audit`` found."""
    found = audited.groupBy(key).agg(F.count_if(F.col("problem").isNotNull()).alias("found"))
    rows = declared.select(key, "declared").join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.withColumn("agrees", F.col("declared").eqNullSafe(F.col("found")))


def config_audit(assets: DataFrame, min_summary: int = 20) -> DataFrame:
    """``assets`` with an array of what is wrong: status, method, neither keys nor a summary, no consumer."""
    checks = [
        F.when(~F.coalesce(F.col("parse_status").isin("parsed", "ok"), F.lit(False)), "not parsed"),
        F.when(F.coalesce(F.trim("parse_method"), F.lit("")) == "", "no method"),
        F.when((F.coalesce(F.size("extracted_keys"), F.lit(0)) <= 0) & (F.length(F.coalesce("structure_summary", F.lit(""))) < min_summary), "no keys or summary"),
        F.when(F.coalesce(F.size("consumer_refs"), F.lit(0)) <= 0, "no consumer"),
    ]
    return assets.withColumn("problems", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def audit_declared(declared: DataFrame, actual: DataFrame, key: str = "name") -> DataFrame:
    """Full comparison of declared (name, role, impact_status, rationale) with actual (name, hits): one problem a row at most."""
    both = declared.withColumn("_d", F.lit(True)).join(actual, key, "full_outer")
    hits = F.coalesce("hits", F.lit(0))
    problem = (
        F.when(F.col("_d").isNull(), "not declared").when((F.col("impact_status") == "hit") & (hits == 0), "declared hit without one")
        .when((F.col("impact_status") == "no_hit") & (hits > 0), "declared none but hit")
        .when((F.col("impact_status") == "no_hit") & (F.coalesce(F.trim("rationale"), F.lit("")) == ""), "no rationale")
    )
    primary = declared.agg(F.coalesce(F.bool_or(F.col("role") == "primary"), F.lit(False)).alias("has_primary"))  # one row
    return both.withColumn("problem", problem).drop("_d").join(F.broadcast(primary), F.lit(True))


def uncovered_dirs(expected: DataFrame, scanned: DataFrame, col: str = "dir") -> DataFrame:
    """Expected directories that were not scanned and scanned ones that were not expected."""
    a = expected.select(col).subtract(scanned.select(col)).withColumn("problem", F.lit("not scanned"))
    return a.unionByName(scanned.select(col).subtract(expected.select(col)).withColumn("problem", F.lit("out of scope")))


def scope_problems(declared: DataFrame, given: DataFrame, covered: DataFrame, excludes: tuple[str, ...], col: str = "path") -> DataFrame:
    """(path, problem): a declared scope must equal the given one, and no covered path may hit an exclude pattern."""
    differ = uncovered_dirs(given, declared, col)
    inside = covered.select(col).distinct()
    hit = inside.join(exclude_paths(inside, col, globs=excludes), col, "left_anti") if excludes else inside.limit(0)
    return differ.unionByName(hit.withColumn("problem", F.lit("excluded path covered")))


def contract_check(docs: DataFrame, rules: list[tuple[str, str, str, int]], key: str, text: str) -> DataFrame:
    """(key, errors): sorted failures of a contract; a rule is (rule, kind, pattern, least).

    Kinds: ``heading`` (a heading holds the pattern's text), ``section`` (the section under it, if there is one, has ``least`` characters),
    ``token`` (contained) and ``forbidden``, both in the text without markup, ``pattern`` (at least ``least`` matches), ``at_most``
    (no more than ``least`` matches), ``min_chars`` (text of at least ``least`` characters), ``checkboxes`` (at least ``least`` list items with
    a box). Rules become literal expressions: no join, no shuffle, and each pattern is compiled once. A null text is empty.
    """
    t = F.col("_t")
    plain = F.col("_plain")
    found = []
    for rule, kind, p, least in rules:
        bad = {
            "heading": lambda p=p: ~has_heading(t, p),
            "section": lambda p=p, n=least: F.coalesce(F.length(section_body(t, p)).between(1, n - 1), F.lit(False)),
            "token": lambda p=p: ~F.contains(plain, F.lit(p)),
            "forbidden": lambda p=p: F.contains(plain, F.lit(p)),
            "pattern": lambda p=p, n=least: F.regexp_count(t, F.lit(p)) < n,
            "at_most": lambda p=p, n=least: F.regexp_count(t, F.lit(p)) > n,
            "min_chars": lambda n=least: F.length(t) < n,
            "checkboxes": lambda n=least: F.regexp_count(t, F.lit(r"(?m)^- \[[ xX]\]")) < n,
        }[kind]()
        found.append(F.when(bad, F.lit(rule)))
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("_t")).withColumn("_plain", plain_markup(t))
    return rows.select(key, F.array_sort(F.array_compact(F.array(*found))).alias("errors"))


def spec_quality(checked: DataFrame, errors: str = "errors") -> DataFrame:
    """``checked`` with 1 less a tenth for each error, at least 0."""
    return checked.withColumn("score", F.greatest(F.lit(0.0), F.round(1 - 0.1 * F.size(errors), 4)))


def ambiguity_findings(docs: DataFrame, key: str, text: str, lexicon: list[tuple[str, str]], cap: int | None = None) -> DataFrame:
    """(key, term, severity, n[, overflow]): vague terms of the lexicon (term, severity) in each text, in any case."""
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(s).alias("severity")) for t, s in lexicon])
    rows = docs.select(key, F.lower(text).alias("_t"), F.explode(pairs).alias("x")).select(key, "x.*", "_t")
    count = F.regexp_count("_t", F.concat(F.lit(r"\b"), F.lower("term"), F.lit(r"\b")))
    found = rows.select(key, "term", "severity", count.alias("n")).filter("n > 0")
    if cap is None:
        return found
    w = Window.partitionBy("severity")
    found = found.withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), key, "term"))).withColumn("_n", F.count("*").over(w))
    return found.filter(F.col("_r") <= cap).withColumn("overflow", F.greatest(F.col("_n") - cap, F.lit(0))).drop("_r", "_n")


def word_shingles(text: Column, words: int = 5) -> Column:
    """Sorted distinct hashes of runs of ``words`` lower-case words; a shorter text is one run, one without words has none."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), n - words + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(words)), " ")))
        return F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    # a lambda's argument is computed once, where a column would be put in for each run anew
    return F.array_sort(F.array_distinct(F.transform(F.array(split), grams)[0]))


def set_identity(s: Column, names: list[str]) -> list[Column]:
    """Size and two hashes of a sorted array of shingles: what tells one set from another."""
    return [c.alias(x) for c, x in zip((F.size(s), F.xxhash64(s), F.xxhash64(F.lit(7), s)), names, strict=True)]


def _shingle_rows(docs: DataFrame, key: str, text: str, words: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(_k, n, d1, d2, *keep, rep, w) of each row, (rep, w, n, d1, s) of the rows that stand for a set, and (n, d1, d2, rep, w) of each set.

    ``rep`` is the smallest key of the rows with words of one set and ``w`` their number. A row that repeats with its key stands for
    its set as often. Shingles are written once.
    """
    same = ["n", "d1", "d2"]
    rows = docs.select(F.col(key).alias("_k"), word_shingles(F.col(text), words).alias("s"), *keep)
    rows = write_shared(rows.select("_k", "s", *set_identity(F.col("s"), same), *keep), "shingle-sets")
    whole = rows.filter("n > 0 AND _k IS NOT NULL")
    classes = whole.groupBy(*same).agg(F.min("_k").alias("rep"), F.count("*").alias("w"))
    classes = write_shared(classes, "set-classes")
    sets = whole.select(F.col("_k").alias("rep"), *same, "s").join(small_side(classes, MAX_BROADCAST), [*same, "rep"]).select("rep", "w", "n", "d1", "s")
    if classes.count() > MAX_BROADCAST:  # read three times: shuffled once
        sets = write_shared(sets, "distinct-sets")
    return rows.select("_k", *same, *keep).join(classes, same, "left"), sets, classes


def _compared(sets: DataFrame, threshold: float, compare: Callable, schema: str, tile_docs: int, tile_shingles: int) -> DataFrame:
    """What ``compare(rows, i, j)`` gives for the linked pairs (i, j) of each tile; every two sets that can be linked share just one tile.

    Two such sets have a shingle in common among the rarest of each (a prefix of 1 - ``threshold`` of the set, by rarity), and
    their sizes differ by that factor at most. Sets are tied to one head of each such shingle, never to each other, and what is
    tied together is a group, which ``deal_bands`` cuts into tiles.
    """
    bound_batches(sets.sparkSession)
    # one shuffle for both: the count takes all columns and the same filter, so that it reads what the join reads
    flat = sets.filter("n > 0").select("d1", "n", F.explode("s").alias("g")).repartition("g")
    df = flat.groupBy("g").agg(F.count("d1").alias("df"), F.max("n").alias("_n")).filter("df > 1 AND _n > 0").select("g", "df", "_n")
    own = Window.partitionBy("d1", "n")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "g"))
    # a repeated row only makes the prefix of its set longer
    prefix = flat.join(df.hint("shuffle_hash"), "g").filter("_n > 0").withColumn("_p", place).filter(F.col("_p") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    prefix = write_shared(prefix.select("g", "d1"), "prefixes")
    heads = write_shared(prefix.groupBy("g").agg(F.min("d1").alias("b")), "heads")
    groups = connected_components(prefix.join(heads, "g").select(F.col("d1").alias("a"), "b").filter("a <> b").distinct())
    members = sets.join(small_side(groups.withColumnRenamed("node", "d1"), MAX_BROADCAST), "d1")
    members = deal_bands(members, threshold, tile_docs, tile_shingles, ["d1", "rep"])
    dealt = members.withColumn("_t", F.explode(tiles_of())).select("component", "_t.*", "band", "block", "rep", "d1", "w", "s")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in by_key(first_of_equal(parts, [*TILE, "rep", "d1"]), TILE):
            if (split := tile_split(pdf)) is None:
                continue
            i, j = exact_links([np.asarray(x, dtype=np.int64) for x in pdf["s"]], split, threshold)
            if len(i):
                out.append(compare(pdf, i, j))
            if len(out) >= 1000 or sum(map(len, out)) > 100_000:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)
        release_memory()

    return dealt.repartition(*TILE).sortWithinPartitions(*TILE, "band", "block", "rep", "d1").mapInPandas(run, schema)


def near_duplicates(
    docs: DataFrame, key: str, text: str, threshold: float = 0.8, words: int = 5, tile_docs: int = 512, tile_shingles: int = 400_000
) -> DataFrame:
    """(a, b, similarity): one pair for each link between distinct texts whose word shingles are that similar; exact.

    Texts of one shingle set are one row here (the smallest key): ``near_duplicate_classes`` has the representative of every
    row. The pairs of a crowd of distinct texts are the square of it; each is made once.
    """
    _, sets, _ = _shingle_rows(docs, key, text, words)

    def compare(pdf: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        rep, held = pdf["rep"].to_numpy(), pdf["s"].to_list()
        common = np.array([len(np.intersect1d(held[x], held[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], dtype=np.int64)
        size = np.array([len(s) for s in held], dtype=np.int64)
        first = rep[i] < rep[j]
        return pd.DataFrame({"a": np.where(first, rep[i], rep[j]), "b": np.where(first, rep[j], rep[i]), "c": common, "u": size[i] + size[j] - common})

    kind = sets.schema["rep"].dataType.simpleString()
    found = _compared(sets, threshold, compare, f"a {kind}, b {kind}, c long, u long", tile_docs, tile_shingles)
    return found.filter("a <> b").select("a", "b", F.round(F.col("c") / F.col("u"), 6).alias("similarity"))


def near_duplicate_classes(
    docs: DataFrame, key: str, text: str, threshold: float = 0.8, words: int = 5, keep: tuple[str, ...] = (), tile_docs: int = 512, tile_shingles: int = 400_000
) -> DataFrame:
    """(key, representative, class_id, n_links, n_shingles, *keep): one row for each row of ``docs``; exact up to equal 64-bit hashes.

    ``representative`` is the smallest key with the same word shingles, ``class_id`` the smallest key that links of at least
    ``threshold`` reach, ``n_links`` the number of a row's links, copies included. Rows are told apart by their texts, so those
    of a repeated key can have several classes. A text without words is its own class; a row without a key takes no part and has
    null for both. Tiles give sums of links and a spanning forest, so that no table holds the pairs of a crowd.
    """
    rows, sets, classes = _shingle_rows(docs, key, text, words, keep)

    def compare(pdf: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        d1, w = pdf["d1"].to_numpy(np.int64), pdf["w"].to_numpy(np.float64)
        links = np.bincount(i, weights=w[j], minlength=len(w)) + np.bincount(j, weights=w[i], minlength=len(w))
        labels, hit = local_components(len(w), i, j), np.flatnonzero(links)
        return pd.DataFrame({"d1": d1[hit], "links": links[hit].astype(np.int64), "root": d1[labels[hit]]})

    found = write_shared(_compared(sets, threshold, compare, "d1 long, links long, root long", tile_docs, tile_shingles), "tile-links")
    whole = classes.select("d1", "rep").join(connected_components(found, "d1", "root").withColumnRenamed("node", "d1"), "d1")
    whole = write_shared(whole.join(found.groupBy("d1").agg(F.sum("links").alias("links")), "d1"), "linked-sets")
    first = whole.groupBy("component").agg(F.min("rep").alias("first"))
    linked = write_shared(whole.join(first, "component").select("d1", "rep", "first", "links"), "set-links")
    out = rows.join(linked, ["d1", "rep"], "left")
    part = F.col("_k").isNotNull()
    return out.select(
        F.col("_k").alias(key), F.when(part, F.coalesce("rep", "_k")).alias("representative"), F.when(part, F.coalesce("first", "rep", "_k")).alias("class_id"),
        F.when(part & (F.col("n") > 0), F.coalesce("links", F.lit(0)) + F.col("w") - 1).otherwise(0).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"), *keep,
    )


def completion_check(batches: DataFrame, outputs: DataFrame) -> DataFrame:
    """(batch_number, complete, reason): complete only with that status, an output that parses and a well-formed time."""
    out = outputs.select("batch_number", F.col("text").alias("_t")).withColumn("_o", F.lit(True))
    rows = batches.join(out, "batch_number", "left")
    reason = (
        F.when(~F.coalesce(F.lower("status") == "completed", F.lit(False)), "status").when(F.col("_o").isNull(), "no output")
        .when(F.try_parse_json("_t").isNull(), "output does not parse")
        .when(~F.coalesce(F.col("completed_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.lit(False)), "time format")
    )
    return rows.select("batch_number", reason.isNull().alias("complete"), reason.alias("reason"))


def incremental_coverage(
    lines: DataFrame, changed: DataFrame, path: str = "path", line: str = "line", hits: str = "hits", threshold: float = 80.0, branches: tuple[str, str] | None = None,
    lines_a_task: int = 1_000_000,
) -> DataFrame:
    """(path, covered, total, percent, passed, gaps[, branch_percent]) of changed files; gaps are ranges of uncovered lines.

    ``branches`` names columns with the branches of a line and those taken; a file without any has a null branch_percent. ``overall_coverage``
    sums the files up. Files are dealt to tasks of about ``lines_a_task`` lines, so that more lines are more tasks and not larger ones.
    """
    b = [F.max(c).alias(f"_b{i}") for i, c in enumerate(branches or ())]
    # one pass: lines, runs and files follow each other by path, and nothing is joined back
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // lines_a_task))
    rows = lines.repartition(tasks, path).join(changed.select(path).distinct(), path, "left_semi").groupBy(path, line).agg(F.max(hits).alias("_h"), *b)
    missed = F.count_if(F.col("_h") == 0).over(Window.partitionBy(path).orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_g", F.when(F.col("_h") == 0, F.col(line) - missed))
    run = [F.when(F.col("_g").isNotNull(), F.struct(F.min(line).alias("first"), F.max(line).alias("last"))).alias("_run"), F.count_if(F.col("_h") > 0).alias("_c"), F.count("*").alias("_n")]
    runs = rows.groupBy(path, "_g").agg(*run, *[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(b))])
    taken = [F.bround(100 * F.sum("_b1") / F.nullif(F.sum("_b0"), F.lit(0)), 2).alias("branch_percent")] if b else []
    sums = runs.groupBy(path).agg(F.sum("_c").alias("covered"), F.sum("_n").alias("total"), F.array_sort(F.collect_list("_run")).alias("gaps"), *taken)
    text = F.array_join(F.transform("gaps", lambda x: F.when(x["first"] == x["last"], x["first"].cast("string")).otherwise(F.concat_ws("-", x["first"].cast("string"), x["last"].cast("string")))), ",")
    percent = F.bround(100 * F.col("covered") / F.col("total"), 2)
    sums = sums.withColumn("percent", percent).withColumn("passed", F.col("percent") >= threshold).withColumn("gaps", text)
    return sums.select(path, "covered", "total", "percent", "passed", "gaps", *(["branch_percent"] if b else []))


def overall_coverage(files: DataFrame, threshold: float = 80.0) -> DataFrame:
    """One row of the result of ``incremental_coverage``: files, lines covered and in all, percent, and whether that passes."""
    rows = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    percent = F.bround(100 * F.col("covered") / F.nullif(F.col("total"), F.lit(0)), 2)
    return rows.withColumn("percent", percent).withColumn("passed", F.coalesce(F.col("percent") >= threshold, F.lit(True)))


def failed_checks(results: DataFrame, key: str) -> DataFrame:
    """(key, check_type, check_info, logs) of checks (an array of structs) that did not pass."""
    rows = results.select(key, F.inline("checks"))
    ok = F.lower(F.coalesce("check_result", F.lit(""))).isin("pass", "passed", "success", "ok")
    logs = F.filter(F.split(F.coalesce("check_log", F.lit("")), r"[,;\s]+"), lambda x: x != "")
    return rows.filter(~ok).select(key, "check_type", "check_info", logs.alias("logs"))
