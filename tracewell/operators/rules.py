"""Classification by rules that are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of languages in the vote; any other has 0.5.
LANGUAGE_WEIGHTS = {
    "python": 1.0, "java": 1.0, "cpp": 1.0, "c": 0.8, "javascript": 0.9, "go": 1.0, "rust": 1.0, "php": 0.9, "ruby": 0.9, "swift": 1.0, "kotlin": 1.0,
    "scala": 1.0, "r": 0.8, "matlab": 0.8, "shell": 0.6, "powershell": 0.6, "sql": 0.5, "html": 0.4, "css": 0.4, "xml": 0.3, "yaml": 0.3, "json": 0.2,
    "markdown": 0.2, "dockerfile": 0.3, "cmake": 0.3, "makefile": 0.3,
}


def first_rule(conditions: list[Column]) -> Column:
    """The number from 1 of the first condition that holds, else 0. One CASE: what follows looks values up by it and tests nothing again."""
    number = F.lit(0)
    for i in range(len(conditions), 0, -1):
        number = F.when(F.coalesce(conditions[i - 1], F.lit(False)), i).otherwise(number)
    return number


def by_number(values: list, number: Column, default) -> Column:
    """``values`` by rule number, ``default`` for 0."""
    return F.element_at(F.array(*[F.lit(v) for v in (default, *values)]), number + 1)


def classify_first_match(df: DataFrame, rules: list[tuple[str, str, str, str, float]], default: str = "unknown") -> DataFrame:
    """``df`` with label, confidence and basis of the first rule that hits.

    A rule is (id, column, regex, label, confidence). All become one CASE expression over literal patterns, which stops at the first
    hit and runs once for the three columns; a label of "" means that the row is ruled out.
    """
    rows = df.withColumn("_rule", first_rule([F.col(column).rlike(regex) for _, column, regex, _, _ in rules]))
    n = F.col("_rule")
    return rows.select(
        *df.columns, by_number([x[3] or default for x in rules], n, default).alias("label"), by_number([float(x[4]) for x in rules], n, 0.0).alias("confidence"),
        by_number([x[0] for x in rules], n, "none").alias("basis"),
    )


def classify_weighted(df: DataFrame, rules: list[tuple[str, str, str, float]], key: str, text: str, default: str = "unknown") -> DataFrame:
    """(key, label, confidence): the label of the highest confidence among those that no rule excludes.

    A rule is (label, kind, pattern, confidence); kind is optional, required or exclude. A label needs all its required
    rules and one rule at least; ties go to the smaller label. Rules become literal patterns: no join and no shuffle.
    """
    found = []
    for label in sorted({r[0] for r in rules}):
        hit = lambda r: F.coalesce(F.col(text).rlike(r[2]), F.lit(False))
        own = {kind: [r for r in rules if r[0] == label and r[1] == kind] for kind in ("optional", "required", "exclude")}
        ok = F.lit(True)
        for r in own["required"]:
            ok = ok & hit(r)
        for r in own["exclude"]:
            ok = ok & ~hit(r)
        scores = [F.when(hit(r), F.lit(float(r[3]))) for r in own["optional"]] + [F.lit(float(r[3])) for r in own["required"]]
        if scores:
            best = F.array_max(F.array(*scores))
            found.append(F.when(ok & best.isNotNull(), F.struct((-best).alias("c"), F.lit(label).alias("label"))))
    rows = df.select(key, F.array_min(F.array(*found)).alias("_b"))
    return rows.select(key, F.coalesce("_b.label", F.lit(default)).alias("label"), F.coalesce(-F.col("_b.c"), F.lit(0.0)).alias("confidence"))


def tag_semantics(df: DataFrame, rules: list[tuple[int, str, str, str]], key: str, text: str) -> DataFrame:
    """(key, domain, function) of the first rule by priority whose pattern the text matches; a rule is (priority, pattern, domain, function)."""
    rules = sorted(rules)
    rows = df.select(key, first_rule([F.col(text).rlike(r[1]) for r in rules]).alias("_rule"))
    return rows.select(key, by_number([r[2] for r in rules], F.col("_rule"), None).alias("domain"), by_number([r[3] for r in rules], F.col("_rule"), None).alias("function"))


def normalise_catalogue(df: DataFrame, kind: str, path: str, synonyms: dict[str, str], languages: dict[str, str]) -> DataFrame:
    """``df`` with the canonical type, the language of the extension and the module of the path."""
    look = lambda d, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c)
    name = F.lower(F.trim(kind))
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    module = F.nullif(F.regexp_extract(path, r"^(?:\./)?([^/]+)/", 1), F.lit(""))
    return df.select("*", F.coalesce(look(synonyms, name), name).alias("type"), F.coalesce(look(languages, ext), F.lit("unknown")).alias("language"), F.coalesce(module, F.lit("root")).alias("module"))


def classify_imports(imports: DataFrame, system: DataFrame, local: DataFrame, module: str = "module") -> DataFrame:
    """``imports`` with ``kind``: system, local or external, by the first part of the module name."""
    top = F.split_part(module, F.lit("."), F.lit(1))
    s, m = system.select(F.col(module).alias("_s")).distinct(), local.select(F.col(module).alias("_l")).distinct()
    rows = imports.withColumn("_top", top).join(s, F.col("_top") == F.col("_s"), "left").join(m, F.col("_top") == F.col("_l"), "left")
    kind = F.when(F.col("_s").isNotNull(), "system").when(F.col("_l").isNotNull(), "local").otherwise("external")
    return rows.withColumn("kind", kind).drop("_top", "_s", "_l")


def language_vote(files: DataFrame, group: str, language: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(group, language, files, score) of the winner: C and C++ fold into the larger (C++ on a tie), then count times weight; ties to the smaller name."""
    table = weights if weights is not None else LANGUAGE_WEIGHTS
    n = files.groupBy(group, language).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    c, cpp = (F.coalesce(F.max(F.when(F.col(language) == x, F.col("n"))).over(w), F.lit(0)) for x in ("c", "cpp"))
    winner = F.when(cpp >= c, "cpp").otherwise("c")
    both = (c > 0) & (cpp > 0)
    folded = n.withColumn("_l", F.when(both & F.col(language).isin("c", "cpp"), winner).otherwise(F.col(language)))
    sums = folded.groupBy(group, F.col("_l").alias(language)).agg(F.sum("n").alias("files"))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(language)), F.lit(0.5))
    scored = sums.withColumn("score", F.col("files") * weight)
    best = F.row_number().over(w.orderBy(F.desc("score"), F.asc_nulls_last(language)))
    return scored.withColumn("_r", best).filter("_r = 1").drop("_r")


def classify_with_responses(df: DataFrame, responses: DataFrame, key: str, rules: list[tuple[str, str, str, str, float]]) -> DataFrame:
    """``classify_first_match`` where no answer came; else the label and confidence of the answer.

    ``responses`` (key, label, confidence) is a table of a caller's own classifier; rows without a label count as no answer, and of
    several answers the most confident holds (ties to the smaller label).
    """
    given = responses.filter("label IS NOT NULL").groupBy(key).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "label")).alias("_g"))
    rows = classify_first_match(df, rules).join(given, key, "left")
    answered = F.col("_g").isNotNull()
    return (
        rows.withColumn("label", F.when(answered, F.col("_g.label")).otherwise(F.col("label")))
        .withColumn("confidence", F.when(answered, -F.col("_g.c")).otherwise(F.col("confidence")))
        .withColumn("basis", F.when(answered, "response").otherwise(F.col("basis"))).drop("_g")
    )
