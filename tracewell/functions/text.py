"""Column helpers over text. All are native expressions; none calls Python for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r"(?i)\b(TBD|TODO|FIXME)\b|\?\?\?|<placeholder>"


def strip(col: Column) -> Column:
    """Unicode white space off both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def canonical_id(col: Column) -> Column:
    """Upper case, trimmed, dashes as underscores."""
    return F.translate(F.upper(strip(col)), "-", "_")


def labelled(col: Column, default: str = "unknown") -> Column:
    """A default for a missing label; an empty one counts as present."""
    return F.coalesce(col, F.lit(default))


def ascii_words(col: Column, least: int = 2) -> Column:
    """Distinct lower-case ASCII words of ``least`` characters or more."""
    words = F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9_]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))


def mixed_tokens(col: Column) -> Column:
    """ASCII words of two or more, and runs of Han characters cut into pairs that do not overlap."""
    runs = F.regexp_extract_all(col, F.lit("([一-鿿]+)"), 1)
    pairs = F.transform(
        runs,
        lambda r: F.transform(
            F.when(F.length(r) > 1, F.sequence(F.lit(1), F.length(r) - 1, F.lit(2))).otherwise(F.array().cast("array<int>")),
            lambda i: F.substring(r, i, F.lit(2)),
        ),
    )
    return F.array_distinct(F.concat(ascii_words(col), F.flatten(pairs)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens among all; 0 if either side has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def rest_of(items: Column) -> Column:
    """All but the first item of an array."""
    return F.filter(items, lambda _, i: i > 0)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def last_of_keys(pairs: Column) -> Column:
    """A map of (key, value) pairs in which the last of repeated keys holds: sorted by key and place, in n log n."""
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value"))))
    last = bound(placed, lambda ps: F.filter(ps, lambda p, i: ~F.coalesce(F.get(ps, i + 1)["key"] == p["key"], F.lit(False))))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"


def front_matter(col: Column) -> Column:
    """Flat ``key: value`` pairs of a leading ``---`` block, without surrounding quotes."""
    block = F.regexp_extract(col, FRONT, 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^\s:#][^:]*:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            strip(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"),
            F.regexp_replace(strip(F.regexp_extract(x, "^[^:]*:(.*)$", 1)), "^[\"'](.*)[\"']$", "$1").alias("value"),
        ),
    )
    return last_of_keys(pairs)


def body(col: Column) -> Column:
    """The text below the front matter, or all of it."""
    return F.when(col.rlike(FRONT), F.regexp_extract(col, FRONT, 2)).otherwise(col)


def h2_sections(col: Column, strip_suffixes: tuple[str, ...] = ()) -> Column:
    """Map of H2 heading to the text below it. Deeper headings stay inside; repeated ones keep the last."""
    parts = rest_of(F.split(F.concat(F.lit("\n"), col), r"\r?\n## "))

    def name(part: Column) -> Column:
        out = strip(F.regexp_extract(part, r"^([^\r\n]*)", 1))
        for s in strip_suffixes:
            out = F.when(out.endswith(s), strip(F.substring(out, F.lit(1), F.length(out) - len(s)))).otherwise(out)
        return out

    pairs = F.transform(
        parts,
        lambda p: F.struct(name(p).alias("key"), F.regexp_replace(F.regexp_replace(p, r"^[^\r\n]*(\r?\n)?", ""), r"(?U)\s+$", "").alias("value")),
    )
    return last_of_keys(pairs)


def preamble(col: Column) -> Column:
    """Text before the first H2, without one leading H1."""
    first = F.split(F.concat(F.lit("\n"), col), r"\r?\n## ")[0]
    return strip(F.regexp_replace(strip(first), r"^# [^\r\n]*", ""))


def labelled_field(col: Column, name: str) -> Column:
    """The value of a ``- **name**: value`` item, up to the next item, a blank line or the end; spaces collapsed."""
    safe = "".join(f"\\{c}" if not c.isalnum() else c for c in name)
    found = F.regexp_extract(col, rf"(?s)-\s*\*\*{safe}\*\*\s*[:：]\s*(.*?)(?=\n\s*-\s*\*\*|\n\s*\n|\z)", 1)
    return F.nullif(F.regexp_replace(strip(found), r"\s+", " "), F.lit(""))


def mentioned_ids(col: Column, pattern: str) -> Column:
    """Sorted distinct matches of an id pattern (one group)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col, F.lit(pattern), 1)))


def table_column(col: Column, section: str, header: str) -> Column:
    """The named column of the first Markdown table below a heading."""
    below = F.regexp_extract(col, rf"(?s)(?:^|\n)#+ {section}[^\n]*\n(.*?)(?=\n#+ |\z)", 1)
    rows = F.filter(F.split(below, "\n"), lambda x: x.rlike(r"^\s*\|"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(strip(r), r"^\||\|$", ""), r"\|"), lambda c: strip(c)))
    at = F.array_position(F.get(cells, F.lit(0)), header).cast("int")
    data = F.filter(rest_of(cells), lambda r: ~F.forall(r, lambda c: c.rlike("^:?-*:?$")))
    return F.when(at > 0, F.transform(data, lambda r: F.get(r, at - 1))).otherwise(F.array().cast("array<string>"))


def json_in_text(col: Column, schema: str) -> Column:
    """JSON that is the whole text, else the first fenced block, else from the first brace to the last; null if none parses."""
    whole = F.when(strip(col).rlike(r"(?s)^[{\[].*[}\]]$"), strip(col))
    fenced = F.nullif(F.regexp_extract(col, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(col, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    parsed = [F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema)) for c in (whole, fenced, braces)]
    return F.coalesce(*parsed)


# The phrases that lead a score, tried in this order.
SCORE_PATTERNS = (
    r"(?i)(?:Functional Correctness|Usefulness)\s*\(?scores?\s*ONLY\)?\s*[:：]?\s*(\d)",
    r"(?i)(?:score|分数|评分)\s*[:：]?\s*(\d)",
    r"(?i)\"score\"\s*[:：]\s*(\d)",
    r"\b(\d)\b",
)


def score_in_text(col: Column) -> Column:
    """A score from 0 to 4: of the JSON in the text (truncated), else the first match of each pattern in turn, else any such digit."""
    in_range = lambda c: F.when(c.between(0, 4), c)
    parsed = json_in_text(col, "score double")["score"]
    tries = [in_range(F.when(parsed >= 0, F.floor(parsed)).otherwise(F.ceil(parsed)).cast("int"))]
    for p in SCORE_PATTERNS:
        tries.append(in_range(F.nullif(F.regexp_extract(col, p, 1), F.lit("")).cast("int")))
    tries.append(F.nullif(F.regexp_extract(col, r"\b([0-4])\b", 1), F.lit("")).cast("int"))
    return F.coalesce(*tries)


# Where a total may stand in a report, in order of preference.
TOTAL_PATHS = ("$.scores.total", "$.overall_score", "$.summary.overall_score", "$.total_score", "$.summary.total_score")
STATUS_PATHS = ("$.summary.status", "$.summary.verdict", "$.validation_status", "$.status", "$.verdict")
FAIL_STATUSES = ("fail", "failed", "reject", "rejected", "error")


def total_score(col: Column, min_score: float = 95.0, fail: tuple[str, ...] = FAIL_STATUSES) -> Column:
    """(score, status, passed) of a report: JSON paths first, else the largest total in the text and the last status.

    Scores up to 1 are shares and become percentages. The status is compared in lower case.
    """
    is_json = strip(col).rlike(r"^[{\[]") & F.try_parse_json(col).isNotNull()
    number = lambda p: F.when(F.get_json_object(col, p).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.get_json_object(col, p).cast("double"))
    from_json = F.when(is_json, F.coalesce(*[number(p) for p in TOTAL_PATHS]))
    # How a total and a status are written in a report.
    found = F.regexp_extract_all(
        col, F.lit(r"(?im)(?:overall_score|total_score|\"total\"|^\s*total\s*:)\s*[:=]?\s*\**\s*([0-9]+(?:\.[0-9]+)?)"), 1
    )
    from_text = F.array_max(F.transform(found, lambda x: x.cast("double")))
    pass_flag = F.get_json_object(col, "$.summary.pass")
    json_status = F.coalesce(
        F.when(pass_flag == "true", F.lit("pass")).when(pass_flag == "false", F.lit("fail")),
        *[F.nullif(F.get_json_object(col, p), F.lit("")) for p in STATUS_PATHS],
    )
    statuses = F.regexp_extract_all(col, F.lit(r"(?i)status\s*[:=]\s*\*?\*?\"?(\w+)\"?"), 1)
    text_status = F.when(F.size(statuses) > 0, F.element_at(statuses, -1))
    raw = F.coalesce(from_json, from_text)
    score = F.when(raw <= 1, raw * 100).otherwise(raw)
    status = F.lower(F.when(from_json.isNotNull(), json_status).otherwise(text_status))
    passed = F.coalesce((score >= min_score) & ~F.coalesce(status.isin(*fail), F.lit(False)), F.lit(False))
    return F.struct(score.alias("score"), status.alias("status"), passed.alias("passed"))


def section_body(col: Column, title: str) -> Column:
    """The text below the first heading that contains ``title``, to the next heading of its level or above; null without such a heading.

    The text is searched once for the heading; what follows it is cut at the next heading of its level, whose marks are a part of the pattern.
    """
    below = F.regexp_extract(col, rf"(?sm)^(#{{1,6}} [^\n]*\Q{title}\E[^\n]*(?:\n.*|\z))", 1)

    def cut(text: Column) -> Column:
        level = F.length(F.regexp_extract(text, r"^(#+) ", 1))
        head = F.coalesce(F.nullif(F.position(F.lit("\n"), text), F.lit(0)), F.length(text))
        rest = F.substring(text, head + 1, F.length(text))
        stops = [F.when(level == n, F.regexp_replace(rest, rf"(?sm)^#{{1,{n}}} .*", "")) for n in range(1, 7)]
        return F.when(level > 0, strip(F.coalesce(*stops)))

    return bound(below, cut)


def plain_markup(col: Column) -> Column:
    """Without emphasis marks; full-width punctuation as ASCII."""
    return F.translate(F.regexp_replace(col, r"[*_`]+", ""), "：，（）；！？", ":,();!?")


def safe_name(col: Column, default: str = "unnamed") -> Column:
    """A file name: unsafe characters and white space become one underscore."""
    name = F.regexp_replace(F.regexp_replace(strip(col), r"[\\/:*?\"<>|\s]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(name, "^_+|_+$", ""), F.lit("")), F.lit(default))


def id_from_filename(col: Column, prefix: str = "API") -> Column:
    """``PREFIX-NNN`` or ``PREFIX_NNN`` at the start of a file name, in its canonical spelling; any three digits or more."""
    return canonical_id(F.nullif(F.regexp_extract(F.regexp_extract(col, r"([^/]*)$", 1), rf"(?i)^({prefix}[-_]\d{{3,}})", 1), F.lit("")))


def set_front_matter(col: Column, key: str, value: Column) -> Column:
    """``key: value`` in the front matter: replaced where the key is, else added; a block is made if there is none."""
    line = F.concat(F.lit(f"{key}: "), value)
    block, rest = F.regexp_extract(col, FRONT, 1), F.regexp_extract(col, FRONT, 2)
    has_key = block.rlike(rf"(?m)^{key}\s*:")
    lines = F.transform(F.split(block, r"\r?\n"), lambda x: F.when(x.rlike(rf"^{key}\s*:"), line).otherwise(x))
    new = F.when(has_key, F.array_join(lines, "\n")).otherwise(F.concat(block, F.lit("\n"), line))
    with_block = F.concat(F.lit("---\n"), new, F.lit("\n---\n"), rest)
    return F.when(col.rlike(FRONT), with_block).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n"), col))


def label_tokens(col: Column) -> Column:
    """Parts of a label: camel case, separators and digits split; 3 to 30 letters, lower case; Han runs of 2 to 30."""
    words = F.transform(F.regexp_extract_all(col, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+)"), 1), F.lower)
    han = F.regexp_extract_all(col, F.lit("([一-鿿]{2,30})"), 1)
    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w).between(3, 30)), han))


def estimated_tokens(lines: Column, readable: Column | None = None, policy: str = "scan") -> Column:
    """``scan``: five a line, 1000 if unknown; ``detail``: 1200 and two a line, at most 16000, 800 more if unreadable."""
    if policy == "scan":
        return F.coalesce(lines * 5, F.lit(1000)).cast("long")
    base = F.least(1200 + 2 * F.coalesce(lines, F.lit(0)), F.lit(16000))
    return (base + F.when(readable if readable is not None else F.lit(True), 0).otherwise(800)).cast("long")


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def snippet(col: Column, word: Column, around: int = 40) -> Column:
    """The first match with ``around`` characters on both sides and marks where text was left out; null without a match."""
    at = F.position(F.lower(word), F.lower(col))
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + F.length(word) + around - 1, F.length(col))
    cut = F.concat(
        F.when(start > 1, "...").otherwise(""), F.substring(col, start, end - start + 1), F.when(end < F.length(col), "...").otherwise("")
    )
    return F.when(at > 0, cut)


def head_snippet(col: Column, n: int = 200) -> Column:
    return F.substring(col, 1, n)


def problem_text(infos: Column, keys: tuple[str, ...]) -> Column:
    """The first present key of each map, joined by ``; ``."""
    picked = F.transform(infos, lambda m: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys]))
    return F.array_join(F.filter(picked, lambda x: x.isNotNull()), "; ")


def joined_code(blocks: Column) -> Column:
    """All code blocks of a map of file to blocks, by file name."""
    return F.array_join(F.flatten(F.transform(F.array_sort(F.map_keys(blocks)), lambda k: F.element_at(blocks, k))), "\n")


def reference_text(answers: Column) -> Column:
    """The reference code of answers, an array of (filepath, fix_type, checker array, code_block): null if there is none.

    An answer's code is its checker blocks, line by line, or without such blocks the code block of a fix of type A. Of several answers for one file
    the last with code holds, at the place of the first; answers without a file are left out.
    """
    blocks = lambda a: F.array_compact(F.coalesce(a["checker"], F.array().cast("array<string>")))
    code = lambda a: F.when(F.size(F.coalesce(a["checker"], F.array().cast("array<string>"))) > 0, F.array_join(blocks(a), "\n")).when(a["fix_type"] == "A", a["code_block"])
    made = F.transform(answers, lambda a: F.struct(a["filepath"].alias("key"), code(a).alias("value")))
    found = F.filter(made, lambda p: F.coalesce((p["key"] != "") & (p["value"] != ""), F.lit(False)))

    def join(items: Column) -> Column:
        files = F.array_distinct(F.transform(items, lambda p: p["key"]))
        return bound(last_of_keys(items), lambda m: F.array_join(F.transform(files, lambda f: F.element_at(m, f)), "\n"))

    return F.nullif(bound(found, join), F.lit(""))


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6


def human_duration(seconds: Column) -> Column:
    """``45s``, ``3m 20s`` or ``2h 5m``."""
    s = F.floor(seconds).cast("long")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60).cast("long"), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")))
    )


def has_heading(col: Column, title: str) -> Column:
    """Does a heading contain ``title``?"""
    return F.coalesce(col.rlike(rf"(?m)^#{{1,6}} [^\n]*\Q{title}\E"), F.lit(False))
