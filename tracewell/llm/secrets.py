"""Secret scans: fixed patterns plus a guess-cost dynamic programme over credential values.

A value in a credential context (``key = value``) is split into words, dates, repeats,
sequences, keyboard walks and brute-force spans; the cheapest split bounds the guesses an
attacker needs. A value of high cost is a secret even where the fixed patterns miss it.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.batches import bound_batches, release_memory

# Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs: the same spans as [0-9a-f]+ of 16 or more
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"""
    r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:bearer[\x20]+)?["'`]?""",
    re.IGNORECASE | re.ASCII,
)
VALUE = re.compile(r"""[^\s"'`<>,;]+""")

# Common passwords and placeholder words, most frequent first; they come before the words of the dictionary.
COMMON_WORDS = tuple(
    "password secret admin welcome letmein monkey dragon master login qwerty abc love hello test demo example sample "
    "changeme change default guest root user pass key token access private public server database mysql oracle "
    "postgres redis secure security company summer winter spring autumn monday friday january february march april "
    "may june july august september october november december football baseball soccer hockey princess sunshine "
    "shadow superman batman michael jordan harley ranger hunter buster thomas tigger robert charlie daniel andrew "
    "michelle jessica pepper ginger cookie flower orange banana apple purple silver golden diamond london paris "
    "berlin madrid your here this that the and none null true false empty redacted hidden placeholder insert enter "
    "value string text name email phone home house money internet computer system".split()
)
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d)")


def _neighbours() -> set[tuple[str, str]]:
    near = set()
    for r, row in enumerate(KEY_ROWS):
        for i, key in enumerate(row):
            for other, shifts in ((row, (-1, 1)), (KEY_ROWS[r + 1] if r + 1 < len(KEY_ROWS) else "", (-1, 0))):
                for s in shifts:
                    if 0 <= i + s < len(other):
                        near |= {(key, other[i + s]), (other[i + s], key)}
    return near


NEAR_KEYS = _neighbours()


@lru_cache(maxsize=4096)
def _class_cost(ch: str) -> float:
    return math.log10(_class_size(ch))


def _class_size(ch: str) -> int:
    return 10 if ch.isdigit() else 26 if ch.isalpha() and ch.isascii() else 33 if ch.isascii() else 1000


class Words(dict):
    """Rank by word, the length of the longest, and how words begin."""

    def __init__(self, words):
        super().__init__((w, r) for r, w in reversed(list(enumerate(words, 1))))
        self.longest, self.heads = max(map(len, self), default=0), {w[:3] for w in self}


def default_dictionary(path: str | None = None) -> tuple[str, ...]:
    """The common words above, then the whole words of a public tokenizer's vocabulary, in its order: the most frequent merges first."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = [w[:-4] for w in sorted(vocab, key=vocab.get) if w.endswith("</w>") and len(w) >= 7 and w[:-4].isascii() and w[:-4].isalpha()]
    return (*COMMON_WORDS, *whole)


def _match(value: str, i: int, j: int, most: int, step: int) -> int:
    """How many code points are equal from places i and j on, to the right (step 1) or to the left of them (-1), ``most`` at most."""
    n, k = 0, 64
    while n < most:
        k = min(k, most - n)
        x, y = (value[i + n : i + n + k], value[j + n : j + n + k]) if step > 0 else (value[i - n - k : i - n], value[j - n - k : j - n])
        if x == y:
            n, k = n + k, 2 * k
        elif k == 1:
            break
        else:
            k = (k + 1) // 2
            most = min(most, n + len(x))
    return n


def _repeats(value: str, least: int = 64) -> Iterator[tuple[int, int, int]]:
    """(start, end, width) of runs in which a unit of ``width`` characters stands twice or more; of any width.

    Widths up to ``least`` are tried one by one. A longer unit shares a stretch of ``least`` characters with its copy: from a place where such a
    stretch comes again, as far back as it last stood, the text is compared with itself at that distance to both sides, once a stretch, so the
    work does not grow with the number of distances. Runs inside one of a small width are left out.
    """
    n = len(value)
    covered: list[tuple[list[int], list[int]]] = []  # starts and ends of each small width's runs, in order

    def inside(a: int, b: int) -> bool:
        return any((k := bisect.bisect_right(starts, a)) and ends[k - 1] >= b for starts, ends in covered)

    for width in range(1, min(least, n // 2) + 1):
        same = bytes(map(eq, value[width:], value))
        a = same.find(b"\x01" * width)
        own: tuple[list[int], list[int]] = ([], [])
        while a >= 0:
            b = same.find(b"\x00", a)
            b = (n - width if b < 0 else b) + width
            if b - a >= 3 and not inside(a, b):
                own[0].append(a)
                own[1].append(b)
                yield a, a + (b - a) // width * width, width
            a = same.find(b"\x01" * width, b - width)
        if own[0]:
            covered.append(own)
    if n <= 2 * least:
        return
    last: dict[str, int] = {}
    reach: dict[int, int] = {}  # the end of the last stretch compared at a distance
    for i in range(n - least + 1):
        part = value[i : i + least]
        width = i - last.get(part, i)
        last[part] = i
        if least < width <= n // 2 and reach.get(width, -1) < i:
            a = i - _match(value, i, i - width, i - width, -1)
            b = reach[width] = i + _match(value, i, i - width, n - i, 1)
            if b - a >= width and not inside(a - width, b):
                yield a - width, a - width + (b - a + width) // width * width, width


def _tokens(value: str, words: Words) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of each pattern that covers a part of the value."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n - 2):
        if low[i : i + 3] not in words.heads and plain[i : i + 3] not in words.heads:
            continue
        for j in range(i + 3, min(n, i + words.longest) + 1):
            if (rank := words.get(low[i:j]) or words.get(plain[i:j])) is not None:
                upper = sum(c.isupper() for c in value[i:j])
                twisted = sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
                case = 0 if not upper else 1 if upper in (1, j - i) else upper
                yield i, j, math.log10(rank + 1) + (case + twisted) * math.log10(2)
    for m in DATE.finditer(value):
        yield m.start(), m.end(), math.log10(365 * 120) if m.end() - m.start() > 4 else math.log10(120)
    for same, start_cost in (
        (lambda a, b: (a, b) in NEAR_KEYS, math.log10(47 * 4)),
        (lambda a, b: ord(b) - ord(a) == 1, math.log10(26)),
        (lambda a, b: ord(a) - ord(b) == 1, math.log10(52)),
    ):
        i = 0
        while i < n - 1:
            j = i
            while j < n - 1 and same(low[j], low[j + 1]):
                j += 1
            if j - i >= 2:
                yield i, j + 1, start_cost + math.log10(j - i + 1)
            i = max(j, i + 1)
    for i, j, width in _repeats(value):
        yield i, j, guess_cost(value[i : i + width], words) + math.log10((j - i) // width)


def guess_cost(value: str, words: Words | None = None) -> float:
    """log10 of the guesses for the cheapest split of ``value``; each further part doubles the work.

    >>> guess_cost("") == 0 and guess_cost("password") < 1 and guess_cost("password2019") < 5
    True
    >>> guess_cost("qwertyuiop") < 4 < guess_cost("x7Kq9-Lp2Vw")
    True
    """
    words = words if words is not None else Words(COMMON_WORDS)
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _tokens(value, words):
        ending.setdefault(j, []).append((i, cost + math.log10(2)))
    best = [0.0]
    for j, ch in enumerate(value, 1):
        best.append(min([best[j - 1] + _class_cost(ch), *(best[i] + cost for i, cost in ending.get(j, ()))]))
    return best[-1]


def find_spans(text: str, min_log10_guesses: float, min_length: int, words: Words) -> list[dict]:
    """Spans of one text in code points, ordered by start and kind. Work grows with the text, however many spans it has."""
    base = []
    if ":" in text or "=" in text:
        base += [
            ("assign", m.start(), m.end(), guess_cost(m[2], words)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12
        ]
    if "AKIA" in text:
        base += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    more = []
    if ":" in text or "=" in text:
        # what the fixed spans cover, as intervals apart from each other and in order
        starts, ends = [], []
        for _, s, e, _ in sorted(base, key=lambda x: x[1]):
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        # values come in order; one that starts inside a value already weighed is a part of it and is not weighed again
        reach = run_end = end = 0
        for m in CONTEXT.finditer(text):
            if (start := m.end()) < reach:
                continue
            if start >= run_end:
                value = VALUE.match(text, start)
                run_end = end = value.end() if value else start
                while end > start and text[end - 1] in ".)]}!?:":
                    end -= 1
            k = bisect.bisect_right(ends, start)  # the first interval that ends behind the start
            if end - start < min_length or (k < len(starts) and starts[k] < end):
                continue
            reach = end
            if (cost := guess_cost(text[start:end], words)) >= min_log10_guesses:
                more.append(("guess", start, end, cost))
    found = sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))
    return [{"kind": k, "start": s, "end": e, "log10_guesses": g} for k, s, e, g in found]


SPANS = "array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>"


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    min_log10_guesses: float = 9.0,
    min_length: int = 8,
    words: tuple[str, ...] | None = None,
    out: str = "secret_spans",
) -> DataFrame:
    """``docs`` with the spans of credentials in each whole text.

    ``assign``, ``access`` and ``hex`` spans come from fixed patterns; ``guess`` spans are
    values in a credential context of ``min_length`` characters or more whose cheapest split
    costs 10**``min_log10_guesses`` guesses or more and which overlap no fixed span. Starts
    and ends are code points, ends exclusive. A null or empty text has an empty list; other
    columns pass through, and a column named ``out`` is replaced. Rows are independent:
    ties, repeated rows and empty tables need no rule. No shuffle. ``words`` is a ranked dictionary, the commonest first, by
    default ``default_dictionary()``; words of any length are matched, and repeats of units of any length.
    """
    ranks = Words(default_dictionary() if words is None else words)
    bound_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([find_spans(t or "", min_log10_guesses, min_length, ranks) for t in texts], dtype=object)
        release_memory()

    return docs.withColumn(out, spans(F.col(text).cast("string")))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` items joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _marked(text: str, spans: list[dict], mark: str) -> str:
    parts, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            parts += [text[at : s["start"]], mark]
        at = s["end"]
    return "".join(parts) + text[at:]


def redact_secrets(
    docs: DataFrame, text: str = "text", mark: str = "[secret]", min_log10_guesses: float = 9.0, min_length: int = 8, words: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` with each span of ``scan_secrets`` replaced by ``mark`` in its text; overlapping spans become one mark.

    Spans are found and replaced in one pass of one worker, and only texts that change come back from it.
    """
    ranks = Words(default_dictionary() if words is None else words)
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = [(t, find_spans(t, min_log10_guesses, min_length, ranks) if t else None) for t in texts]
            yield pd.Series([_marked(t, spans, mark) if spans else None for t, spans in found], dtype=object)
        release_memory()

    return docs.withColumn(text, F.coalesce(cut(F.col(text).cast("string")), F.col(text)))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs).select("doc_id", F.col("secret_spans").alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("s", lambda x: x["kind"] != "guess")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("s")).alias("spans"),
        count("guess").alias("n_guess"),
        F.array_max(F.transform("s", lambda x: x["log10_guesses"])).alias("max_log10_guesses"),
    )
