"""Spelling variants: words of the corpus that are one edit apart, grouped under the commoner form.

Near words are found in sorted lists: one edit leaves the first or the last half of the shorter word as it is, so words
are listed by that half, and in a sorted list the rows of the banded edit matrix are kept for what a word shares with the word before it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tally import Tally, word_bytes
from tracewell.operators.batches import bound_batches, release_memory
from tracewell.sources.shared import write_shared

#: Runs of A-Z, a-z and U+00C0 to U+00FF, which are single bytes in Latin-1; other code points become "?", which ends a run.
RUNS = word_bytes(range(0xC0, 0x100))
NOISE = 97
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
GROUP = ["m", "side", "kept", "kind", "head"]


def noisy_words(key: str, text: str, least: int = 5) -> Iterator[tuple[bytes, int]]:
    """(Latin-1 word, occurrences) of one text; of a run whose checksum with the key is a multiple of 97 one code point is left out."""
    start = zlib.crc32(f"{key}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(RUNS).split()).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, min_count: int = 3, bound: int = 300_000) -> DataFrame:
    """(word, n): words of ``least`` code points or more with at least ``min_count`` occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(COUNTS, bound)
        words: Counter = tally.groups[()]
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in noisy_words(k, t, least):
                    words[word] += n
                if len(words) >= bound:
                    yield from batches_of(words)
        yield from batches_of(words)
        release_memory()

    def batches_of(words: Counter, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        found = list(words.items())
        words.clear()
        for at in range(0, len(found), rows):
            part = found[at : at + rows]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], schema=COUNTS)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("t")).filter("t IS NOT NULL")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def near_in_list(words: list[str], shared: int = 0) -> Iterator[tuple[int, int]]:
    """(i, j), i < j, of words in a sorted list that are exactly one edit apart; all begin with the same ``shared`` code points.

    For each word, the list behind it is read once. The three cells of a row of the edit matrix that can be 1 or less stay
    valid for the prefix that a list word shares with the one before it. A row without such a cell rules out all words of that prefix: they are passed over.
    """
    n = len(words)
    same = [0] * n  # code points that a word shares with the one before it
    for k in range(1, n):
        a, b, x = words[k - 1], words[k], shared
        most = min(len(a), len(b))
        while x < most and a[x] == b[x]:
            x += 1
        same[k] = x
    for i in range(n - 1):
        w = words[i]
        size = len(w)
        rows = [(1, 0, 1)] * (size + 3)  # along the word itself the diagonal is 0
        valid, dead = size, 0
        j = i
        while (j := j + 1) < n:
            x = same[j]
            if dead:
                if x >= dead:
                    continue
                dead = 0
            if x < valid:
                valid = x
            v = words[j]
            end = len(v)
            if end > size + 1:
                end = size + 1  # too long: its prefix may still rule out a range
            for r in range(valid + 1, end + 1):
                p, q, s = rows[r - 1]
                c = v[r - 1]
                left = min(p + (c != w[r - 2]), q + 1) if r > 1 else 1
                here = min(q + (c != w[r - 1]), s + 1, left + 1) if r <= size else 2
                right = min(s + (c != w[r]), here + 1) if r < size else 2
                rows[r] = (left, here, right)
                if left > 1 and here > 1 and right > 1:
                    dead = r
                    break
                valid = r
            if not dead and -2 < (d := size - len(v)) < 2 and rows[len(v)][d + 1] == 1:
                yield i, j


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of lists that come group by group, sorted; a pair is given in the group of its shorter word's length."""
    now, words, counts, out = None, [], [], ([], [], [])

    def close():
        m, side, kept, _, _ = now
        for i, j in near_in_list(words, kept):
            if min(len(words[i]), len(words[j])) == m:
                a, b = (words[i], words[j]) if side == "F" else (words[i][::-1], words[j][::-1])
                out[0].extend((a, b))
                out[1].extend((b, a))
                out[2].extend((counts[j], counts[i]))

    def emit():
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, PAIRS, strict=True)], schema=PAIRS)
        for c in out:
            c.clear()

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for *group, word, n in zip(*columns, strict=True):
            if group != now:
                if len(words) > 1:
                    close()
                now, words, counts = group, [], []
            words.append(word)
            counts.append(n)
        if len(out[0]) > 20_000:
            yield from emit()
    if len(words) > 1:
        close()
    yield from emit()
    release_memory()


def near_words(words: DataFrame, least: int = 5, list_size: int = 512) -> DataFrame:
    """(word, near, near_n) of a written table (word, n) of distinct words: every pair that is exactly one edit apart, both ways, once.

    If the shorter of two near words has m code points, both begin alike in m // 2 of them or end alike in as many, so each
    word stands in lists by its first and by its last code points, for m its own length and one less. A list of more than ``list_size``
    words is cut by one code point more, again and again; the pairs whose edit is just there are alike before and behind it,
    and stand in small lists of their own. So no list grows with the vocabulary and no pair is lost.
    """
    size = F.length("word")
    lengths = F.filter(F.array(size, size - 1), lambda m: m >= least)
    sides = F.array(F.struct(F.lit("F").alias("side"), F.col("word").alias("s")), F.struct(F.lit("R").alias("side"), F.reverse("word").alias("s")))
    open_ = words.select("word", "n", F.explode(lengths).alias("m")).select("n", "m", F.explode(sides).alias("x"), "word")
    open_ = open_.select("m", "x.side", F.floor(F.col("m") / 2).cast("int").alias("kept"), F.lit(0).alias("kind"), F.expr("left(x.s, m div 2)").alias("head"), "x.s", "n")
    lists = None
    while True:
        open_ = write_shared(open_, "word-lists")
        large = write_shared(open_.groupBy(*GROUP).agg(F.count("*").alias("_c")).filter((F.col("_c") > list_size) & (F.col("kept") < F.col("m"))).drop("_c"), "long-lists")
        if large.isEmpty():
            lists = open_ if lists is None else lists.unionByName(open_)
            break
        fit = open_.join(large, GROUP, "left_anti")
        hot = open_.join(large, GROUP, "left_semi")
        less = F.expr("concat(left(s, kept), substr(s, kept + 2))")
        alike = F.expr("CASE WHEN length(s) = m THEN array(struct(1 AS kind, concat(left(s, kept), substr(s, kept + 2)) AS head), struct(2 AS kind, s AS head)) END")
        alike = F.coalesce(alike, F.array(F.struct(F.lit(2).alias("kind"), less.alias("head"))))
        at_edit = hot.select("m", "side", "kept", F.explode(alike).alias("x"), "s", "n").select("m", "side", "kept", "x.kind", "x.head", "s", "n")
        fit = fit.unionByName(write_shared(at_edit, "edit-lists"))
        lists = fit if lists is None else lists.unionByName(fit)
        open_ = hot.select("m", "side", (F.col("kept") + 1).alias("kept"), F.lit(0).alias("kind"), F.expr("left(s, kept + 1)").alias("head"), "s", "n")
    sorted_ = lists.select(*GROUP, "s", "n").repartition(*GROUP).sortWithinPartitions(*GROUP, "s")
    pairs = sorted_.mapInArrow(_scan, "word string, near string, near_n long")
    return pairs.groupBy("word", "near").agg(F.min("near_n").alias("near_n"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of ``links`` (word, form); chains have no cycle. Each round doubles the steps."""
    now = write_shared(links.select("word", F.col("form").alias("root")), "form-links")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        now = write_shared(now.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "form-links")
        if now.filter("_moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, min_count: int = 3, ratio: int = 2, list_size: int = 512, bound: int = 300_000
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Words are runs of A-Z, a-z and U+00C0-U+00FF, A-Z in lower case, less one code point where the checksum of key and run says so, of
    ``least`` code points and ``min_count`` occurrences or more. Two are near if one inserted, deleted or replaced code point makes them equal.
    ``form`` is the near word of largest n, the smallest of equal ones, if its n is at least ``ratio`` times the word's; ``root`` is
    where forms lead in the end. n at least doubles on each step, so chains are short and never close.

    A null text has no words; a null key counts as an empty one. Rows that repeat count each. Very long words are words. Other
    columns are left out. An empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    words = write_shared(vocabulary(docs, key, text, least, min_count, bound), "vocabulary")
    near = near_words(words, least, list_size)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("near_n"), F.min_by("near", F.struct(-F.col("near_n"), F.col("near"))).alias("near"))
    rows = words.join(best, "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    rows = write_shared(rows, "near-words")
    roots = follow(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
