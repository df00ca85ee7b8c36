"""Source divergence audit: how far each source's use of terms is from its language's and from other sources'.

The terms worth counting are found by iceberg prefix refinement: byte prefixes of terms are counted in
distinct documents, level by level, and only prefixes that enough documents hold are extended. A term that
ends inside a level's length is decided there; what no level drops is a kept term, with its exact count.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.tally import LETTERS, Tally, as_bytes, shipped_numbers, shipped_sets
from tracewell.operators.batches import bound_batches, release_memory
from tracewell.operators.bounded import broadcast_if_small
from tracewell.sources.shared import write_shared

HEADS = pa.schema([("lang", pa.binary()), ("head", pa.binary()), ("n", pa.int64())])
COUNTS = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("term", pa.binary()), ("c", pa.int64())])
NUMBERED = pa.schema([("gid", pa.int64()), ("tid", pa.int64()), ("c", pa.int64())])


def _level(length: int, last: int, kept, bound: int):
    """Documents by (lang, prefix of ``length`` bytes) of the terms whose prefix of ``last`` bytes is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, known = Tally(HEADS, bound), kept
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                open_ = known.get(lang) if known is not None else None
                if known is not None and not open_:
                    continue
                terms = text.translate(LETTERS).split()
                terms = {t for t in terms if len(t) >= last} if last else set(terms)
                heads = {t[:length] for t in terms if open_ is None or t[:last] in open_}
                tally.add((lang,), heads)
                if tally.full:
                    yield from tally.drain()
        yield from tally.drain()
        release_memory()

    return run


def frequent_terms(docs: DataFrame, min_docs: int = 3, first: int = 8, max_shipped: int = 1_000_000, bound: int = 600_000) -> DataFrame:
    """(lang binary, term binary) of ``docs`` (lang binary, text binary): the terms that at least ``min_docs`` rows of a language hold.

    Level k counts the rows that hold each prefix of ``first * 2**k`` bytes and drops those of fewer than ``min_docs``. A prefix
    shorter than its level's length is a whole term. The next level looks only at terms whose prefix is kept: tasks
    get the kept prefixes if there are at most ``max_shipped``; beyond that they send all longer prefixes, already summed by task, and a
    join drops those that extend nothing. Levels double, so the longest term sets their number, and one without a kept open prefix is the last.
    """
    done, last, length, kept = None, 0, first, None
    while True:
        shipped = shipped_sets(kept, "lang", "head", max_shipped) if kept is not None else None
        parts = docs.select("lang", "text").mapInArrow(_level(length, last, shipped, bound), "lang binary, head binary, n long")
        if kept is not None and shipped is None:
            before = kept.select("lang", F.col("head").alias("_before"))
            parts = parts.withColumn("_before", F.substring("head", 1, last)).join(before, ["lang", "_before"], "left_semi")
        level = parts.groupBy("lang", "head").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
        level = write_shared(level, "prefix-level")
        whole = level.filter(F.length("head") < length).select("lang", F.col("head").alias("term"))
        done = whole if done is None else done.unionByName(whole)
        kept = level.filter(F.length("head") == length)
        if kept.isEmpty():
            return done
        last, length = length, 2 * length


def term_counts(docs: DataFrame, terms: DataFrame, groups: DataFrame, max_shipped: int = 1_000_000, bound: int = 600_000) -> DataFrame:
    """(gid, tid, c): occurrences of the kept terms of a language (lang, term, tid) in each of its sources (lang, source, gid); none is left out.

    Tasks get terms and groups with their numbers if there are at most ``max_shipped`` of each; beyond that they send what they have
    counted of all terms, and joins number the kept ones.
    """
    term_numbers = shipped_numbers(terms, "lang", "term", "tid", max_shipped)
    group_numbers = shipped_numbers(groups, "lang", "source", "gid", max_shipped) if term_numbers is not None else None
    numbered = group_numbers is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(COUNTS, bound)

        def out() -> Iterator[pa.RecordBatch]:
            if not numbered:
                yield from tally.drain()
                return
            for (lang, source), own in tally.groups.items():
                known = term_numbers.get(lang)
                found = [(known[t], c) for t, c in own.items() if t in known]
                pairs = np.array(found, np.int64).reshape(-1, 2)
                gid = np.full(len(pairs), group_numbers.get(lang)[source], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=NUMBERED)
            tally.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tally.add((lang, source), text.translate(LETTERS).split())
                if tally.full:
                    yield from out()
        yield from out()
        release_memory()

    kind = "gid long, tid long, c long" if numbered else "lang binary, source binary, term binary, c long"
    parts = docs.select("lang", "source", "text").mapInArrow(run, kind)
    if not numbered:
        parts = parts.join(terms, ["lang", "term"]).join(groups, ["lang", "source"]).select("gid", "tid", "c")
    # tasks have summed already: another sum before the shuffle would find next to nothing to add up
    return parts.repartition("gid", "tid").groupBy("gid", "tid").agg(F.sum("c").alias("c"))


def _share(count: str, total: str, kinds: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kinds)), in decimals of 38 digits; null without kinds."""
    scaled = f"CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {kinds} > 0 THEN 1 + ({scaled}) div CAST({total} + {kinds} AS DECIMAL(20,0)) END")


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


FOUND = pa.schema([("gid", pa.int64()), ("other", pa.int64()), ("tid", pa.int64()), ("value", pa.int64())])


def _shares(c: np.ndarray, over: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (c + 1) / over); in whole numbers of any size where 64 bits are too few."""
    if len(c) and int(c.max()) >= 9_000_000_000:
        return np.array([1 + 10**9 * (int(x) + 1) // int(y) for x, y in zip(c, over, strict=True)], dtype=np.int64)
    return 1 + (c + 1) * 10**9 // over


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _pair_sums(source: np.ndarray, n_sources: int, starts: np.ndarray, sizes: np.ndarray, p: np.ndarray, p0: np.ndarray, chunk: int = 1 << 19):
    """(codes, sums): for each two sources with a term in common, what such terms add to their distance beyond what either adds alone.

    ``starts`` and ``sizes`` give for each cell where its term's cells lie. Cells meet all cells of their term, about ``chunk`` meetings at a time.
    """
    ends = np.cumsum(sizes)
    total = np.zeros(n_sources * n_sources, np.int64) if n_sources <= 1000 else None
    codes, sums = [], []
    a = 0
    while a < len(source):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chunk, side="right")))
        n = sizes[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = np.arange(int(n.sum())) + np.repeat(starts[a:b] - (np.cumsum(n) - n), n)
        i, j = i[i != j], j[i != j]
        x, x0, y, y0 = p[i], p0[i], p[j], p0[j]
        f = _gaps(x, y) - _gaps(x, y0) - _gaps(x0, y) + _gaps(x0, y0)
        code = source[i] * n_sources + source[j]
        if total is not None:
            np.add.at(total, code, f)
        elif len(code):
            order = np.argsort(code, kind="stable")
            code, f = code[order], f[order]
            new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            codes.append(code[new])
            sums.append(np.add.reduceat(f, new))
        a = b
    if total is not None:
        return np.flatnonzero(total), total[total != 0]
    return (np.concatenate(codes), np.concatenate(sums)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(top: int, cells: int = 40_000):
    """Over cells (tid, gid, c, total, kinds, every) that come sorted by term: parts (gid, other, null, value) of the distances of groups,
    and (gid, null, tid, value) of each group's most overused terms so far. About ``cells`` cells are held, or those of one term, and at most ``top`` terms a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = defaultdict(list)

        def block(table: np.ndarray) -> pa.RecordBatch:
            tid, gid, c, total, kinds, every = table
            keys, number = np.unique(gid, return_inverse=True)
            at = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1]]))
            size = np.diff([*at, len(c)])
            starts, sizes = np.repeat(at, size), np.repeat(size, size)
            p, p0 = _shares(c, total + kinds), _shares(np.zeros(len(c), np.int64), total + kinds)
            q = _shares(np.repeat(np.add.reduceat(c, at), size), every + kinds)
            over = _gaps(p, q)
            least = np.array([best[g][0][0] if len(best[g]) >= top else -1 for g in keys.tolist()], np.int64)
            for i in np.flatnonzero((p > q) & (over >= least[number])).tolist():
                own, new = best[int(gid[i])], (int(over[i]), -int(tid[i]))  # terms are numbered in their order: ties go to the smaller
                if len(own) < top:
                    heapq.heappush(own, new)
                elif new > own[0]:
                    heapq.heapreplace(own, new)
            codes, sums = _pair_sums(number, len(keys), starts, sizes, p, p0)
            none = pa.nulls(len(codes), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys[codes // len(keys)]), pa.array(keys[codes % len(keys)]), none, pa.array(sums)], schema=FOUND)

        held, n = [], 0
        for batch in batches:
            held.append(np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns]))
            n += len(batch)
            if n >= cells:
                table = np.concatenate(held, axis=1)
                end = int(np.searchsorted(table[0], table[0][-1]))  # the last term may go on in the next batch
                if end:
                    yield block(table[:, :end])
                held, n = [table[:, end:]], len(table[0]) - end
        if n:
            yield block(np.concatenate(held, axis=1))
        rows = [(g, -t, v) for g, own in best.items() for v, t in own]
        gids, tids, values = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(gids), pa.nulls(len(rows), pa.int64()), pa.array(tids), pa.array(values)], schema=FOUND)
        release_memory()

    return run


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top: int = 200,
    first: int = 8, max_shipped: int = 1_000_000, bound: int = 600_000,
) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each source from the others, and its most overused terms.

    Terms are runs of ASCII letters and code points beyond ASCII, A-Z in lower case; a language keeps those that ``min_docs`` of
    its rows hold (``frequent_terms``). With V kept terms, N occurrences of them in a group and c of one term, its share is
    p = 1 + floor(10^9 (c + 1) / (N + V)); f = floor((p - q)^2 / q). Part ``pair``: the sum of f over all kept terms, against each other
    source of the language. Part ``term``: f against the language as a whole, of terms that occur in the source and have p > q, ranks to ``top``.
    All numbers are whole and exact: a pair's sums are at most 4 (10^9 + V)^2, so 64 bits hold them for fewer than 5 * 10^8 kept terms of a language.

    A kept term that neither of two sources has adds the same f for each, and one that only one of them has adds what depends on its
    count alone; so pairs are summed over the terms that both have, over histograms of counts, and over the number of terms.

    Every row is a document, whether or not its id or text repeats. A null text, language or source is ''. A text without terms still makes
    its group. A language without kept terms has value 0 for each pair. A term's sources meet in one task, block by block. Ties go to the
    smaller item by bytes. Other columns are left out. An empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(as_bytes(lang).alias("lang"), as_bytes(source).alias("source"), as_bytes(text).alias("text"))
    # numbers in the order of the terms: ranges come in order, and so do the rows of a range
    terms = write_shared(frequent_terms(docs, min_docs, first, max_shipped, bound), "kept-terms").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    terms = write_shared(terms.withColumn("tid", F.monotonically_increasing_id()), "numbered-terms")
    ids = write_shared(docs.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "numbered-groups")
    counts = write_shared(term_counts(docs, terms, ids, max_shipped, bound), "term-counts")
    kinds = terms.groupBy("lang").agg(F.count("*").alias("kinds"))
    groups = ids.join(counts.groupBy("gid").agg(F.sum("c").alias("total")), "gid", "left").join(kinds, "lang", "left")
    groups = groups.select("gid", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds"))
    groups = write_shared(groups.withColumn("p0", _share("CAST(0 AS BIGINT)", "total", "kinds")), "source-groups")
    every = groups.groupBy("lang").agg(F.sum("total").alias("every"))
    known = write_shared(groups.join(every, "lang").select("gid", "p0", "total", "kinds", "every"), "group-totals")
    cells = counts.join(broadcast_if_small(known, 100_000), "gid")
    by_term = cells.select("tid", "gid", "c", "total", "kinds", "every").repartition("tid").sortWithinPartitions("tid")
    found = write_shared(by_term.mapInArrow(_compare(top), "gid long, other long, tid long, value long"), "term-parts")

    shares = write_shared(cells.groupBy("gid", "p0", _share("c", "total", "kinds").alias("p")).agg(F.count("*").alias("m")), "share-histogram")
    named = groups.select("gid", "lang", "source")
    shares = shares.join(named, "gid")
    rivals = groups.filter("kinds > 0").select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    mine = shares.join(rivals, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr(f"m * ({_gap('p', 'o0')} - {_gap('p0', 'o0')})")).alias("v"))
    theirs = shares.join(rivals, "lang").filter("source <> item").groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(F.expr(f"m * ({_gap('o0', 'p')} - {_gap('o0', 'p0')})")).alias("v"))
    rest = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0")), "lang").filter("source <> item")
    rest = rest.select("lang", "source", "item", F.expr(f"CASE WHEN kinds > 0 THEN kinds * ({_gap('p0', 'o0')}) ELSE 0 END").alias("v"))
    other = groups.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    both = found.filter("other IS NOT NULL").groupBy("gid", "other").agg(F.sum("value").alias("v")).join(named, "gid").join(other, "other").select("lang", "source", "item", "v")
    pairs = both.unionByName(mine).unionByName(theirs).unionByName(rest).groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))
    top_by = Window.partitionBy("gid").orderBy(F.desc("value"), "tid")
    over = found.filter("tid IS NOT NULL").withColumn("_r", F.row_number().over(top_by)).filter(F.col("_r") <= top).drop("_r")
    over = over.join(named, "gid").join(terms.select("tid", F.col("term").alias("item")), "tid").select("lang", "source", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    out = ranked(pairs, "pair").unionByName(ranked(over, "term").filter(F.col("rank") <= top))
    return out.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")], F.col("value").cast("long").alias("value"), "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
share AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v) AS p
  FROM cell JOIN v USING (lang)),
whole AS (
  SELECT lang, term, 1 + (1000000000 * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM cell GROUP BY ALL) JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM share JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
