"""N-gram Jaccard join by chosen paths.

Each document is its set of word shingles. The recursion splits documents on sampled shared
tokens: a node draws places of a MinHash sketch, and documents with the same value at a place go
to the same child. Small nodes are compared by brute force on sketches; runs are repeated until
two documents at the threshold meet with the target recall. What meets only proposes groups: each group
is then compared exactly on whole shingle sets, in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.batches import bound_batches, by_key, first_of_equal, release_memory
from tracewell.operators.bounded import broadcast_if_small
from tracewell.operators.components import connected_components
from tracewell.operators.tiles import DEALT, TILE, deal_bands, exact_links, local_components, tile_split, tiles_of
from tracewell.sources.shared import write_shared

PLACES = 64
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_VALUES = _series(11, 256)
FACTORS = _series(12, PLACES) | np.uint64(1)
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def _shingle_words(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each shingle of each text, in order, with repeats."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(space, np.uint64(0), BYTE_VALUES[data]) * up, dtype=np.uint64)])
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = mix((sums[last] - sums[first]) * down[first])
    owner = np.searchsorted(ends, first, side="right")
    factors = _series(13, words) | np.uint64(1)
    n = np.bincount(owner, minlength=len(texts))
    full = max(0, len(hashes) - words + 1)
    whole = owner[:full] == owner[len(hashes) - full :]
    made = np.zeros(full, np.uint64)
    for k in range(words):
        made += hashes[k : k + full] * factors[k]
    made, of = made[whole], owner[:full][whole]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(n)])
        extra = []
        for d in short:
            own = hashes[starts[d] : starts[d] + n[d]]
            extra.append(int((own * factors[: len(own)]).sum(dtype=np.uint64)) + len(own) & MASK)
        made, of = np.concatenate([made, np.array(extra, np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        made, of = made[order], of[order]
    return mix(made), of


def shingle_sets(texts: list[str | None], words: int = 5, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of anything but ASCII white space, in lower case; a text of fewer than ``words``
    words is one shingle, one without words has none. Texts are hashed together, about ``chunk``
    bytes at a time.
    """
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size < chunk):
            some.append(texts[at] or "")
            size += len(some[-1])
            at += 1
        made, of = _shingle_words(some, words)
        cuts = np.searchsorted(of, np.arange(len(some) + 1))
        for d in range(len(some)):
            yield np.unique(made[cuts[d] : cuts[d + 1]])


def sketch(shingles: np.ndarray) -> tuple[int, int, bytes]:
    """(sum, mixed sum, MinHash values) of a set; the first two with the size identify it."""
    if not len(shingles):
        return 0, 0, b""
    low = [int((shingles * f).min() >> np.uint64(32)) for f in FACTORS]
    signed = lambda x: int(x) - (1 << 64) if int(x) >> 63 else int(x)
    sums = (shingles.sum(dtype=np.uint64), mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return signed(sums[0]), signed(sums[1]), np.array(low, dtype="<u4").tobytes()


def survival(threshold: float, depth: int) -> float:
    """Least chance that two sets of similarity ``threshold`` still share a node after ``depth`` splits.

    A node has one child or two, 1 / threshold on average, and each keeps the pair with that similarity.
    """
    two, lost = min(1.0, 1 / threshold - 1), 0.0
    for _ in range(depth):
        x = 1 - threshold + threshold * lost
        lost = (1 - two) * x + two * x * x
    return 1 - lost


def runs_for(threshold: float, depth: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def missed_share(threshold: float, depth: int, recall: float, margin: float = 4.0) -> tuple[float, float]:
    """Chance that a pair at the threshold is missed in nodes that stay crowded to ``depth``, and the part of it due to the sketch filter.

    All runs draw from the same places: given that the pair agrees in m of them, a run keeps it with that share, and m is binomial.
    """
    least = threshold - margin * math.sqrt(threshold * (1 - threshold) / PLACES)
    two, whole, filtered = min(1.0, 1 / threshold - 1), 0.0, 0.0
    for m in range(PLACES + 1):
        p, same, lost = math.comb(PLACES, m) * threshold**m * (1 - threshold) ** (PLACES - m), m / PLACES, 0.0
        for _ in range(depth):
            x = 1 - same + same * lost
            lost = (1 - two) * x + two * x * x
        filtered += p * (m < least * PLACES)
        whole += p * (1.0 if m < least * PLACES else lost ** runs_for(threshold, depth, recall))
    return whole, filtered


def _children(node: np.ndarray, depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places): one or two sketch places that each row's node draws."""
    draw = mix(node ^ np.uint64(0x51ED270B + depth))
    one = (draw % np.uint64(PLACES)).astype(np.int64)
    other = (one + 1 + ((draw >> np.uint64(8)) % np.uint64(PLACES - 1)).astype(np.int64)) % PLACES
    two = (draw >> np.uint64(40)).astype(np.float64) / (1 << 24) < 1 / threshold - 1
    rows = np.arange(len(node))
    return np.concatenate([rows, rows[two]]), np.concatenate([one, other[two]])


def sketch_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, text_hash, text_check, n, d1, d2, low): size, identity and MinHash values of each text's shingle set. No shuffle.

    ``text_hash`` is of id and text: it tells the texts of a repeated id apart; ``text_check`` is a second hash of both.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for s in shingle_sets(pdf["_text"].to_list(), words):
                rows.append((len(s), *sketch(s)))
            made = pd.DataFrame(rows, columns=["n", "d1", "d2", "low"])
            # keys travel as text, so that a null does not turn whole numbers into doubles
            made.insert(0, "doc_id", pd.array([None if k is None else int(k) for k in pdf["_key"]], dtype="Int64"))
            made.insert(1, "text_hash", pdf["_hash"].to_numpy(np.int64))
            made.insert(2, "text_check", pdf["_check"].to_numpy(np.int64))
            yield made
        release_memory()

    rows = docs.select(F.col(key).cast("long").cast("string").alias("_key"), row_hash(key, text).alias("_hash"), row_check(key, text).alias("_check"), F.col(text).cast("string").alias("_text"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, text_check long, n long, d1 long, d2 long, low binary")


def row_hash(key: str, text: str) -> Column:
    """One number for id and text, so that a row is looked up by a single long."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"))


def row_check(key: str, text: str) -> Column:
    """A second hash, from another seed: both together tell rows apart where one of 64 bits would not."""
    return F.xxhash64(F.lit("check"), F.col(text).cast("string"), F.col(key).cast("long"))


def candidate_groups(
    classes: DataFrame, threshold: float, recall: float, small: int = 128, depth: int = 4, margin: float = 4.0
) -> DataFrame:
    """(node, component): documents that may have a link, with a group that holds all their partners.

    ``classes`` (cid, low) is a written table. A node of up to ``small`` documents is compared on
    sketches, and pairs within ``margin`` standard errors of the threshold are joined; nodes with the
    same members are compared once. Larger nodes split again. Documents that still crowd one node
    after ``depth`` splits agree on that many sampled values and are joined without comparing.
    """
    runs = runs_for(threshold, depth, recall)
    least = threshold - margin * math.sqrt(threshold * (1 - threshold) / PLACES)

    def split(level: int):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                cid = pdf["cid"].to_numpy(np.int64)
                low = np.frombuffer(b"".join(pdf["low"]), "<u4").reshape(-1, PLACES).astype(np.uint64)
                if level == 0:
                    row = np.tile(np.arange(len(cid)), runs)
                    node = np.repeat(_series(101, runs), len(cid))
                else:
                    row, node = np.arange(len(cid)), pdf["node"].to_numpy(np.int64).view(np.uint64)
                at, place = _children(node, level, threshold)
                row, node = row[at], node[at]
                child = mix(mix(node + FACTORS[place]) ^ low[row, place])
                yield pd.DataFrame({"cid": cid[row], "node": child.view(np.int64)})
            release_memory()

        return run

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for pdf in by_key(parts, ["node"]):
            cid = pdf["cid"].to_numpy(np.int64)
            low = np.frombuffer(b"".join(pdf["low"]), "<u4").reshape(-1, PLACES)
            like = np.zeros((len(cid), len(cid)), dtype=np.int16)
            for p in range(PLACES):
                like += low[:, p, None] == low[None, :, p]
            i, j = np.nonzero(np.triu(like >= least * PLACES, 1))
            if len(i):
                labels = local_components(len(cid), i, j)
                own = np.flatnonzero(labels != np.arange(len(cid)))
                out.append((cid[own], cid[labels[own]]))
            if len(out) >= 2000:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})
                out = []
        if out:
            yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})
        release_memory()

    lows = classes.select("cid", "low")
    rows = write_shared(lows.mapInPandas(split(0), "cid long, node long"), "nodes")
    links = None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("cid")).alias("members"))
        sizes = write_shared(sizes.filter("c > 1"), "node-sizes")
        fit = sizes.filter(F.col("c") <= small).groupBy("c", "members").agg(F.min("node").alias("node")).select("node")
        inside = rows.join(fit, "node").join(lows, "cid")
        pairs = inside.repartition("node").sortWithinPartitions("node").mapInPandas(compare, "a long, b long")
        pairs = write_shared(pairs, "node-links")
        links = pairs if links is None else links.unionByName(pairs)
        large = sizes.filter(F.col("c") > small).select("node")
        if large.isEmpty():
            break
        crowd = rows.join(large, "node")
        if level == depth:
            crowd = write_shared(crowd, "crowds")
            heads = write_shared(crowd.groupBy("node").agg(F.min("cid").alias("b")), "heads")
            links = links.unionByName(crowd.join(heads, "node").select(F.col("cid").alias("a"), "b").filter("a <> b"))
        else:
            rows = write_shared(crowd.join(lows, "cid").mapInPandas(split(level), "cid long, node long"), "nodes")
    return connected_components(links)


def set_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.9999,
    tile_docs: int = 512, tile_shingles: int = 400_000, max_broadcast: int = 300_000,
) -> tuple[DataFrame, DataFrame]:
    """(sketches, classes), both written: a row's identity (doc_id, text_hash, text_check, n, d1, d2), and one row a distinct shingle set.

    A class is the rows of one set (n, d1, d2), told apart by nothing else: an id that stands on different texts is in
    several classes, and each has its own links. It has a number (cid), its first row by (id, text hash) as ``rep`` and ``rep_hash``,
    its ``links`` to rows of other classes, and the first such row that links reach as ``first`` and ``first_hash``.
    """
    bound_batches(docs.sparkSession)
    same = ["n", "d1", "d2"]
    sketches = write_shared(sketch_documents(docs, key, text, words), "sketches")
    classes = (
        sketches.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*same)
        .agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", F.struct("doc_id", "text_hash")).alias("rep_hash"), F.count("*").alias("w"), F.min("low").alias("low"))
        .withColumn("cid", F.monotonically_increasing_id())  # fixed by the write
    )
    classes = write_shared(classes, "classes")
    groups = candidate_groups(classes, threshold, recall)
    members = classes.select("cid", "rep", "rep_hash", "w", "n", "d1").join(groups.withColumnRenamed("node", "cid"), "cid")
    members = write_shared(deal_bands(members, threshold, tile_docs, tile_shingles, ["cid"]), "blocked-members")
    chosen = broadcast_if_small(members, max_broadcast)
    texts = docs.select(row_hash(key, text).alias("rep_hash"), F.col(text).cast("string").alias("text")).join(chosen, "rep_hash")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # a row that repeats is cut once a task
        for pdf in parts:
            pdf = pdf[np.array([not (c in seen or seen.add(c)) for c in pdf["cid"]], dtype=bool)]
            keep = [(s, int(s.sum(dtype=np.uint64)) & MASK) for s in shingle_sets(pdf["text"].to_list(), words)]
            mine = [len(s) == n and total == int(d) & MASK for (s, total), n, d in zip(keep, pdf["n"], pdf["d1"], strict=True)]
            made = pdf[["cid", "w", *DEALT]].copy()
            made["shingles"] = [s.astype("<u8").tobytes() for s, _ in keep]
            yield made[np.array(mine, dtype=bool)]
        release_memory()

    dealt_kind = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in ("cid", "w", *DEALT))
    sets = texts.select("cid", "w", *DEALT, "n", "d1", "text").mapInPandas(cut, f"{dealt_kind}, shingles binary")
    dealt = sets.withColumn("_t", F.explode(tiles_of())).select("component", "_t.*", "band", "block", "cid", "w", "shingles")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in by_key(first_of_equal(parts, [*TILE, "cid"]), TILE):
            if (split := tile_split(pdf)) is None:
                continue
            cid, w = pdf["cid"].to_numpy(np.int64), pdf["w"].to_numpy(np.float64)
            i, j = exact_links([np.frombuffer(x, "<u8") for x in pdf["shingles"]], split, threshold)
            if len(i):
                links = np.bincount(i, weights=w[j], minlength=len(cid)) + np.bincount(j, weights=w[i], minlength=len(cid))
                labels, hit = local_components(len(cid), i, j), np.flatnonzero(links)
                out.append(pd.DataFrame({"cid": cid[hit], "links": links[hit].astype(np.int64), "root": cid[labels[hit]]}))
            if len(out) >= 1000:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)
        release_memory()

    near = dealt.repartition(*TILE).sortWithinPartitions(*TILE, "band", "block", "cid")
    found = write_shared(near.mapInPandas(verify, "cid long, links long, root long"), "verified-links")
    whole = connected_components(found, "cid", "root").withColumnRenamed("node", "cid")
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    reps = classes.select("cid", "rep", "rep_hash")
    linked = write_shared(sums.join(whole, "cid").join(reps, "cid"), "linked-classes")
    first = linked.groupBy("component").agg(F.min("rep").alias("first"), F.min_by("rep_hash", F.struct("rep", "rep_hash")).alias("first_hash"))
    linked = linked.join(first, "component").select("cid", "links", "first", "first_hash")
    by_class = classes.select("cid", *same, "rep", "rep_hash", "w").join(linked, "cid", "left").select(
        *same, "rep", "rep_hash", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "rep").alias("first"), F.coalesce("first_hash", "rep_hash").alias("first_hash")
    )
    return sketches.select("doc_id", "text_hash", "text_check", *same), write_shared(by_class, "class-links")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.9999, **how) -> DataFrame:
    """(key, class_id, n_links, n_shingles) for each row of ``docs``.

    Two rows are linked if the Jaccard similarity of their texts' sets of ``words``-word shingles is at
    least ``threshold``; n_links counts a row's links, copies included, and class_id is the smallest key
    that links reach. Texts of one shingle set become one weighted row first, so copies cost nothing. The
    chosen-path recursion proposes groups and each group is compared on whole sets, in bands of sizes and every pair in one tile of
    at most about 2 * ``tile_docs`` (512) documents; a tile gives sums of links and a spanning forest. No similarity below the
    threshold is ever reported. ``recall`` sets the number of runs as if these were independent; they draw from the same
    sketch places, so a pair at the threshold that only crowded nodes hold to the last level, and that no third document ties
    together, is missed more often: with the defaults 7.4e-4 of the time (``missed_share``), of which 1.3e-4 by the sketch filter.

    A text without words (null, empty, white space) has no link and is its own class. A row with a null key takes no
    part and has a null class. Rows are told apart by their texts: those that share a key have their own links and classes each;
    repeated rows link with each other. Other columns are left out. An empty table gives an empty one.
    """
    sketches, classes = set_classes(docs, key, text, words, threshold, recall, **how)
    part = F.col("doc_id").isNotNull()
    return sketches.join(classes, ["n", "d1", "d2"], "left").select(
        F.col("doc_id").alias(key), F.when(part, F.coalesce("first", "doc_id")).alias("class_id"),
        F.when(part & (F.col("n") > 0), F.col("links") + F.col("w") - 1).otherwise(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"),
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = 500_000, **how) -> DataFrame:
    """``docs`` less all but one row of each group of near copies: the first by (key, hash of the text) stays.

    Rows without a key or without words stay. Rows are looked up by two hashes of key and text, 128 bits in all, so that a row that is
    like no other is not taken for a copy, and a repeated key loses nothing but near copies; of rows that repeat with key and text one stays.
    Columns and other rows are as they were.
    """
    sketches, classes = set_classes(docs, key, text, **how)
    rows = sketches.filter("n > 0 AND doc_id IS NOT NULL").join(classes, ["n", "d1", "d2"])
    is_first = (F.col("doc_id") == F.col("first")) & (F.col("text_hash") == F.col("first_hash"))
    hashes = [F.col("text_hash").alias("_hash"), F.col("text_check").alias("_check")]
    gone = write_shared(rows.filter(~is_first).select(*hashes).distinct(), "near-copies")
    again = write_shared(rows.filter(is_first & (F.col("w") > 1)).groupBy(*hashes).count().filter("count > 1").drop("count"), "repeated-rows")
    keyed = docs.withColumns({"_row": row_hash(key, text), "_row_check": row_check(key, text)})
    on = (F.col("_row") == F.col("_hash")) & (F.col("_row_check") == F.col("_check"))
    kept = keyed.join(broadcast_if_small(gone, max_broadcast), on, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = broadcast_if_small(again, max_broadcast)
    once = kept.join(again, on, "left_semi").dropDuplicates(["_row", "_row_check"])
    return kept.join(again, on, "left_anti").unionByName(once).select(*docs.columns)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
      THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n.n, 0) AS n_shingles
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
