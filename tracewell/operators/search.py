"""Metadata, keyword, fuzzy and vector search over typed documents, and the incremental vector index."""

from __future__ import annotations

import difflib
import heapq
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracewell.functions.text import content_hash, head_snippet, labelled, mixed_tokens, snippet, token_jaccard
from tracewell.operators.batches import bound_batches, by_key, release_memory
from tracewell.operators.bounded import broadcast_if_small
from tracewell.sources.io import VectorStore
from tracewell.sources.shared import write_shared

# ---------------------------------------------------------------- metadata


def filter_instances(df: DataFrame, filters: dict, names: dict[str, str] | None = None, column: str = "frontmatter") -> DataFrame:
    """Rows whose map has each value: equal to a scalar, one of a list. Keys may be display names (``names``)."""
    for k, want in filters.items():
        value = F.try_element_at(column, F.lit((names or {}).get(k, k)))
        df = df.filter(value.isin(*want) if isinstance(want, (list, tuple, set)) else value == str(want))
    return df


def resolve_instance(wanted: DataFrame, instances: DataFrame, ref: str = "ref") -> DataFrame:
    """``wanted`` with the id that its reference is, else the smallest id of that name, and all ids where the name is not unique."""
    ids = instances.select(F.col("id").alias("_id")).distinct()
    names = instances.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_first"), F.array_sort(F.collect_set("id")).alias("_all"))
    rows = wanted.join(ids, F.col(ref) == F.col("_id"), "left").join(names, F.col(ref) == F.col("_name"), "left")
    doubt = F.when(F.col("_id").isNull() & (F.size("_all") > 1), F.col("_all"))
    return rows.withColumn("id", F.coalesce("_id", "_first")).withColumn("ambiguous", doubt).drop("_id", "_name", "_first", "_all")


def instance_view(df: DataFrame, attributes: list[tuple[str, str]]) -> DataFrame:
    """(id, one column an attribute): the section of that name, else the front-matter key, else null. ``attributes`` are (name, key)."""
    pick = lambda n, k: F.coalesce(F.try_element_at("sections", F.lit(n)), F.try_element_at("frontmatter", F.lit(k))).alias(n)
    return df.select("id", *[pick(n, k) for n, k in attributes])


def instance_cards(df: DataFrame, brief: str = "brief") -> DataFrame:
    return df.select("id", "type_id", "name", F.try_element_at("frontmatter", F.lit(brief)).alias("brief"))


def describe_types(types: DataFrame, instances: DataFrame) -> DataFrame:
    """Types with the number of their instances, none included."""
    n = instances.groupBy("type_id").agg(F.count("*").alias("n"))
    return types.join(n, "type_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def searchable_attributes(attributes: DataFrame) -> DataFrame:
    """``attributes`` with whether each is in the vector index and why not. Both spellings of the flag are accepted."""
    flagged = F.coalesce(F.col("vector"), F.col("searchable").isin("vector", "both"), F.lit(False))
    kind = F.coalesce(F.col("content_type"), F.lit("prose")).isin("prose", "list", "table")
    note = F.when(~flagged, "not flagged").when(~kind, "type is not text")
    return attributes.withColumn("effective", flagged & kind).withColumn("note", note)


def index_entries(df: DataFrame, text: str, kind: Column, min_len: int = 40, excluded: tuple[str, ...] = ("code", "plantuml")) -> DataFrame:
    """``df`` with ``skip_reason`` (null: to be indexed)."""
    reason = F.when(kind.isin(*excluded), "excluded type").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.length(F.trim(text)) < min_len, "too short")
    return df.withColumn("skip_reason", reason)


def instance_checks(df: DataFrame, required: list[str], enums: dict[str, list[str]], id_pattern: str, known: list[str]) -> DataFrame:
    """(id, findings): missing required attributes, values outside an enum, id pattern, unknown sections, orphan preamble."""
    has = F.array_union(F.map_keys("sections"), F.map_keys("frontmatter"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), has), lambda x: F.concat(F.lit("missing "), x))
    unknown = F.transform(F.array_except(F.map_keys("sections"), F.array(*map(F.lit, known))), lambda x: F.concat(F.lit("unknown section "), x))
    bad = [
        F.when(F.try_element_at("frontmatter", F.lit(k)).isNotNull() & ~F.try_element_at("frontmatter", F.lit(k)).isin(*v), F.lit(f"enum {k}"))
        for k, v in enums.items()
    ]
    rest = F.array(*bad, F.when(~F.coalesce(F.col("id").rlike(id_pattern), F.lit(False)), "id pattern"), F.when(F.coalesce("preamble", F.lit("")) != "", "orphan preamble"))
    return df.select("id", F.concat(missing, unknown, F.filter(rest, lambda x: x.isNotNull())).alias("findings"))


def kb_validate(checks: DataFrame) -> DataFrame:
    return checks.filter(F.size("findings") > 0)


def kb_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(labelled(F.col("type_id")).alias("type_id")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- tiles

QUERY_BLOCK, BASE_BLOCK = 512, 4096


def deal_tiles(base: DataFrame, key: str, asked: DataFrame, query: str, query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both tables with the numbers (_qb, _bb) of their tiles: each query meets each row of the base in one tile of about
    ``query_block`` queries and ``base_block`` rows. Blocks go by hash; only the two counts come to the driver."""
    nq, nb = (max(1, -(-df.count() // n)) for df, n in ((asked, query_block), (base, base_block)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return base.withColumn("_bb", block(key, nb)).withColumn("_qb", whole(nq)), asked.withColumn("_qb", block(query, nq)).withColumn("_bb", whole(nb))


# ---------------------------------------------------------------- keyword and fuzzy


def keyword_search(df: DataFrame, key: str, text: str, words: list[str], limit: int | None = None) -> DataFrame:
    """(word, key, snippet): texts that contain each word in any case, in key order, at most ``limit`` a word."""
    rows = df.select(key, F.col(text).alias("_t"), F.explode(F.array(*map(F.lit, words))).alias("word"))
    rows = rows.filter(F.contains(F.lower("_t"), F.lower("word"))).select("word", key, snippet(F.col("_t"), F.col("word")).alias("snippet"))
    if limit is None:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy(key))).filter(F.col("_r") <= limit).drop("_r")


def _fuzzy_parts(text: Column, x: str) -> list[Column]:
    """What the native score needs of a text: lower case, the same without blanks, and tokens."""
    return [F.lower(text).alias(f"_{x}l"), F.replace(F.lower(text), F.lit(" "), F.lit("")).alias(f"_{x}s"), mixed_tokens(text).alias(f"_{x}t")]


def fuzzy_lower_score() -> Column:
    """0.5 for a substring, with or without blanks, and 0.3 times the token Jaccard, of the parts (``_fuzzy_parts``) of query q and name n."""
    inside = F.contains("_nl", "_ql") | F.contains("_ns", "_qs")
    return 0.5 * inside.cast("double") + 0.3 * token_jaccard(F.col("_qt"), F.col("_nt"))


def fuzzy_scores(names: DataFrame, queries: DataFrame, key: str = "id", name: str = "name", query: str = "query", query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK) -> DataFrame:
    """(query, key, score): the native score of every distinct query against every name, in tiles; no table is broadcast on purpose.

    Texts are cut into tokens once a row, before tiles are dealt, and the keys of one name in a block of the base are one row there: a query is
    scored against a name once a block, however many keys have it.
    """
    asked = queries.select(F.col(query).alias("_q")).distinct()
    rows, asked = deal_tiles(names.select(F.col(key).alias("_k"), F.col(name).alias("_n")), "_k", asked, "_q", query_block, base_block)
    # keys in structs, as lists leave out nulls
    rows = rows.groupBy("_qb", "_bb", "_n").agg(F.collect_list(F.struct(F.col("_k").alias(key))).alias("_keys"))
    rows = rows.select("_qb", "_bb", "_keys", *_fuzzy_parts(F.col("_n"), "n"))
    asked = asked.select("_qb", "_bb", "_q", *_fuzzy_parts(F.col("_q"), "q"))
    scored = rows.join(asked, ["_qb", "_bb"]).select(F.col("_q").alias(query), "_keys", F.round(fuzzy_lower_score(), 6).alias("score"))
    return scored.select(query, F.inline("_keys"), "score")


def _ratio(query: str, name: str) -> float:
    return difflib.SequenceMatcher(None, query, name).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(query: pd.Series, name: pd.Series) -> pd.Series:
    """difflib's ratio of (query, name), in this order."""
    return pd.Series([_ratio(q, n) for q, n in zip(query, name, strict=True)], dtype=float)


class NameTile:
    """Names of one tile as posting lists: by token, by three code points in a row without blanks, and a table of how often each letter occurs."""

    GRAM = 3

    def __init__(self, names: list[str], tokens: list[set]):
        self.names, self.tokens, self.squeezed = names, tokens, [n.replace(" ", "") for n in names]
        self.by_token, self.by_gram = defaultdict(list), defaultdict(list)
        for i, (own, n) in enumerate(zip(tokens, self.squeezed, strict=True)):
            for t in own:
                self.by_token[t].append(i)
            for g in {n[j : j + self.GRAM] for j in range(len(n) - self.GRAM + 1)}:
                self.by_gram[g].append(i)
        self.letter: dict[str, int] = {}
        for c in "".join(names):
            self.letter.setdefault(c, len(self.letter))
        self.letters = np.zeros((len(names), len(self.letter)), np.int32)
        for i, n in enumerate(names):
            for c, x in Counter(n).items():
                self.letters[i, self.letter[c]] = x
        self.size = np.array([len(n) for n in names], np.int64)

    def holding(self, squeezed: str) -> list[int]:
        """Names that contain the query without blanks: those on its shortest posting list are looked at."""
        if len(squeezed) < self.GRAM:
            return [i for i, n in enumerate(self.squeezed) if squeezed in n]
        lists = [self.by_gram.get(squeezed[j : j + self.GRAM], []) for j in range(len(squeezed) - self.GRAM + 1)]
        return [i for i in min(lists, key=len) if squeezed in self.squeezed[i]]

    def best(self, query: str, tokens: set, k: int) -> tuple[list[tuple[int, float]], int]:
        """The ``k`` best (name, score) above zero, and how many ratios were computed.

        Substring and tokens give a score from below; the letters that both have bound the ratio. Names are taken by their upper bound, the largest
        first, until it is below the k-th best score.
        """
        low = np.zeros(len(self.names))
        common = Counter(i for t in tokens for i in self.by_token.get(t, ()))
        for i, c in common.items():
            low[i] = 0.3 * (c / (len(tokens) + len(self.tokens[i]) - c))
        for i in self.holding(query.replace(" ", "")):
            low[i] = 0.5 + low[i]
        mine = Counter(query)
        known = [c for c in mine if c in self.letter]
        shared = np.minimum(self.letters[:, [self.letter[c] for c in known]], [mine[c] for c in known]).sum(axis=1) if known else np.zeros(len(low), np.int64)
        high = low + 0.4 * shared / np.maximum(self.size + len(query), 1)
        found: list[tuple[float, int]] = []  # a heap of (score, -place): the worst first
        tried = 0
        for i in np.lexsort((np.arange(len(high)), -high)).tolist():
            if high[i] <= 0 or (len(found) == k and high[i] < found[0][0] - 1e-12):
                break
            tried += 1
            score = float(low[i]) + 0.2 * _ratio(query, self.names[i])
            if score > 0:
                (heapq.heappush if len(found) < k else heapq.heappushpop)(found, (score, -i))
        return [(-i, score) for score, i in found], tried


def fuzzy_search(
    names: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", name: str = "name", query: str = "query", query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK
) -> DataFrame:
    """(query, key, score): the k best of 0.5 substring + 0.3 Jaccard + 0.2 sequence ratio, zero left out, ties by key.

    Queries and names meet in tiles, each pair once. A tile keeps its names as posting lists of tokens and of letter triples and
    computes ratios in the order of their upper bounds only (``NameTile``), so most pairs cost a bound and no ratio; k rows a tile and query are
    shuffled. Tokens are cut once a row, before tiles are dealt. Null names and queries, and empty queries, have no row.
    """
    asked = queries.select(F.col(query).alias("_q")).filter(F.trim("_q") != "").distinct()
    asked = write_shared(asked.select("_q", F.lower("_q").alias("_low"), mixed_tokens(F.col("_q")).alias("_tokens")), "fuzzy-queries")
    base = names.select(F.col(key).alias("_k"), F.lower(name).alias("_low"), mixed_tokens(F.col(name)).alias("_tokens")).filter("_low IS NOT NULL AND _k IS NOT NULL")
    rows, dealt = deal_tiles(base, "_k", asked, "_q", query_block, base_block)
    tile, kind = ["_qb", "_bb"], base.schema["_k"].dataType.simpleString()
    both = dealt.select(*tile, F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_k"), "_q", "_low", "_tokens")
    both = both.unionByName(rows.select(*tile, F.lit(1).alias("_side"), "_k", F.lit(None).cast("string").alias("_q"), "_low", "_tokens"))

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_key(parts, tile):
            n = int((pdf["_side"] == 0).sum())
            if n in (0, len(pdf)):
                continue
            low, tokens = pdf["_low"].to_list(), [set(t) for t in pdf["_tokens"]]
            keys, here = pdf["_k"].to_list()[n:], NameTile(low[n:], tokens[n:])
            out = [(q, keys[i], score) for q, x, t in zip(pdf["_q"].to_list()[:n], low[:n], tokens[:n], strict=True) for i, score in here.best(x, t, k)[0]]
            yield pd.DataFrame(out, columns=["_q", "_k", "_s"])

    # keys travel as text beside nulls, so that whole numbers stay whole
    sent = both.repartition(*tile).sortWithinPartitions(*tile, "_side", "_k", "_low").withColumn("_k", F.col("_k").cast("string"))
    found = sent.mapInPandas(best, "_q string, _k string, _s double").select("_q", F.col("_k").cast(kind).alias("_k"), "_s")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_s"), "_k"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= k).select(F.col("_q").alias(query), F.col("_k").alias(key), F.round("_s", 4).alias("score"))


def pack_numbers(rising: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of rising numbers as bytes, seven bits each, of the gaps in a list: all bytes, and how many each number takes. ``first`` marks where lists begin."""
    gaps = np.diff(rising, prepend=0)
    gaps[first] = rising[first]
    size = np.ones(len(gaps), np.int64)
    for k in range(7, 35, 7):
        size += gaps >= 1 << k
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[start[on] + k] = (gaps[on] >> 7 * k & 127) | np.where(size[on] > k + 1, 128, 0)
    return out, size


def unpack_numbers(packed: bytes) -> np.ndarray:
    """The rising numbers of one list of ``pack_numbers``."""
    raw = np.frombuffer(packed, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    new = np.concatenate([[True], raw[:-1] < 128])
    start = np.flatnonzero(new)
    shift = 7 * (np.arange(len(raw)) - start[np.cumsum(new) - 1])
    return np.cumsum(np.add.reduceat((raw & 127) << shift, start))


class KeywordIndex:
    """Posting lists of three letters in a row over lower-case texts, by chunks of texts: an index that grows with new texts only.

    A task cuts its texts into chunks. A chunk is one list of the hashes of its texts and, for each letter triple, the packed places of
    the texts that hold it: some bytes a text and triple, and neither postings nor the index are ever shuffled. ``search`` finds the texts
    that are on the lists of all of a word's triples and looks for the word in these texts only; the result is that of ``keyword_search``. Words of
    one or two letters, which are on no list, are looked for in all texts. ``add`` is one write to Parquet below ``path``, in ``buckets`` folders by triple, so that
    a search reads the folders of its own triples, and none for a driver that stops in between.
    """

    GRAM, HASHES, SHIP = 3, -1, 2_000_000

    def __init__(self, spark, path: str, buckets: int = 64, chunk: int = 2_000_000):
        self.spark, self.path, self.buckets, self.chunk = spark, path.rstrip("/"), buckets, chunk

    def _lists(self, buckets: list[int]) -> DataFrame:
        kind = "chunk string, gram string, packed binary, bucket int"
        try:
            rows = self.spark.read.schema(kind).option("basePath", self.path).parquet(self.path)
        except Exception as e:  # nothing added yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], kind)
        return rows.filter(F.col("bucket").isin(buckets))

    def hashes(self) -> DataFrame:
        """(chunk, place, hash) of the texts of each chunk."""
        every = F.transform(F.sequence(F.lit(0), (F.octet_length("packed") / 32).cast("int") - 1), lambda i: F.lower(F.hex(F.substring("packed", i * 32 + 1, 32))))
        return self._lists([self.HASHES]).select("chunk", F.posexplode(every).alias("place", "hash"))

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def add(self, texts: DataFrame, text: str) -> int:
        """Append the texts that are not stored yet; how many there were.

        Only hashes are shuffled to tell what is new. Up to ``SHIP`` of them go to all tasks as numbers, so that texts stay where they are read; a text that comes again in
        another chunk, or that one number mistakes for a new one, is on lists twice and found once.
        """
        bound_batches(self.spark)
        rows = texts.select(F.col(text).alias("text")).filter("text IS NOT NULL").withColumn("hash", content_hash(F.col("text")))
        new = write_shared(rows.select("hash").distinct().join(self.hashes().select("hash"), "hash", "left_anti"), "new-hashes")
        n = new.count()
        wanted = broadcast_if_small(new.select(F.xxhash64("hash").alias("_h")), self.SHIP)
        fresh = rows.withColumn("_h", F.xxhash64("hash")).join(wanted, "_h", "left_semi").select("hash", F.lower("text").alias("text"))
        gram, most = self.GRAM, self.chunk

        def whole(hashes: list[str], codes: list[np.ndarray]) -> pd.DataFrame:
            place = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            code, place = code[order], place[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            raw, size = pack_numbers(place, first)
            ends = np.concatenate([np.cumsum(size) - size, [len(raw)]])[np.append(first, len(place))]
            data = raw.tobytes()
            letters = np.stack([code[first] >> 21 * (gram - 1 - k) & 0x1FFFFF for k in range(gram)], axis=1)
            names = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            grams = [None] + [names[i : i + gram] for i in range(0, len(names), gram)]
            packed = [bytes.fromhex("".join(hashes))] + [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            return pd.DataFrame({"chunk": uuid.uuid4().hex, "gram": grams, "packed": packed})

        def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Chunks of about ``most`` postings; a text's copies within a chunk are one."""
            held: dict[str, np.ndarray] = {}
            size = 0
            for pdf in parts:
                for h, t in zip(pdf["hash"], pdf["text"], strict=True):
                    if h in held:
                        continue
                    a = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                    code = sum(a[k : max(len(a) - gram + 1 + k, k)] << 21 * (gram - 1 - k) for k in range(gram)) if len(a) >= gram else a[:0]
                    held[h] = np.unique(code)
                    size += len(held[h])
                    if size >= most:
                        yield whole(list(held), list(held.values()))
                        held, size = {}, 0
            if held:
                yield whole(list(held), list(held.values()))
            release_memory()

        lists = fresh.mapInPandas(cut, "chunk string, gram string, packed binary")
        bucket = F.when(F.col("gram").isNull(), self.HASHES).otherwise(self._bucket(F.col("gram")))
        lists.withColumn("bucket", bucket).sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(self.path)
        return n

    def candidates(self, words: DataFrame) -> DataFrame:
        """(word, hash) of texts that are on the lists of all letter triples of a word; words shorter than three letters meet every text."""
        asked = words.select("word").filter("word IS NOT NULL AND word <> ''").distinct()
        low, n = F.lower("word"), self.GRAM
        each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n))))
        wanted = asked.filter(F.length(low) >= n).select("word", each.alias("_g")).select("word", F.size("_g").alias("_n"), F.explode("_g").alias("gram"))
        buckets = [r[0] for r in wanted.select(self._bucket(F.col("gram")).alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers

        def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for chunk, word, n, packed in pdf.itertuples(index=False):
                    yield pd.DataFrame({"chunk": chunk, "word": word, "_n": n, "place": unpack_numbers(packed)})

        lists = self._lists(buckets).join(wanted, "gram").select("chunk", "word", "_n", "packed")
        hits = lists.mapInPandas(unpack, "chunk string, word string, _n int, place int")
        hits = hits.groupBy("chunk", "word", "place").agg(F.count("*").alias("_c"), F.max("_n").alias("_n")).filter("_c = _n")
        found = hits.join(self.hashes(), ["chunk", "place"]).select("word", "hash")
        short = asked.filter(F.length(low) < n).join(self.hashes().select("hash"), F.lit(True))
        return found.unionByName(short).distinct()

    def search(self, rows: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
        """(word, key, snippet) of ``rows``, whose texts were added: as ``keyword_search`` without a limit. The word is looked for in candidates' texts only."""
        asked = self.spark.createDataFrame([(w,) for w in words], "word string")
        found = self.candidates(asked).groupBy("hash").agg(F.collect_list("word").alias("words"))  # each asked word once at most
        found = broadcast_if_small(write_shared(found, "keyword-candidates"), self.SHIP // 4)
        here = rows.select(key, F.col(text).alias("_t"), content_hash(F.col(text)).alias("hash")).join(found, "hash").select(key, "_t", F.explode("words").alias("word"))
        return here.filter(F.contains(F.lower("_t"), F.lower("word"))).select("word", key, snippet(F.col("_t"), F.col("word")).alias("snippet"))


# ---------------------------------------------------------------- vectors


def best_of_tiles(dealt: DataFrame, tile: list[str], k: int) -> DataFrame:
    """(query_id, _k, _s): the k best rows (_side 1) of each query (_side 0) of a tile; ``dealt`` has the tile's columns, _side, _k and _v."""

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_key(parts, tile):
            n = int((pdf["_side"] == 0).sum())
            if n in (0, len(pdf)):
                continue
            keys, v, out = pdf["_k"].to_numpy(np.int64), np.stack(pdf["_v"].to_list()), []
            base, names = v[n:], keys[n:]
            score = v[:n] @ base.T
            for j in range(n):
                s = score[j]
                near = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9)
                exact = np.add.reduce(np.ascontiguousarray((base[near] * v[j]).T), axis=0)
                top = np.lexsort((names[near], -exact))[:k]
                out.append(pd.DataFrame({"query_id": keys[j], "_k": names[near][top], "_s": exact[top]}))
            yield pd.concat(out)

    return dealt.repartition(*tile).sortWithinPartitions(*tile, "_side", "_k").mapInPandas(best, "query_id long, _k long, _s double")


def vector_search(
    vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int = 10, min_score: float = 0.0, scope: Column | None = None, text: str | None = None,
    query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK,
) -> DataFrame:
    """(query_id, rank, key, score[, snippet]): the k largest dot products, then those of at least ``min_score``.

    ``queries`` (query_id, query_vector) and rows meet in tiles: a tile is one matrix product and gives up its own k best of a query,
    so the shuffle after it carries k rows a tile and query. What a product puts near the k-th place is summed again in a fixed order, so
    that equal vectors score the same in every tile. Ties to the smaller key. Every query meets every row: the work is their product
    (``VectorIndex`` leaves out what bounds exclude).
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.filter(scope) if scope is not None else vectors
    as_rows = lambda df, i, v: df.select(F.col(i).cast("long").alias("_k"), F.col(v).cast("array<double>").alias("_v")).filter("_v IS NOT NULL AND _k IS NOT NULL")
    rows, asked = deal_tiles(as_rows(rows, key, embedding), "_k", as_rows(queries, "query_id", "query_vector"), "_k", query_block, base_block)
    tile = ["_qb", "_bb"]
    dealt = asked.select(*tile, F.lit(0).alias("_side"), "_k", "_v").unionByName(rows.select(*tile, F.lit(1).alias("_side"), "_k", "_v"))
    found = best_of_tiles(dealt, tile, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "_k"))
    top = found.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("_s") >= min_score))
    out = top.select("query_id", "rank", F.col("_k").alias(key), F.round("_s", 4).alias("score"))
    if text is not None:
        out = out.join(vectors.select(key, head_snippet(F.col(text)).alias("snippet")), key)
    return out


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed word counts hashed to ``dim`` places, normalised: a stand-in that needs no model."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[i, h % dim] += 1 if h >> 31 else -1
            norm = np.linalg.norm(out[i])
            out[i] /= norm if norm else 1
        return out

    return encode


def build_index(entries: DataFrame, store: VectorStore, encode: Callable[[list[str]], np.ndarray] | None = None, text: str = "text", batch: int = 64) -> DataFrame:
    """Embed the texts whose hash is not stored, once a distinct text; one row of figures: entries, distinct, new, reused."""
    encode = encode or hashing_encoder()
    hashed = entries.select(content_hash(F.col(text)).alias("hash"), F.col(text).alias("_t")).filter("_t IS NOT NULL")
    distinct = hashed.groupBy("hash").agg(F.min("_t").alias("_t"))
    known = write_shared(store.read().select("hash").distinct(), "stored-hashes")
    new = distinct.join(known, "hash", "left_anti")

    def embed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"hash": some["hash"].to_numpy(), "embedding": list(encode(some["_t"].to_list()))})

    made = write_shared(new.mapInPandas(embed, "hash string, embedding array<float>"), "new-vectors")
    store.append(made)
    totals = hashed.agg(F.count("*").alias("entries"), F.countDistinct("hash").alias("distinct_texts"))
    return totals.join(F.broadcast(made.agg(F.count("*").alias("new"))), F.lit(True)).withColumn("reused", F.col("distinct_texts") - F.col("new"))
