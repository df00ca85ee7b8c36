"""Best-fit packing by minimum bin slack.

Bins are planned on the histogram of lengths, which has at most one entry a length whatever the
corpus: the longest length left seeds a bin, a bitset subset-sum programme over the lengths left
finds the fullest feasible combination, and that combination is removed as many times as it is
there. Pieces then look up their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.batches import bound_batches, release_memory
from tracewell.sources.shared import write_shared


def fullest(counts: np.ndarray, space: int) -> dict[int, int]:
    """Copies of each length whose sum is the largest that ``space`` allows; longer lengths first.

    Bit s of ``bits`` says that the lengths so far can sum to s.
    """
    bits, full, stages = 1, (1 << (space + 1)) - 1, []
    for length in range(space, 0, -1):
        left = min(int(counts[length]), space // length)
        if not left:
            continue
        stages.append((length, bits))
        step = 1
        while left:  # copies in powers of two: any number of them up to the count
            take = min(step, left)
            bits |= (bits << (take * length)) & full
            left -= take
            step *= 2
        if bits >> space & 1:
            break
    total, used = bits.bit_length() - 1, {}
    for length, before in reversed(stages):
        copies = 0
        while not before >> total & 1:
            total -= length
            copies += 1
        if copies:
            used[length] = copies
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """(segments by length, number of bins).

    A segment is a row (first rank, copies a bin, first bin, offset in the bin): the pieces of that
    length from that rank on fill the bins in turn, ``copies`` each.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    taken = np.zeros(capacity + 1, dtype=np.int64)
    segments: dict[int, list[tuple[int, int, int, int]]] = {}
    bins, longest = 0, capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            break
        counts[longest] -= 1
        pattern = fullest(counts, capacity - longest) if capacity > longest else {}
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(int(counts[length]) // copies for length, copies in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            segments.setdefault(length, []).append((int(taken[length]), copies, bins, offset))
            taken[length] += times * copies
            counts[length] -= times * copies
            offset += copies * length
        bins += times
    return {k: np.array(v, dtype=np.int64) for k, v in segments.items()}, bins


class ByteBpe:
    """Ids of whole texts. A text is cut before its spaces and the ids of each cut are kept.

    The pre-tokenizer starts anew at a space, so cuts have the same ids wherever they stand; new ones
    are therefore encoded together as one text, whose ids are dealt out again by their lengths in
    bytes. Where white space follows a space, or the text ends with one, a cut could part one run of
    white space: such a cut is kept as None and its text encoded whole.
    """

    def __init__(self, path: str, keep: int):
        from tokenizers import Tokenizer

        self.keep = keep

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        # a byte is one character in the entries of a byte-level vocabulary
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype="<u4")

    def _learn(self, cuts: list[str]) -> None:
        """Keep the ids of cuts, each with the space before it."""
        odd = [c for c in cuts if not c or c[0].isspace()]
        self.known.update(dict.fromkeys(odd))
        cuts = [c for c in cuts if c and not c[0].isspace()] if odd else cuts
        for at in range(0, len(cuts), 4096):
            some = cuts[at : at + 4096]
            ids = self._whole(" " + " ".join(some))
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) + 1 for c in some])
            at_id = np.concatenate([[0], np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1])
            data = ids.tobytes()
            self.known.update((c, data[4 * a : 4 * b]) for c, a, b in zip(some, at_id, at_id[1:], strict=False))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > self.keep:
            self.known.clear()
        cuts = [[] if any(a in t for a in self.added) else t.split(" ") for t in texts]
        known = self.known
        new: set[str] = set()
        for x in cuts:
            new.update(x[1:])  # the first has no space before it
        self._learn(list(new.difference(known)))
        for text, cut in zip(texts, cuts, strict=True):
            found = [known[c] for c in cut[1:]]
            if not cut or None in found:
                yield self._whole(text).tobytes()
            else:
                yield (self._whole(cut[0]).tobytes() if cut[0] else b"") + b"".join(found)


_ENCODERS: dict[str, ByteBpe] = {}


def _encoder(path: str, keep: int) -> ByteBpe:
    """This worker's encoder; found by name on the executors, so that it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path, keep)
    _ENCODERS[path].keep = keep
    return _ENCODERS[path]


def tokenize_pieces(
    docs: DataFrame, capacity: int, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False,
    keep: int = 600_000, warm: bool = True,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut only where longer than ``capacity``.

    All pieces of a cut document but the first have ``capacity`` ids. A null text is empty. A worker keeps the ids of up to
    about ``keep`` cuts (some 220 bytes each) and, if ``warm``, hands them on to its next task; the result does not depend on it.
    """
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    end = np.array([end_id], dtype="<u4").tobytes()
    bound_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(tokenizer, keep)
        for pdf in parts:
            for at in range(0, len(pdf), 500):  # large enough to learn many cuts at once
                some = pdf.iloc[at : at + 500]
                out = []
                for doc, ids in zip(some["_key"], encode([t or "" for t in some["_text"]]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or min(n, capacity)
                    edges = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        cut = ids[4 * a : 4 * b]
                        row = (doc, piece, a, b - a, zlib.crc32(cut))
                        out.append((*row, np.frombuffer(cut, "<u4").astype(np.int32)) if with_ids else row)
                made = pd.DataFrame(out, columns=[f.name for f in fields])
                if isinstance(kind, T.IntegralType):
                    made[key] = made[key].astype("Int64")
                yield made
        if not warm:  # the worker lives on, and other stages need its memory
            encode.known = {}
        release_memory()

    # one number a column: a null key keeps its rows
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInPandas(run, T.StructType(fields))


def pack(pieces: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are from 1 to ``capacity``.

    ``pieces`` is read twice: pass a table already written. Ranks among equal lengths come from
    hash buckets: a count of each (length, bucket), prefix sums over them and a row number inside
    one, so a length that a third of all pieces share is spread over all buckets. A column ``_salt`` of the table, if it has
    one, spreads rows that share their key as well, and is left out of the result. Only the
    histogram, of at most ``capacity`` rows, and the plan made from it pass through the driver.
    Equal rows get different places in any order; an empty table stays empty. Other columns pass
    through; ones named sequence_id or offset are replaced.
    """
    rows = pieces.count()
    buckets = 1 << max(6, min(16, (rows // 5000).bit_length()))
    salt = [c for c in pieces.columns if c == "_salt"]
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order, *salt), F.lit(buckets)))
    sizes = keyed.groupBy(F.col(length).alias("_l"), F.col("_bucket").alias("_b")).count()
    sizes = write_shared(sizes, "pack-counts")
    histogram = {r["_l"]: r["n"] for r in sizes.groupBy("_l").agg(F.sum("count").alias("n")).collect()}
    segments, _ = plan_bins(histogram, capacity)
    before = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_l", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(length, "_bucket").orderBy(*order)
    ranked = (
        keyed.join(starts, (F.col(length) == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_rank", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_l", "_b", "_bucket", "_start")
    )

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        by_length, rank = lengths.to_numpy(), ranks.to_numpy()
        for value in np.unique(by_length):
            mine, plan = by_length == value, segments[int(value)]
            at = np.searchsorted(plan[:, 0], rank[mine], side="right") - 1
            first, copies, base, offset = plan[at].T
            bins[mine] = base + (rank[mine] - first) // copies
            offsets[mine] = offset + (rank[mine] - first) % copies * value
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_salt")]
    return ranked.withColumn("_place", place(F.col(length), F.col("_rank"))).select(*kept, "_place.sequence_id", "_place.offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(
    docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False,
    keep: int = 600_000, warm: bool = True,
) -> DataFrame:
    """One row a piece with its place: (key, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Texts are encoded once, in one pass without a shuffle; the small piece table is written and
    packed. With ``with_ids`` the ids travel along, which is what a trainer reads.
    """
    made = tokenize_pieces(docs, capacity, tokenizer or default_tokenizer(), key=key, text=text, with_ids=with_ids, keep=keep, warm=warm)
    made = made.withColumn("_salt", F.monotonically_increasing_id())  # fixed by the write
    return pack(write_shared(made, "pieces"), capacity, order=(key, "piece"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
