"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score; the document's score
is their noisy-or, 1 - prod(1 - p). The sentence model is trained through that noisy-or from
document labels alone and then points out the offending sentences.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.batches import bound_batches, release_memory

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its prefixes, which stand for inflected and compounded forms."""
    keys = [f"w{word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(k.encode()) for k in keys]


class SentenceModel:
    """Additive word weights and a bias. A word's sum is kept, so a text costs a look-up a word."""

    KEEP = 150_000

    def __init__(self, weights: dict[int, float], bias: float, trained: bool = True):
        self.weights, self.bias, self.trained = weights, bias, trained
        self.seen: dict[str, float] = {}

    def word(self, word: str) -> float:
        if (w := self.seen.get(word)) is None:
            w = sum(self.weights.get(k, 0.0) for k in word_features(word))
            if len(self.seen) >= self.KEEP:
                self.seen.clear()
            self.seen[word] = w
        return w

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, logit) of the sentences that hold a word."""
        get, word = self.seen.get, self.word
        for m in SENTENCE.finditer(text):
            total, any_word = self.bias, False
            for w in WORD.findall(m[0].lower()):
                any_word = True
                s = get(w)
                total += word(w) if s is None else s
            if any_word:
                yield m.start(), m.end(), total

    def score(self, text: str | None) -> tuple[float, int, int | None, int | None, float | None]:
        """(noisy-or, offending sentences, start, end and score of the worst one)."""
        if not text or not self.trained:
            return 0.0, 0, None, None, None
        clean, hits, worst = 0.0, 0, None
        for start, end, z in self.sentences(text):
            clean += math.log1p(math.exp(z)) if z < 30 else z
            hits += z >= 0
            if z >= 0 and (worst is None or z > worst[2]):
                worst = (start, end, z)
        score = -math.expm1(-clean)
        return (score, hits, *(worst[:2] if worst else (None, None)), 1 / (1 + math.exp(-min(worst[2], 700))) if worst else None)


def fit(
    texts: list[str], labels: list[int], rounds: int = 160, rate: float = 0.15, l1: float = 2e-4, l2: float = 1e-5,
    bias: float = -6.0, min_docs: int = 3,
) -> SentenceModel:
    """Proximal Adam on the noisy-or likelihood; both classes weigh the same; rare features are left out."""
    if len(set(labels)) < 2:
        return SentenceModel({}, bias, trained=False)
    vocab: dict[str, int] = {}
    word_at: list[np.ndarray] = []
    sentence_of_doc: list[int] = []
    for d, text in enumerate(texts):
        for m in SENTENCE.finditer(text):
            words = {vocab.setdefault(w, len(vocab)) for w in WORD.findall(m[0].lower())}
            if words:
                word_at.append(np.fromiter(words, np.int32, len(words)))
                sentence_of_doc.append(d)
    if not word_at:
        return SentenceModel({}, bias, trained=False)
    of_doc = np.array(sentence_of_doc)
    words = np.concatenate(word_at)
    of_sentence = np.repeat(np.arange(len(word_at)), [len(x) for x in word_at])
    # features of each distinct word, then those in at least min_docs documents
    of_word, hashes = array("l"), array("l")
    for w, i in vocab.items():
        found = word_features(w)
        of_word.extend([i] * len(found))
        hashes.extend(found)
    names, keys = np.unique(np.frombuffer(hashes, dtype=np.int64), return_inverse=True)
    pairs = np.stack([np.frombuffer(of_word, dtype=np.int64), keys], 1)
    in_docs = np.unique(np.stack([of_doc[of_sentence], words], 1).astype(np.int64) @ np.array([len(vocab), 1]))
    docs_of_word = np.bincount(in_docs % len(vocab), minlength=len(vocab))
    common = np.bincount(pairs[:, 1], weights=docs_of_word[pairs[:, 0]], minlength=len(names)) >= min_docs
    pairs = pairs[common[pairs[:, 1]]]
    w, b = np.zeros(len(names)), bias
    y = np.array(labels, dtype=float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m1, m2, c1, c2 = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, rounds + 1):
        by_word = np.bincount(pairs[:, 0], weights=w[pairs[:, 1]], minlength=len(vocab))
        z = b + np.bincount(of_sentence, weights=by_word[words], minlength=len(word_at))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.bincount(of_doc, weights=np.logaddexp(0, z), minlength=len(y))
        pull = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(clean, 500)), 1e-9), 1.0) * weight
        g_sentence = pull[of_doc] * p
        g_word = np.bincount(words, weights=g_sentence[of_sentence], minlength=len(vocab))
        g = np.bincount(pairs[:, 1], weights=g_word[pairs[:, 0]], minlength=len(names)) + l2 * w
        gb = g_sentence.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        step = rate / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
        w = w - step * m1 / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step * l1, rate), 0)
        b = b - 0.5 * rate * (c1 / (1 - 0.9**t)) / (math.sqrt(c2 / (1 - 0.99**t)) + 1e-6)
    return SentenceModel({int(names[i]): float(w[i]) for i in np.flatnonzero(w)}, float(b))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
    per_class: int = 2000, clean_per_toxic: int = 2, max_chars: int = 18_000_000,
) -> DataFrame:
    """(text, y) of at most ``per_class`` documents labelled 1 and ``clean_per_toxic`` times as many labelled 0.

    A seeded hash of the key draws them, so the sample is spread over all labelled rows. Each class has its share of
    ``max_chars`` characters in all: documents are taken whole, in the order drawn, while they fit what is left, and a
    longer one is passed over for the next; of a key on several rows the one of the smallest hash stands for it. If none of a class fits, its shortest is taken, so that a class with labelled text never
    has an empty sample. Lengths are drawn first and only the texts chosen are read for; the chosen keys are so few that they are broadcast:
    the documents are not shuffled. Empty and null texts hold no sentence, tell a noisy-or nothing and are not drawn.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("y"))
    )
    spread = F.xxhash64(F.lit(17), "_k")
    most = {0: clean_per_toxic * per_class, 1: per_class}
    picked = [known.filter(F.col("y") == y).orderBy(spread, "_k").limit(n) for y, n in most.items()]
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("text")).filter(F.length("text") > 0).withColumn("_h", F.xxhash64("text"))
    drawn = rows.select("_k", "_h", F.length("text").alias("n")).join(F.broadcast(picked[0].unionByName(picked[1])), "_k")
    # of a key that stands on several rows, however many, one is drawn
    drawn = drawn.groupBy("_k", "y").agg(F.min(F.struct("_h", "n")).alias("_x")).select("_k", "y", "_x.*").orderBy(spread, "_k").collect()
    chosen = []
    for y in most:
        own, left = [r for r in drawn if r["y"] == y], max_chars * most[y] // sum(most.values())
        fit_ = []
        for r in own:
            if r["n"] <= left:
                fit_.append(r)
                left -= r["n"]
        chosen += fit_ or sorted(own, key=lambda r: r["n"])[:1]
    kind = f"_k {docs.schema[key].dataType.simpleString()}, _h long, y int, _at int"
    keys = docs.sparkSession.createDataFrame([(r["_k"], r["_h"], int(r["y"]), i) for i, r in enumerate(chosen)], kind)
    return rows.join(F.broadcast(keys), ["_k", "_h"]).dropDuplicates(["_at"]).orderBy("_at").select("text", "y")


def train_toxicity(docs: DataFrame, labels: DataFrame, **how) -> SentenceModel:
    rows = training_sample(docs, labels, **how).collect()
    texts, labels_ = [r["text"] for r in rows], [r["y"] for r in rows]
    del rows
    model = fit(texts, labels_)
    del texts
    release_memory()
    return model


def score_toxicity(docs: DataFrame, model: SentenceModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct: score, offending sentences, place and score of the worst sentence.

    Whole texts are read, however long; a null or empty text, or one without words, scores 0. If the labels
    held one class only, every score is 0. Other columns pass through; a column named ``out``
    is replaced. Rows are independent, so repeats and empty tables need no rule. No shuffle.
    """
    kind = "struct<score:double,n_offending:bigint,worst_start:bigint,worst_end:bigint,worst_score:double>"
    weights, bias, trained = model.weights, model.bias, model.trained
    bound_batches(docs.sparkSession)

    @F.pandas_udf(kind)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = SentenceModel(weights, bias, trained)
        for texts in parts:
            rows = [own.score(t) for t in texts]
            yield pd.DataFrame({
                "score": np.array([r[0] for r in rows], dtype=float),
                "n_offending": np.array([r[1] for r in rows], dtype=np.int64),
                "worst_start": pd.array([r[2] for r in rows], dtype="Int64"),
                "worst_end": pd.array([r[3] for r in rows], dtype="Int64"),
                "worst_score": pd.array([r[4] for r in rows], dtype="Float64"),
            })
        release_memory()

    return docs.withColumn(out, score(F.col(text).cast("string")))


def held_out(key: str = "doc_id"):
    """True for the rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fold_model(spark, sf_dir: str, docs: DataFrame) -> SentenceModel:
    """A model from the labels outside the held-out fold."""
    from tracewell.sources.tables import table

    return train_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out()))


THRESHOLD = 0.7


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fold_model(spark, sf_dir, docs))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity.score").alias("score"),
        F.when(F.col("toxicity.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "toxicity.n_offending", "toxicity.worst_start", "toxicity.worst_end", "toxicity.worst_score",
    )
