"""Token counts by linear longest match over a vocabulary trie.

Greedy word-piece segmentation takes the longest vocabulary entry at each place. Failure links
say where a match goes on once its text leaves the trie, and how many pieces are closed on the
way; with these numbers a word is counted in one pass over its bytes and no piece is built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.batches import bound_batches, release_memory

WORD_BREAK = "\t\n\x0b\x0c\r"


class Automaton:
    """Trie over byte strings with failure links and popped-piece counts."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.child: list[dict[int, int]] = [{}]
        ends = [False]
        for entry in vocabulary:
            at = 0
            for byte in entry:
                if byte not in self.child[at]:
                    self.child[at][byte] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                at = self.child[at][byte]
            ends[at] = ends[at] or at > 0
        self.fail = [-1] * len(self.child)  # -1: the text has no segmentation
        self.popped = [0] * len(self.child)
        queue = deque([0])
        while queue:
            up = queue.popleft()
            for byte, v in self.child[up].items():
                queue.append(v)
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, n = self.fail[up], self.popped[up]
                while z >= 0 and byte not in self.child[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.child[z][byte], n

    def count(self, word: bytes, unknown: int = 1) -> int:
        """Pieces of the greedy segmentation of one word; ``unknown`` if it has none."""
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for byte in word:
            while (to := child[at].get(byte)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return unknown
            at = to
        while at > 0:
            n += popped[at]
            at = fail[at]
        return n if at == 0 else unknown


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Entries of a byte-level tokenizer file as bytes; a leading space marks the start of a word."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"] for t in spec.get("added_tokens", ())}
    return [bytes(chars[c] for c in t) for t in spec["model"]["vocab"] if t not in added and all(c in chars for c in t)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_AUTOMATA: dict[str, Automaton] = {}


def _automaton(path: str) -> Automaton:
    """This worker's automaton; found by name on the executors, so that it outlives a task."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(byte_level_vocabulary(path))
    return _AUTOMATA[path]


def count_tokens(
    docs: DataFrame, text: str = "text", vocabulary: str | None = None, out: str = "token_counts", keep: int = 150_000
) -> DataFrame:
    """``docs`` with a struct (n_words, n_tokens, max_word_tokens) for each whole text.

    Words are runs of anything but ASCII white space, each led by one space byte as the
    vocabulary file at path ``vocabulary`` marks word starts. A word without a segmentation
    counts one unknown piece (none has, where all bytes are entries). A worker builds the
    automaton once from the file, which every machine must have, and keeps the counts of up to
    ``keep`` words. A null or empty text has zeros. Rows are independent: ties, repeats and empty
    tables need no rule; other columns pass through, one named ``out`` is replaced. No shuffle.
    """
    path = vocabulary or default_vocabulary()
    to_space = {ord(c): " " for c in WORD_BREAK}
    bound_batches(docs.sparkSession)

    @F.pandas_udf("struct<n_words:bigint,n_tokens:bigint,max_word_tokens:bigint>")
    def counts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(path)

        class Known(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= keep:
                    self.clear()
                n = self[word] = automaton.count(b" " + word.encode("utf-8", "surrogatepass"))
                return n

        known = Known()
        for texts in parts:
            rows = np.zeros((len(texts), 3), dtype=np.int64)
            for i, t in enumerate(texts):
                if t:
                    found = [known[w] for w in t.translate(to_space).split(" ") if w]
                    if found:
                        rows[i] = len(found), sum(found), max(found)
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "max_word_tokens"])
        release_memory()

    return docs.withColumn(out, counts(F.col(text).cast("string")))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "token_counts.n_words", "token_counts.n_tokens", "token_counts.max_word_tokens")
