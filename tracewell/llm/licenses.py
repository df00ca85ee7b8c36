"""License scans: fixed phrases, and blocks of text that contain a license template, by an exact set-similarity join.

A template is a set of words. Blocks are windows of a text; a block matches if it holds the stated share of
a template's words. Words are ordered by how many documents hold them, the rarest first: a match must hold one of the first few
words of the template (prefix), have enough words (length), and enough of them behind the first common one (position).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tally import WORDS, as_bytes
from tracewell.operators.batches import bound_batches, release_memory

# Phrases and their labels.
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: (label, words): notices as they stand in files and on pages. A parameter of the scan.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike License"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def step_of(n_words: int, least: int = 8) -> int:
    """Blocks of a template of so many words begin at multiples of this and are twice as long: the power of two from ``least`` that holds the template."""
    return max(least, 1 << (n_words - 1).bit_length())


@dataclass
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, in the global order
    step: int
    need: int  # how many of them a block must hold

    @property
    def prefix(self) -> int:
        return len(self.words) - self.need + 1


class Index:
    """Templates by the words of their prefixes, under one global order of words."""

    def __init__(self, templates, threshold: float, frequency: dict[bytes, int]):
        rarest = sorted({w for _, t in templates for w in words_of(t.encode())}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: r for r, w in enumerate(rarest)}
        self.templates: list[Template] = []
        self.at: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # word -> (template, place in its order)
        for label, text in templates:
            words = words_of(text.encode())
            own = tuple(sorted(set(words), key=self.rank.__getitem__))
            if own:
                made = Template(label, own, step_of(len(words)), max(1, math.ceil(threshold * len(own) - 1e-9)))
                for i, w in enumerate(own[: made.prefix]):
                    self.at[w].append((len(self.templates), i))
                self.templates.append(made)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, common words) of every block that holds enough of a template."""
        tried, found = set(), []
        blocks: dict[tuple[int, int], tuple[list[int], int]] = {}
        for place, word in enumerate(words):
            if word not in self.at:
                continue
            for t, i in self.at[word]:
                made = self.templates[t]
                for b in (place // made.step - 1, place // made.step):
                    if b < 0 or (t, b) in tried:
                        continue
                    tried.add((t, b))
                    key = (made.step, b)
                    if key not in blocks:
                        block = set(words[b * made.step : (b + 2) * made.step])
                        blocks[key] = sorted(self.rank[w] for w in block if w in self.rank), len(block)
                    known, size = blocks[key]
                    if size < made.need:
                        continue
                    # the first common word bounds how many more can be common
                    first = min((self.rank[w] for w in made.words[: made.prefix] if self.rank[w] in known), default=None)
                    if first is None:
                        continue
                    i = next(k for k, w in enumerate(made.words) if self.rank[w] == first)
                    if 1 + min(len(made.words) - i - 1, len(known) - known.index(first) - 1) < made.need:
                        continue
                    common = len(set(known) & {self.rank[w] for w in made.words})
                    if common >= made.need:
                        found.append((t, b * made.step, min(len(words), (b + 2) * made.step), common))
        return sorted(found)


def phrase_places(lowered: bytes, words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(word number, label) of each place where the words of a phrase stand one after the other."""
    found = []
    for phrase, label in phrases:
        parts = phrase.split()
        if parts[-1] not in lowered:
            continue
        n, last, at = len(parts), parts[-1], -1
        try:
            while True:
                at = words.index(last, at + 1)
                if at >= n - 1 and words[at - n + 1 : at + 1] == parts:
                    found.append((at - n + 1, label))
        except ValueError:
            pass
    return found


def word_frequency(docs: DataFrame, wanted: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """How many texts hold each of the words of the templates: one row a word comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(wanted.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        release_memory()

    parts = docs.select(as_bytes(text).alias("t")).mapInArrow(run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


FOUND = (
    "struct<n_words:bigint,places:array<struct<word:bigint,label:string>>,"
    "matches:array<struct<label:string,template:int,first_word:bigint,end_word:bigint,containment:double>>>"
)


def scan_licenses(
    docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9, out: str = "licenses", max_templates: int = 100_000
) -> DataFrame:
    """``docs`` with a struct: n_words, the places of the fixed phrases, and every block that matches a template.

    Words are runs of digits, ASCII letters and code points beyond ASCII, A-Z in lower case. A template of n words (n up to 2**k, k >= 3) is
    compared with all windows of 2**(k+1) words that begin at multiples of 2**k, so a notice of its length lies in one wherever it
    stands, across lines too. A window matches if it holds ``threshold`` of the template's distinct words or more, by count and whatever
    their order; containment is the share it holds. Filters are exact: their order of words comes from all texts and changes which windows
    are looked at, never the result. The templates are a parameter and go to all tasks, ``max_templates`` of them at most.

    A null text is an empty one, without words, places and matches. Very long texts are scanned whole, in time that grows with
    their length. Rows are independent: ties, repeats and empty tables need no rule. Other columns pass through, one named ``out`` is replaced.
    """
    if len(templates) > max_templates:
        raise ValueError(f"more than {max_templates} templates")
    bound_batches(docs.sparkSession)
    wanted = frozenset(w for _, t in templates for w in words_of(t.encode()))
    index = Index(templates, threshold, word_frequency(docs, wanted, text))

    @F.pandas_udf(FOUND)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            n, places, matches = [], [], []
            for t in texts:
                lowered = t.translate(WORDS)
                words = lowered.split()
                n.append(len(words))
                places.append([{"word": w, "label": label} for w, label in sorted(phrase_places(lowered, words))])
                matches.append([
                    {"label": index.templates[k].label, "template": k, "first_word": a, "end_word": b, "containment": c / len(index.templates[k].words)}
                    for k, a, b, c in index.matches(words)
                ])
            yield pd.DataFrame({"n_words": n, "places": places, "matches": matches})
        release_memory()

    return docs.withColumn(out, found(as_bytes(text)))


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform("licenses.places", lambda p: p["label"])
    more = F.transform("licenses.matches", lambda m: m["label"])
    best = F.coalesce(F.array_max(F.transform("licenses.matches", lambda m: m["containment"])), F.lit(0.0))
    starts = F.transform("licenses.places", lambda p: p["word"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "licenses.n_words", F.size("licenses.places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"),
        F.when(F.size("licenses.places") > 0, 1.0).otherwise(best).alias("score"), F.size("licenses.matches").cast("long").alias("n_blocks"),
    )


def _template_rows() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({k}, {quoted(label)}, {quoted(text)})" for k, (label, text) in enumerate(TEMPLATES))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (
  SELECT k, label, regexp_extract_all({LOWER.format("body")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (VALUES {_template_rows()}) AS x(k, label, body)),
tw AS (SELECT k, label, unnest(list_distinct(w)) AS word, len(list_distinct(w)) AS size, greatest(8, 2 ** ceil(log2(len(w))))::BIGINT AS step FROM t),
o AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
hit AS (
  SELECT DISTINCT r, k, label, size, i // step - back AS b, word
  FROM o JOIN tw USING (word) CROSS JOIN (VALUES (0), (1)) AS x(back) WHERE i // step >= back),
block AS (SELECT r, k, label, b, count(*) / size AS share FROM hit GROUP BY r, k, label, b, size HAVING count(*) >= ceil(0.9 * size - 1e-9)),
place AS (
  SELECT r, i, 'mit' AS label FROM (SELECT r, unnest(range(len(w) - 1)) AS i, w FROM d WHERE len(w) > 1) WHERE w[i + 1] = 'mit' AND w[i + 2] = 'license'
  UNION ALL
  SELECT r, i, 'apache' FROM (SELECT r, unnest(range(len(w) - 1)) AS i, w FROM d WHERE len(w) > 1) WHERE w[i + 1] = 'apache' AND w[i + 2] = 'license'
  UNION ALL
  SELECT r, i, 'gpl' FROM (SELECT r, unnest(range(len(w) - 2)) AS i, w FROM d WHERE len(w) > 2) WHERE w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license'),
p AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM place GROUP BY r),
m AS (SELECT r, count(*) AS n, max(share) AS share FROM block GROUP BY r),
l AS (
  SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM (SELECT r, label FROM place UNION ALL SELECT r, label FROM block) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(p.n, 0) AS n_base, p.a AS first_word, p.z AS last_word, coalesce(p.labels, '') AS base_labels,
  coalesce(l.labels, '') AS labels, CASE WHEN p.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0.0)::DOUBLE END AS score, coalesce(m.n, 0) AS n_blocks
FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r) LEFT JOIN l USING (r)
"""
