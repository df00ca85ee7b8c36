"""Headings, windows and chunks of Markdown documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.batches import bound_batches


def sliding_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 64, min_len: int = 40) -> DataFrame:
    """(key, chunk_no, start, chunk): windows of ``size`` characters, each ``size - overlap`` after the last.

    The first window that reaches the end is the last; shorter ones than ``min_len`` are dropped. No shuffle.
    """
    step = max(1, size - overlap)
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(step * F.ceil((n - size) / step)).cast("int")
    rows = docs.filter(n > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"))
    cut = F.substring(F.col("_t"), F.col("start") + 1, F.lit(size))
    return rows.select(key, (F.col("start") / step).cast("int").alias("chunk_no"), "start", cut.alias("chunk")).filter(F.length("chunk") >= min_len)


FRONT = re.compile(r"\A---\r?\n.*?\r?\n---(?:\r?\n|\Z)", re.DOTALL)
HEADING = re.compile(r"(#{1,6})\s+(.*)")


def split_at_headings(text: str) -> list[tuple[list[str], str]]:
    """(titles of the open headings, text below) of each heading in turn; one pass over the lines."""
    out, stack, lines = [], [], []
    opened = False
    for line in re.split(r"\r?\n", FRONT.sub("", text, count=1)):
        if line.startswith("#") and (found := HEADING.fullmatch(line)):
            if opened:
                out.append(([title for _, title in stack], "\n".join(lines)))
            level = len(found[1])
            stack = [(n, title) for n, title in stack if n < level] + [(level, found[2].strip())]
            lines = []
        else:
            lines.append(line)
        opened = True
    out.append(([title for _, title in stack], "\n".join(lines)))
    return out


PAIR = re.compile(r"([^\s:#\-\[{\"'][^:]*?|\"[^\"]*\"|'[^']*')\s*:(?:\s+(.*))?")


def _plain(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def nested_block(lines: list[str]) -> dict | list | str | None:
    """Maps, lists and texts of an indented block: ``key: value``, ``key:`` above deeper lines, ``- item`` and ``- key: value``.

    One pass with a stack of the open maps and lists. All scalars stay texts, without surrounding quotes; of repeated keys the last holds; a key with nothing
    below it is an empty text. Empty lines, comments and lines that fit nowhere are left out.
    """
    root: dict = {}
    stack: list[tuple[int, object, object]] = [(-1, {None: root}, None)]  # indent, container, the key under which deeper lines go

    def below(indent: int, kind: type):
        """The open container of this indent, made under the key that waits for it."""
        while stack[-1][0] > indent or (len(stack) > 1 and stack[-1][0] == stack[-2][0] == indent and not isinstance(stack[-1][1], kind)):
            stack.pop()
        depth, box, key = stack[-1]
        if depth == indent and isinstance(box, kind):
            return box
        # a list may stand at its key's own indent
        if (depth == indent and not (kind is list and isinstance(box, dict) and box.get(key) == "")) or (key is None and len(stack) > 1):
            return None
        made = box[key]
        if not isinstance(made, kind):
            if made not in ("", root) or (made is root and root):
                return None
            made = box[key] = kind()
        stack.append((indent, made, None))
        return made

    for line in lines:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        while text.startswith("- ") or text == "-":
            box = below(indent, list)
            if box is None:
                text = ""
                break
            rest = text[1:].lstrip(" ")
            box.append(_plain(rest))
            stack[-1] = (indent, box, len(box) - 1)
            if not PAIR.fullmatch(rest) and not rest.startswith("- "):
                text = ""
                break
            box[-1] = ""
            indent, text = indent + len(text) - len(rest), rest
        if text and (found := PAIR.fullmatch(text)) and (box := below(indent, dict)) is not None:
            key = _plain(found[1])
            box[key] = _plain(found[2] or "")
            stack[-1] = (indent, box, key)
    return stack[0][1][None]


def nested_front_matter(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, front variant): the front matter of each text with its lists and maps as they are nested; an empty map without one (``nested_block``)."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = [FRONT.match(t or "") for t in texts]
            yield pd.Series([json.dumps(nested_block(re.split(r"\r?\n", m[0])[1:-1]) if m else {}, ensure_ascii=False) for m in found], dtype=object)

    return docs.select(key, F.try_parse_json(parsed(F.col(text).cast("string"))).alias("front"))


def _windows(text: str, size: int, overlap: int) -> list[str]:
    step = max(1, size - overlap)
    last = step * -(-(len(text) - size) // step) if len(text) > size else 0
    return [text[i : i + size] for i in range(0, last + 1, step)]


def chunk_text(text: str, size: int, overlap: int, min_len: int) -> list[tuple[str, str, str]]:
    """(breadcrumb, location, chunk) of one document; see ``chunk_documents``."""
    found = split_at_headings(text)
    headed = any(crumb for crumb, _ in found)
    sections = [(" > ".join(crumb), body.strip()) for crumb, body in found]
    groups: list[tuple[str, str, bool]] = []  # breadcrumb, text, may it be cut into windows?
    waiting, wait_crumb, last_crumb = [], "", ""
    for crumb, body in sections:
        if not body:
            continue
        if not headed:
            groups.append(("", body, True))
        elif len(body) >= min_len:
            groups.append((crumb or wait_crumb, "\n".join([*waiting, body]), True))
            waiting, wait_crumb = [], ""
        else:
            waiting.append(body)
            wait_crumb, last_crumb = crumb or wait_crumb, crumb
    if waiting:
        groups.append((last_crumb, "\n".join(waiting), False))
    out: list[tuple[str, str, str]] = []
    for crumb, full, free in groups:
        cut = free and len(full) > size
        number = 0
        for raw in _windows(full, size, overlap) if cut else [full]:
            piece = raw.strip()
            if not piece or (len(raw) < min_len and (cut or (free and not crumb))):
                continue
            place = f"{crumb.replace(' > ', '/') or 'root'}[{number if cut else len(out)}]"
            out.append((crumb, place, f"{crumb}\n{piece}" if crumb else piece))
            number += 1
    return out


def _each(docs: DataFrame, key: str, text: str, kind: str, use) -> DataFrame:
    """(key, pos, item): ``use`` of each text, spread out. No shuffle: a document is one row of one Arrow batch."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(f"array<{kind}>")
    def items(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([use(t or "") for t in texts], dtype=object)

    return docs.select(key, items(F.col(text).cast("string")).alias("_items")).select(key, F.posexplode("_items").alias("_pos", "_s"))


def heading_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_no, breadcrumb array, body): text below each heading with the titles above it.

    Headings inside code fences count. Text before the first heading has an empty breadcrumb; a null text is an empty one, which is
    one section. Documents are the unit of parallelism and are read once, in time that grows with their length; no shuffle.
    """

    def use(t: str) -> list[dict]:
        return [{"crumb": crumb, "body": body} for crumb, body in split_at_headings(t)]

    rows = _each(docs, key, text, "struct<crumb:array<string>,body:string>", use)
    return rows.select(key, F.col("_pos").alias("section_no"), F.col("_s.crumb").alias("breadcrumb"), F.col("_s.body").alias("body"))


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 64, min_len: int = 40) -> DataFrame:
    """(key, chunk_no, breadcrumb, location, chunk): heading-aware chunks.

    Bodies shorter than ``min_len`` wait and join the next long enough one, under its breadcrumb; what waits
    at the end is a chunk of its own. Longer ones than ``size`` become windows, whose own shortest are dropped.
    Documents without a heading are windows. The location holds the window number, which restarts; chunk_no does not.
    Every row is a document of its own, also where keys repeat; a null or empty text has no chunk. No shuffle.
    """

    def use(t: str) -> list[dict]:
        return [{"breadcrumb": crumb, "location": place, "chunk": chunk} for crumb, place, chunk in chunk_text(t, size, overlap, min_len)]

    rows = _each(docs, key, text, "struct<breadcrumb:string,location:string,chunk:string>", use)
    return rows.select(key, F.col("_pos").alias("chunk_no"), "_s.breadcrumb", "_s.location", "_s.chunk")
