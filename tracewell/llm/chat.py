"""Chat formatting by incremental black-box rendering.

The template is a function from a list of turns to text. Successive prefixes of a conversation
are rendered and consecutive outputs compared: what the longer one adds is the new turn's span.
A template that changes earlier text is found out, because the shorter output is then no prefix
of the longer one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.batches import bound_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The control strings of the default template.
HEAD, TAIL = "### ", "</turn>"
SPECIAL = ("#", TAIL)
ROLE_SPECIAL = (*SPECIAL, ":")


def escape(text: str, special: tuple[str, ...] = SPECIAL) -> str:
    r"""A backslash before each backslash and control string; ``unescape`` undoes it. Memory stays in proportion to the text.

    >>> escape("### a") == "\\#\\#\\# a"
    True
    """
    for s in ("\\", *special):
        text = text.replace(s, "\\" + s)
    return text


def unescape(text: str, special: tuple[str, ...] = SPECIAL) -> str:
    """Each control string of an escaped text has its own backslash; what is left are pairs of backslashes."""
    for s in (*special, "\\"):
        text = text.replace("\\" + s, s)
    return text


def find_bare(text: str, what: str, at: int) -> int:
    """Where ``what`` first stands from ``at`` on without its own backslash, or -1: after an even number of them."""
    while (found := text.find(what, at)) >= 0:
        width = 64  # a run of backslashes is measured in slices that grow, never character by character
        while (run := text[max(0, found - width) : found]) and not run.rstrip("\\") and width < found:
            width *= 8
        if (len(run) - len(run.rstrip("\\"))) % 2 == 0:
            return found
        at = found + 1
    return -1


def marked_turns(turns: list[Turn]) -> str:
    """The default template: ``### role: text</turn>`` and a line end for each turn."""
    return "".join(f"{HEAD}{escape(role, ROLE_SPECIAL)}: {escape(text)}{TAIL}\n" for role, text in turns)


def render_spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]], bool]:
    """(whole output, each turn's span, whether history was rewritten).

    Where an output does not extend the one before, the turn's span starts at their first
    difference; the spans then overlap and the flag is set.
    """
    before, spans, rewritten = template([]), [], False
    for n in range(1, len(turns) + 1):
        now = template(turns[:n])
        start = len(before)
        if not now.startswith(before):
            rewritten = True
            start = next((i for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
        spans.append((start, len(now)))
        before = now
    return before, spans, rewritten


def turn_at(text: str, at: int) -> tuple[int, int, int] | None:
    """(start and end of the escaped text, end of the turn) of the default template's turn at ``at``; None if there is none."""
    if not text.startswith(HEAD, at) or (colon := find_bare(text, ": ", at + len(HEAD))) < 0:
        return None
    end = find_bare(text, TAIL, colon + 2)
    return (colon + 2, end, end + len(TAIL) + 1) if end >= 0 and text.startswith("\n", end + len(TAIL)) else None


def text_span(rendered: str) -> tuple[int, int]:
    """Where the escaped text lies in one rendered turn of the default template; all of it if this is no such turn."""
    found = turn_at(rendered, 0)
    return found[:2] if found and found[2] == len(rendered) else (0, len(rendered))


FORMATTED = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("n_turns", T.LongType()),
    T.StructField("formatted", T.StringType()),
    T.StructField("turn_spans", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()),
    ]))),
    T.StructField("rewrites_history", T.BooleanType()),
])


def _conversations(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations of sorted rows; one at a time is held, whatever the batches."""
    now, turns = None, []
    for pdf in parts:
        for conv, role, text in zip(pdf["_conv"], pdf["_role"], pdf["_text"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if turns and conv != now:
                yield now, turns
                turns = []
            now = conv
            turns.append((role, text))
    if turns:
        yield now, turns


def format_chats(
    rows: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",),
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    text_at: Callable[[str], tuple[int, int]] = text_span,
) -> DataFrame:
    """One row a conversation: its formatted text, each turn's span with the span under the loss mask,
    and whether the template rewrote history.

    Turns are put in order by number (null first), then role, then text, so ties and repeated rows
    have a fixed order and all count as turns. A null text or role is empty; rows without a
    conversation id form one conversation with a null id. The mask covers the texts of
    ``loss_roles`` as ``text_at`` finds them in a turn's span. Rows move once, by conversation, and are sorted
    there; a task holds one conversation at a time, whose prefixes cost the square of its turns. Memory is a few times the
    longest conversation, whatever it escapes.
    """
    masked = frozenset(loss_roles)
    bound_batches(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, chars = [], 0
        for conv_id, turns in _conversations(parts):
            whole, spans, rewritten = render_spans(turns, template)
            found = []
            for (who, _), (start, end) in zip(turns, spans, strict=True):
                a, b = text_at(whole[start:end]) if who in masked else (0, 0)
                found.append({"role": who, "start": start, "end": end, "loss_start": start + a, "loss_end": start + b})
            out.append((conv_id, len(turns), whole, found, rewritten))
            chars += len(whole)
            if len(out) >= 500 or chars > 4_000_000:  # one batch never holds many long conversations
                yield _frame(out)
                out, chars = [], 0
        yield _frame(out)

    def _frame(out: list) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=FORMATTED.names)
        pdf["conv_id"] = pdf["conv_id"].astype("Int64")
        return pdf

    ordered = rows.select(
        F.col(conv).cast("long").alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    return ordered.mapInPandas(run, FORMATTED)


def read_turns(formatted: str) -> Iterator[Turn]:
    """The turns of a text that ``marked_turns`` made, one after the other; anything else is an error. Linear in the text, escapes included."""
    at = 0
    while at < len(formatted):
        if (found := turn_at(formatted, at)) is None:
            raise ValueError(f"no turn at character {at}")
        start, end, after = found
        yield unescape(formatted[at + len(HEAD) : start - 2], ROLE_SPECIAL), unescape(formatted[start:end])
        at = after


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted text and mask."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for conv_id, whole, spans, rewritten in zip(
                pdf["conv_id"], pdf["formatted"], pdf["turn_spans"], pdf["rewrites_history"], strict=True
            ):
                every, loss, chars, n = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, text in read_turns(whole):
                    n += 1
                    every.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    text = unescape(whole[s["loss_start"] : s["loss_end"]])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    chars += len(text)
                out.append((conv_id, n, every.hexdigest(), chars, loss.hexdigest(), len(whole), rewritten))
            pdf = pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")])
            pdf["conv_id"] = pdf["conv_id"].astype("Int64")
            yield pdf

    return formatted.mapInPandas(run, DIGESTS)


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    from tracewell.sources.tables import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"),
    )
    return chat_digests(format_chats(rows.unionByName(extra)))


OP8_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '\</turn>'), ':', '\:'))
          + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>')) + 14 AS n FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, false AS rewrites_history
FROM e GROUP BY conv_id
"""
