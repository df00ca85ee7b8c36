"""Words cut from bytes, and counters that a task empties before they grow large."""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_bytes(keep: range, digits: bool = False) -> bytes:
    """A table for ``bytes.translate``: ASCII letters in lower case, the bytes in ``keep`` (and digits) as they are, all others a space."""
    as_is = lambda b: 97 <= b <= 122 or b in keep or (digits and 48 <= b <= 57)
    return bytes(b + 32 if 65 <= b <= 90 else b if as_is(b) else 32 for b in range(256))


#: In UTF-8 every byte of a code point beyond ASCII is 128 or more, so runs of bytes are runs of code points.
LETTERS = word_bytes(range(128, 256))
WORDS = word_bytes(range(128, 256), digits=True)


def as_bytes(name: str) -> Column:
    """A column as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


class Tally:
    """Counts by group and item. ``full`` says that the bound is reached; ``drain`` gives what is held as Arrow batches and forgets it.

    Counts add up over drains and tasks, so the bound changes memory and the number of partial rows, never a result.
    """

    def __init__(self, schema: pa.Schema, bound: int = 300_000):
        self.schema, self.bound, self.held = schema, bound, 0
        self.groups: dict[tuple, Counter] = defaultdict(Counter)

    def add(self, group: tuple, items) -> None:
        own = self.groups[group]
        before = len(own)
        own.update(items)
        self.held += len(own) - before

    @property
    def full(self) -> bool:
        return self.held >= self.bound

    def clear(self) -> None:
        self.groups.clear()
        self.held = 0

    def drain(self, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        """Batches of (*group, item, count)."""
        for group, own in self.groups.items():
            items, counts = list(own), list(own.values())
            for at in range(0, len(items), rows):
                part = items[at : at + rows]
                columns = [[g] * len(part) for g in group] + [part, counts[at : at + rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.clear()


#: What this worker has made of the last two sets or tables of numbers that were sent to it; it outlives a task.
_MADE: dict[str, dict] = {}


def _made(key: str) -> dict:
    if key not in _MADE:
        while len(_MADE) > 1:  # a task asks for two at most
            del _MADE[next(iter(_MADE))]
        _MADE[key] = {}
    return _MADE[key]


class Shipped:
    """Sets of letter-only items by group, sent to all tasks as one string of bytes a group; a worker makes the sets that it asks for."""

    def __init__(self, joined):
        self.joined, self.key = joined, uuid.uuid4().hex

    def get(self, group: bytes) -> frozenset:
        made = _made(self.key)
        if group not in made:
            made[group] = frozenset(self.joined.value.get(group, b"").split())
        return made[group]


def shipped_sets(rows: DataFrame, group: str, item: str, max_rows: int) -> Shipped | None:
    """The sets of a written table (group, item) that has at most ``max_rows`` rows, else None. The driver holds their bytes, no row objects."""
    if rows.limit(max_rows + 1).count() > max_rows:
        return None
    joined: dict[bytes, list[bytes]] = defaultdict(list)
    for batch in rows.select(group, item).toArrow().to_batches(max_chunksize=20_000):
        part: dict[bytes, list[bytes]] = defaultdict(list)
        for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part[g].append(x)
        for g, items in part.items():
            joined[g].append(b" ".join(items))
    return Shipped(rows.sparkSession.sparkContext.broadcast({g: b" ".join(parts) for g, parts in joined.items()}))


class ShippedNumbers:
    """Numbers by group and item, sent to all tasks as joined bytes, ends and numbers of each group; a worker makes the tables that it asks for."""

    def __init__(self, sent):
        self.sent, self.key = sent, uuid.uuid4().hex

    def get(self, group: bytes) -> dict[bytes, int]:
        made = _made(self.key)
        if group not in made:
            joined, ends, numbers = self.sent.value.get(group, (b"", b"", b""))
            cuts = np.frombuffer(ends, np.int64).tolist()
            items = [joined[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            made[group] = dict(zip(items, np.frombuffer(numbers, np.int64).tolist(), strict=True))
        return made[group]


def shipped_numbers(rows: DataFrame, group: str, item: str, number: str, max_rows: int) -> ShippedNumbers | None:
    """The numbers of a written table (group, item, number) that has at most ``max_rows`` rows, else None. The driver holds their bytes."""
    if rows.limit(max_rows + 1).count() > max_rows:
        return None
    parts: dict[bytes, list[tuple]] = defaultdict(list)
    for batch in rows.select(group, item, number).toArrow().to_batches(max_chunksize=20_000):
        own: dict[bytes, list[tuple]] = defaultdict(list)
        for g, x, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own[g].append((x, n))
        for g, found in own.items():
            parts[g].append((b"".join(x for x, _ in found), np.array([len(x) for x, _ in found], np.int64), np.array([n for _, n in found], np.int64)))
    sent = {g: (b"".join(p[0] for p in ps), np.cumsum(np.concatenate([p[1] for p in ps])).tobytes(), np.concatenate([p[2] for p in ps]).tobytes()) for g, ps in parts.items()}
    return ShippedNumbers(rows.sparkSession.sparkContext.broadcast(sent))
