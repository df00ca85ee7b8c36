"""Event folds as Structured Streaming jobs. Each has the batch operator of the same meaning in ``operators.tracking``."""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracewell.operators.catalog import valid_updates
from tracewell.operators.chunking import sliding_chunks
from tracewell.operators.search import build_index
from tracewell.operators.tracking import latest_per_key, stage_gate
from tracewell.sources.io import VectorStore
from tracewell.sources.shared import drop_path, write_shared


class KeyedTable:
    """A Parquet table of the latest row a key, in ``buckets`` parts by the hash of the key.

    A merge writes the parts that its rows touch anew, below a name of their own, and then one pointer in a folder of its own
    that names the current file of each part and the last batch of each source (a stream's checkpoint); what no pointer names is not
    there. So a reader, or a driver that starts again on the same path, finds the last whole merge, and with a batch number a merge
    that was done before is left out: a batch that runs again changes nothing. The last pointer is all that is needed: older ones than the one
    before it, and parts that those named alone, are deleted, so reading costs the same after any number of merges. One writer at a time.
    """

    POINTER = "batches map<string,long>, parts map<int,string>, kind string, no long"

    def __init__(self, spark, path: str, key: list[str], order: list[str], buckets: int = 16):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _pointers(self) -> list:
        """Pointers, the newest first: two, or three after a merge that stopped half way."""
        try:
            rows = self.spark.read.schema(self.POINTER).option("basePath", f"{self.path}/pointers").parquet(f"{self.path}/pointers")
        except Exception as e:  # nothing merged yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return rows.orderBy(F.desc("no")).collect()

    def _current(self):
        return next(iter(self._pointers()), None)

    def read(self) -> DataFrame | None:
        now = self._current()
        return self._read(now.kind, now.parts.values()) if now else None

    def _read(self, kind: str, paths) -> DataFrame:
        return self.spark.read.schema(kind).parquet(*sorted(paths))

    def merge(self, rows: DataFrame, batch: int | None = None, source: str = "") -> None:
        held = self._pointers()
        now = held[0] if held else None
        batches = dict(now.batches) if now else {}
        if batch is not None and batches.get(source, -1) >= batch:
            return
        part = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows = write_shared(rows.withColumn("_part", part), "merge-rows")
        touched = [r[0] for r in rows.select("_part").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        old = dict(now.parts) if now else {}
        plain = rows.drop("_part")
        own = [old[p] for p in touched if p in old]
        both = plain.unionByName(self._read(now.kind, own).select(*plain.columns)) if own else plain
        version = f"{self.path}/v-{uuid.uuid4().hex}"
        latest_per_key(both, self.key, self.order).withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(version)
        parts = old | {p: f"{version}/_part={p}" for p in touched}
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
        batches |= {source: batch} if batch is not None else {}
        pointer = self.spark.createDataFrame([(batches, parts, kind)], self.POINTER.removesuffix(", no long"))
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointers/no={(now.no if now else 0) + 1}")
        for gone in held[1:]:  # a reader may still hold the pointer before this one
            for path in set(gone.parts.values()) - set(old.values()):
                drop_path(self.spark, path)
            drop_path(self.spark, f"{self.path}/pointers/no={gone.no}")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there now, batch by batch, and stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def status_stream(updates: DataFrame, items: DataFrame, table: KeyedTable, rejects: Callable[[DataFrame], None], checkpoint: str, statuses: tuple[str, ...]) -> StreamingQuery:
    """Validate updates and keep each item's latest status. A batch that runs again changes nothing; ``rejects`` may see it twice."""

    def each(batch: DataFrame, number: int) -> None:
        checked = write_shared(valid_updates(batch, items, statuses=statuses), "checked-updates")
        table.merge(checked.filter("error IS NULL").drop("error"), number, checkpoint)
        rejects(checked.filter("error IS NOT NULL"))

    return run_once(updates, each, checkpoint)


class _StatusDelta(StatefulProcessor):
    """Emit -1 for the status an item leaves and +1 for the one it takes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string, ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, ts = self.state.get() if self.state.exists() else (None, None)
        new = max(max(zip(pdf["ts"], pdf["status"], strict=True)) for pdf in rows)
        if status is not None and (ts, status) >= new:
            return
        # the time is kept even where the status stays: an older row must not win later
        self.state.update((new[1], int(new[0])))
        if new[1] != status:
            out = [(new[1], 1)] + ([(status, -1)] if status is not None else [])
            yield pd.DataFrame(out, columns=["status", "delta"])

    def close(self) -> None:
        pass


def progress_stream(updates: DataFrame) -> DataFrame:
    """(status, delta) stream of (item_id, status, ts long); summed by status it is the live progress.

    The largest (ts, status) of an item holds, in whatever order rows and batches come: the sums are those of ``latest_per_key``
    by time and status. Rows without a time or a status are no updates.
    """
    known = updates.filter("ts IS NOT NULL AND status IS NOT NULL")
    return known.groupBy("item_id").transformWithStateInPandas(_StatusDelta(), "status string, delta long", "Append", "None")


def _packed(numbers: Iterable[int]) -> bytes:
    """Whole numbers as eight bytes each: a list in one value of state costs one call, where entries of a map cost one or two each."""
    return array("q", numbers).tobytes()


def _unpacked(raw: bytes | None) -> list[int]:
    return array("q", bytes(raw or b"")).tolist()


class _Attempts(StatefulProcessor):
    """Failures since the last pass, by verdict number: the failed numbers behind the last number that passed, in one value of state."""

    def __init__(self, most: int, ttl_ms: int | None):
        self.most, self.ttl = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("verdicts", "last_pass long, seq long, failed binary", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, seq, failed = self.state.get() or (None, None, None)
        new = set(_unpacked(failed))
        for r in rows:
            seq = r.seq if seq is None else max(seq, r.seq)
            if r.passed:
                best = r.seq if best is None else max(best, r.seq)
            elif best is None or r.seq > best:
                new.add(r.seq)
        held = sorted(s for s in new if best is None or s > best)
        self.state.update((best, seq, _packed(held)))
        outcome = "CONVERGED" if not held else "EXHAUSTED" if len(held) >= self.most else "RETRY"
        yield Row(key=key[0], seq=seq, attempts=len(held), outcome=outcome)

    def close(self) -> None:
        pass


def retry_controller(verdicts: DataFrame, max_attempts: int = 3, key_type: str = "string", ttl_ms: int | None = None) -> DataFrame:
    """(key, seq, attempts, outcome) of each key with verdicts (key, seq long, passed) in a batch, as ``attempt_counter`` of all so far.

    Numbers may come in any order and again: a failure that arrives after a later one counts, one before the last pass never does. State
    is one number a failure since the last pass, read and written once a batch. With ``ttl_ms`` a key without verdicts for so long (by the clock) starts anew;
    without it state stays. A stream with a time to live wakes up by the clock: start it with a processing-time trigger, not with available-now.
    """
    schema = f"key {key_type}, seq long, attempts long, outcome string"
    known = verdicts.filter("seq IS NOT NULL AND passed IS NOT NULL")
    return known.groupBy("key").transformWithState(_Attempts(max_attempts, ttl_ms), schema, "Update", "ProcessingTime" if ttl_ms else "None")


class _Silence(StatefulProcessor):
    """A session ends by a marker, by silence or by its age; one row when it does. Events are folded by their time, once the watermark has passed it."""

    def __init__(self, silence_ms: int, timeout_ms: int):
        self.silence, self.timeout = silence_ms, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # waiting events are 2 * ms + done; the timer that is set is kept, so that timers are never listed
        self.state = handle.getValueState("session", "first long, last long, closed boolean, timer long, waiting binary")

    def _fold(self, key, mark: int, first: int | None, last: int | None, timer: int | None, waiting: list[tuple[int, bool]]) -> Iterator[Row]:
        """What is certain at the watermark: no event before it can still come."""
        ended, at = None, 0
        while at < len(waiting) and waiting[at][0] <= mark and ended is None:
            ms, done = waiting[at]
            if first is not None and ms > min(last + self.silence, first + self.timeout):
                break
            first, last = ms if first is None else first, ms
            ended, at = "done" if done else None, at + 1
        due = None if first is None else min(last + self.silence, first + self.timeout)
        if ended is None and due is not None and due <= mark:
            ended = "timeout" if first + self.timeout <= last + self.silence else "stale"
        rest = [] if ended else waiting[at:]
        wanted = None if ended else min(x for x in (due, *(ms for ms, _ in rest[:1])) if x is not None)
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is not None and timer != wanted:
            self.handle.registerTimer(wanted)
        self.state.update((first, last, ended is not None, wanted, _packed(2 * ms + done for ms, done in rest)))
        if ended:
            yield Row(session=key[0], state=ended, at_ms=last)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, last, closed, timer, raw = self.state.get() or (None, None, False, None, None)
        if closed:
            for _ in rows:  # not read
                pass
            return
        waiting = {x >> 1: bool(x & 1) for x in _unpacked(raw)}
        for r in rows:
            waiting[r.ms] = bool(r.done) or waiting.get(r.ms, False)
        yield from self._fold(key, timerValues.getCurrentWatermarkInMs(), first, last, timer, sorted(waiting.items()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, closed, timer, raw = self.state.get()
        if not closed:
            if timer == expiredTimerInfo.getExpiryTimeInMs():  # Spark deletes it itself
                timer = None
            yield from self._fold(key, timerValues.getCurrentWatermarkInMs(), first, last, timer, [(x >> 1, bool(x & 1)) for x in _unpacked(raw)])

    def close(self) -> None:
        pass


def stale_session_stream(events: DataFrame, silence: int = 120, timeout: int = 5400, late: str = "10 seconds", key_type: str = "string") -> DataFrame:
    """(session, state, at_ms) of (session, ts timestamp, done boolean), once a session, by event time.

    A session ends at its first marker, else at the first silence, else by its age (``tracking.session_ends``); what comes after its end is
    not read. Events may come in any order within ``late``: they wait until the watermark has passed them, so the result does not
    depend on how events fall into batches. Older ones are dropped by the watermark: ``route_late`` keeps them in a table.
    """
    marked = events.filter("ts IS NOT NULL").withWatermark("ts", late).select("session", "ts", F.unix_millis("ts").alias("ms"), "done")
    schema = f"session {key_type}, state string, at_ms long"
    return marked.groupBy("session").transformWithState(_Silence(silence * 1000, timeout * 1000), schema, "Append", "EventTime")


class _Workflow(StatefulProcessor):
    """Fold stage events into current stage, flow mode, completed stages and results: each by event time, whatever the order of arrival."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, as each output has all of it: {"now": [ts, stage], "mode": [ts, stage, mode], "done": {stage: [ts]}, "results": {name: [ts, stage, value]}}; each
        # entry ends with the time at which it was written
        self.state = handle.getValueState("workflow", "said string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        kept = self.state.get()
        held = json.loads(kept[0]) if kept else {}
        fresh = lambda e: e is not None and (not self.ttl or e[-1] + self.ttl > clock)
        last, moded = (tuple(held[x][:-1]) if fresh(held.get(x)) else None for x in ("now", "mode"))
        done, results = ({k: e for k, e in held.get(x, {}).items() if fresh(e)} for x in ("done", "results"))
        for e in rows:
            at = (e.ts, e.stage)
            last = max(last or at, at)
            if e.completed and (e.stage not in done or e.ts < done[e.stage][0]):
                done[e.stage] = [e.ts, clock]
            if e.flow_mode:
                moded = max(moded or (*at, e.flow_mode), (*at, e.flow_mode))
            for name, value in _items(e.results):
                if name not in results or (*at, value) > tuple(results[name][:-1]):
                    results[name] = [*at, value, clock]
        self.state.update((json.dumps({"now": [*last, clock], "mode": [*moded, clock] if moded else None, "done": done, "results": results}),))
        stages = [s for _, s in sorted((t[0], s) for s, t in done.items())]
        said = [(name, results[name][2]) for name in sorted(results)]
        yield Row(key=key[0], current_stage=last[1], flow_mode=moded[2] if moded else None, completed_stages=stages, results=said)

    def close(self) -> None:
        pass


def _items(found) -> list[tuple[str, str]]:
    """Entries of a map as Arrow hands it over, without null values."""
    pairs = found.items() if isinstance(found, dict) else found if isinstance(found, (list, tuple)) else ()
    return [(k, v) for k, v in pairs if v is not None]


def workflow_state(events: DataFrame, key_type: str = "string", ttl_ms: int | None = None) -> DataFrame:
    """State of each key with events in a batch: (key, current_stage, flow_mode, completed_stages, results), as ``tracking.workflow_state`` of all so far.

    Events (key, stage, ts long, completed, flow_mode; results map<string,string> if there is such a column) may come in any order and again.
    Rows without stage or time are no events. With ``ttl_ms`` what is not written for so long (by the clock) is forgotten;
    start such a stream with a processing-time trigger.
    """
    schema = f"key {key_type}, current_stage string, flow_mode string, completed_stages array<string>, results map<string,string>"
    results = F.col("results") if "results" in events.columns else F.lit(None)
    known = events.filter("stage IS NOT NULL AND ts IS NOT NULL").select("key", "stage", "ts", "completed", "flow_mode", results.cast("map<string,string>").alias("results"))
    return known.groupBy("key").transformWithState(_Workflow(ttl_ms), schema, "Update", "ProcessingTime" if ttl_ms else "None")


def stage_gate_stream(states: DataFrame, verdicts: DataFrame, workflow: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Decide for each batch of workflow states whether their stage may be left; verdicts and workflow are read anew for each batch."""
    return run_once(states, lambda batch, _: sink(stage_gate(batch, verdicts, workflow)), checkpoint)


def index_stream(documents: DataFrame, store: VectorStore, checkpoint: str, **chunking) -> StreamingQuery:
    """New documents are cut into chunks, and chunks with an unseen text are embedded and stored."""
    return run_once(documents, lambda batch, _: build_index(sliding_chunks(batch, **chunking), store, text="chunk").collect(), checkpoint)


def run_log_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only log; the checkpoint is the reader's offset, so no event is written twice."""
    query = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(events: DataFrame, watermark: str, ts: str = "ts") -> DataFrame:
    """Rows of a batch older than a given time, for the side table of late events."""
    return events.filter(F.col(ts) < F.lit(watermark).cast("timestamp"))


def route_late(events: DataFrame, on_time: str, late: str, delay: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Split a stream by event time: rows older than the watermark go to the table ``late``, the others to ``on_time``.

    The watermark of a batch is the latest event time of all batches before it less ``delay``, so nothing of the first batch is late and
    rows of one batch are not late to each other. It is written down with the batch, below the checkpoint; each batch has a folder of its own
    (``batch=n``) in all three tables and is overwritten if it runs again: no row is lost or doubled. A stateful job then reads
    ``on_time`` as its stream, and what came too late for it is in a table and can be counted or replayed. Rows without a time are late.
    """
    spark, marks = events.sparkSession, f"{checkpoint.rstrip('/')}-marks"
    kind = "newest timestamp, batch long"

    def each(batch: DataFrame, number: int) -> None:
        try:
            before = spark.read.schema(kind).option("basePath", marks).parquet(marks).filter(F.col("batch") < number)
            newest = before.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).cast("string")).first()[0]
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            newest = None
        rows = write_shared(batch, "timed-rows")
        old = late_rows(rows, newest, ts) if newest else rows.limit(0)
        behind = F.col(ts).isNull() | ((F.col(ts) < F.lit(newest).cast("timestamp")) if newest else F.lit(False))
        old.unionByName(rows.filter(F.col(ts).isNull())).write.mode("overwrite").parquet(f"{late}/batch={number}")
        rows.filter(~behind).write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        mark = rows.agg(F.max(F.col(ts).cast("timestamp")).alias("newest"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    return run_once(events, each, checkpoint)
