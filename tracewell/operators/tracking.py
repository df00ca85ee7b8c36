"""Progress, retries and states of work items, as batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import elapsed_seconds
from tracewell.operators.bounded import broadcast_if_small

DONE, FAILED, PENDING, PROCESSING = "completed", "failed", "pending", "processing"


def progress(df: DataFrame, group: list[str], status: str = "status") -> DataFrame:
    """Counts by status, processed (done and failed) and percent to two places; unknown statuses count in the total only."""
    s = F.lower(status)
    rows = df.groupBy(*group).agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in (PENDING, PROCESSING, DONE, FAILED)])
    rows = rows.withColumn("processed", F.col(DONE) + F.col(FAILED))
    return rows.withColumn("percent", F.when(F.col("total") > 0, F.bround(100 * F.col("processed") / F.col("total"), 2)).otherwise(0.0))


def eta(df: DataFrame, group: list[str], status: str = "status", seconds: str = "seconds") -> DataFrame:
    """Mean seconds of completed rows times the rows that are left; null without a completed row."""
    s = F.lower(status)
    rows = df.groupBy(*group).agg(F.avg(F.when(s == DONE, F.col(seconds))).alias("mean_seconds"), F.count_if(~s.isin(DONE, FAILED)).alias("left"))
    return rows.withColumn("eta_seconds", F.round(F.col("mean_seconds") * F.col("left"), 3)).withColumn("mean_seconds", F.round("mean_seconds", 6))


def group_status(items: DataFrame, group: str, status: str = "status") -> DataFrame:
    """All pending: pending; any pending or processing: processing; else completed if any is, else failed."""
    s = F.lower(status)
    any_ = lambda x: F.coalesce(F.bool_or(s == x), F.lit(False))
    rule = (
        F.when(F.bool_and(F.coalesce(s == PENDING, F.lit(False))), PENDING).when(any_(PROCESSING) | any_(PENDING), PROCESSING)
        .when(any_(DONE), DONE).otherwise(FAILED)
    )
    return items.groupBy(group).agg(rule.alias("status"))


def recount_batches(items: DataFrame, batch: str = "batch_number", status: str = "status") -> DataFrame:
    rows = items.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(F.lower(status) == DONE).alias("done"))
    return rows.withColumn("status", F.when(F.col("done") == F.col("total"), "completed").otherwise("incomplete"))


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, which should tell all rows of a key apart."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*key, "_l.*").select(*df.columns)


def accumulate_distinct(events: DataFrame, key: str, stage: str, order: list[str]) -> DataFrame:
    """(key, stages): each stage once, in the order of its first event."""
    first = events.groupBy(key, stage).agg(F.min(F.struct(*order)).alias("_t"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", stage))), lambda x: x[stage]).alias("stages"))


def attempt_counter(verdicts: DataFrame, key: str = "key", seq: str = "seq", passed: str = "passed", max_attempts: int = 3) -> DataFrame:
    """(key, attempts, outcome): failures since the last pass, each ``seq`` once.

    CONVERGED after a pass, EXHAUSTED from ``max_attempts`` failures on, else RETRY. Rows without a number or an answer are no verdicts.
    """
    once = verdicts.filter(F.col(seq).isNotNull() & F.col(passed).isNotNull()).groupBy(key, seq).agg(F.bool_or(passed).alias("_p"))
    last = once.groupBy(key).agg(F.max(F.when(F.col("_p"), F.col(seq))).alias("_last"), F.max(seq).alias("_end"))
    rows = once.join(last, key)
    out = rows.groupBy(key, "_last", "_end").agg(F.count_if(~F.col("_p") & (F.col("_last").isNull() | (F.col(seq) > F.col("_last")))).alias("attempts"))
    outcome = F.when(F.col("_last").eqNullSafe(F.col("_end")), "CONVERGED").when(F.col("attempts") >= max_attempts, "EXHAUSTED").otherwise("RETRY")
    return out.select(key, "attempts", outcome.alias("outcome"))


def session_ends(log: DataFrame, key: str, ts: str, done: Column, mark_ms: Column, silence: float = 120.0, timeout: float = 5400.0) -> DataFrame:
    """(key, state, at_ms) of the sessions that have ended at the time ``mark_ms``, as the stream of the same meaning tells them.

    By event time: a session ends at its first marker (done), or where no event follows within ``silence`` seconds (stale) or within ``timeout``
    of its first (timeout); what comes after is not read. ``at_ms`` is the marker's time, or that of the last event before the end. A session's
    events are sorted in one task, by millisecond and summed by it before.
    """
    quiet, most = int(silence * 1000), int(timeout * 1000)
    rows = log.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms"), F.coalesce(done, F.lit(False)).alias("_d")).filter("_ms IS NOT NULL")
    rows = rows.groupBy(key, "_ms").agg(F.bool_or("_d").alias("_d")).filter(F.col("_ms") <= mark_ms)
    w = Window.partitionBy(key).orderBy("_ms")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_a", F.first("_ms").over(w)).withColumn("_late", (F.col("_ms") > F.lag("_ms").over(w) + quiet) | (F.col("_ms") > F.col("_a") + most))
    rows = rows.withColumn("_cut", F.coalesce(F.bool_or("_late").over(so_far), F.lit(False))).filter("NOT _cut")
    ends = rows.groupBy(key).agg(F.min("_ms").alias("_a"), F.max("_ms").alias("_z"), F.min(F.when(F.col("_d"), F.col("_ms"))).alias("_m"))
    old, still = F.col("_a") + most, F.col("_z") + quiet
    state = F.when(F.col("_m").isNotNull(), "done").when(F.least(old, still) > mark_ms, None).when(old <= still, "timeout").otherwise("stale")
    return ends.select(key, state.alias("state"), F.coalesce("_m", "_z").alias("at_ms")).filter("state IS NOT NULL")


def workflow_state(events: DataFrame, key: str = "key") -> DataFrame:
    """(key, current_stage, flow_mode, completed_stages, results) of events (key, stage, ts, completed, flow_mode, results map).

    The latest event by (ts, stage) gives the stage, the latest with a flow mode that isn't empty the mode; stages are listed once, by the time they were
    first completed; of each named result the latest value holds. Rows without stage or time are no events.
    """
    known = events.filter("stage IS NOT NULL AND ts IS NOT NULL")
    at = F.struct("ts", "stage")
    last = known.groupBy(key).agg(
        F.max_by("stage", at).alias("current_stage"), F.max(F.when(F.col("flow_mode") != "", F.struct("ts", "stage", "flow_mode")))["flow_mode"].alias("flow_mode")
    )
    done = accumulate_distinct(known.filter("completed"), key, "stage", ["ts"]).withColumnRenamed("stages", "completed_stages")
    values = known.select(key, "ts", "stage", F.explode("results").alias("_n", "_v")).filter("_v IS NOT NULL")
    values = values.groupBy(key, "_n").agg(F.max(F.struct("ts", "stage", "_v"))["_v"].alias("_v"))
    values = values.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_n", "_v")))).alias("results"))
    none = F.array().cast("array<string>")
    out = last.join(done, key, "left").join(values, key, "left")
    return out.select(key, "current_stage", "flow_mode", F.coalesce("completed_stages", none).alias("completed_stages"), F.coalesce("results", F.create_map().cast("map<string,string>")).alias("results"))


def next_work(df: DataFrame, group: list[str], order: list, n: int, status: str = "status") -> DataFrame:
    """The next ``n`` rows of each group: pending ones, or the ones in process if none is pending."""
    s = F.lower(status)
    rank = F.when(s == PENDING, 0).when(s == PROCESSING, 1)
    open_rows = df.withColumn("_p", rank).filter("_p IS NOT NULL")
    w = Window.partitionBy(*group)
    rows = open_rows.withColumn("_m", F.min("_p").over(w)).filter("_p = _m")
    return rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).filter(F.col("_r") <= n).drop("_p", "_m", "_r")


def since_offset(log: DataFrame, sessions: DataFrame, marker: str) -> DataFrame:
    """(session, lines, done): log lines after each session's offset, and whether the marker is among them."""
    rows = log.join(sessions.select("session", F.col("offset").alias("_o")), "session").filter("offset >= _o")
    return rows.groupBy("session").agg(F.count("*").alias("lines"), F.bool_or(F.contains("line", F.lit(marker))).alias("done"))


def iteration_history(runs: DataFrame, key: str, order: list[str], failed: Column, max_iterations: int = 3) -> DataFrame:
    """``runs`` with iteration number, whether the next run followed, and the action: stop, retry or abort."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = runs.withColumn("iteration", F.row_number().over(w)).withColumn("followed", F.lead(F.lit(True)).over(w).isNotNull())
    action = F.when(~failed, "stop").when(F.col("iteration") >= max_iterations, "abort").otherwise("retry")
    return rows.withColumn("action", action)


def stale_sessions(log: DataFrame, key: str, ts: str, done: Column, now: Column, silence: float = 120.0, timeout: float = 5400.0) -> DataFrame:
    """(key, state) at ``now``: done, timeout, stale or running, from first and last event."""
    rows = log.groupBy(key).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.bool_or(done).alias("_d"))
    state = (
        F.when(F.col("_d"), "done").when(elapsed_seconds(F.col("first"), now) > timeout, "timeout")
        .when(elapsed_seconds(F.col("last"), now) > silence, "stale").otherwise("running")
    )
    return rows.select(key, "first", "last", state.alias("state"))


def stage_gate(states: DataFrame, verdicts: DataFrame, workflow: DataFrame, key: str = "key") -> DataFrame:
    """(key, stage, decision): may the current stage be left?

    ``workflow`` (stage, pos, blocking, required, trusted_source) has one row a stage; it is handed to all tasks only if it has few. A blocking stage needs its latest verdict, of a
    trusted source, to be a pass; required earlier stages must be complete.
    """
    last = latest_per_key(verdicts.select(key, "stage", "seq", "passed", "source"), [key, "stage"], ["seq"])
    flow = broadcast_if_small(workflow, 10_000)
    rows = states.select(key, F.col("current_stage").alias("stage"), "completed_stages").join(flow, "stage", "left").join(last, [key, "stage"], "left")
    needed = workflow.filter("required").agg(F.collect_list(F.struct("pos", F.col("stage").alias("s"))).alias("_need"))
    rows = rows.join(F.broadcast(needed), F.lit(True))
    open_ = F.exists("_need", lambda x: (x["pos"] < F.col("pos")) & ~F.array_contains("completed_stages", x["s"]))
    decision = (
        F.when(F.col("pos").isNull(), "unknown stage").when(open_, "earlier stage open")
        .when(F.col("blocking") & F.col("passed").isNull(), "no verdict")
        .when(F.col("blocking") & ~F.col("source").eqNullSafe(F.col("trusted_source")), "untrusted verdict")
        .when(F.col("blocking") & ~F.col("passed"), "failed").otherwise("advance")
    )
    return rows.select(key, "stage", decision.alias("decision"))
