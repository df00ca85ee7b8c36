"""Streams give what the batch operators give on the same events."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import tracking
from tracewell.sources.io import VectorStore
from tracewell.streaming import jobs


@pytest.fixture
def feed(spark, tmp_path):
    """A file stream of a table dealt over several files, read one file a batch."""

    def make(df, parts=3):
        path = str(tmp_path / f"in{random.random()}")
        if isinstance(parts, list):  # rows of each file, in the order in which they come
            for rows in parts:
                spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(path)
        else:
            df.repartition(parts).write.parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def drain(df, mode, tmp_path):
    out = []
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = df.writeStream.foreachBatch(lambda b, n: out.extend((n, r) for r in b.collect())).outputMode(mode)
    q = q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_status_table_is_the_latest_row(spark, feed, tmp_path):
    rng = random.Random(1)
    data = [(rng.randint(0, 9), rng.choice(["pending", "completed", "odd"]), i) for i in range(80)] + [(99, "pending", 1), (None, "pending", 2)]
    df = spark.createDataFrame(data, "item_id long, status string, ts long")
    table = jobs.KeyedTable(spark, str(tmp_path / "table"), ["item_id"], ["ts", "status"])
    bad = []
    items = spark.range(10).withColumnRenamed("id", "item_id")
    jobs.status_stream(feed(df), items, table, lambda b: bad.extend(b.collect()), str(tmp_path / "cp"), ("pending", "completed"))
    good = df.filter("status <> 'odd' AND item_id < 10")
    want = tracking.latest_per_key(good, ["item_id"], ["ts", "status"])
    assert sorted(map(tuple, table.read().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert len(bad) == df.count() - good.count()


def test_keyed_table_outlives_its_driver(spark, tmp_path):
    """A second object on the path goes on where the first stopped; batches that run again, or stop half way, change nothing."""
    kind = "k long, v string, ts long"
    make = lambda *rows: spark.createDataFrame(list(rows), kind)
    table = lambda: jobs.KeyedTable(spark, str(tmp_path / "keyed"), ["k"], ["ts", "v"], buckets=4)
    assert table().read() is None
    table().merge(make((1, "a", 1), (2, "a", 1), (3, "a", 1)), 0, "s")
    table().merge(make((1, "b", 2)), 1, "s")
    parts = dict(table()._current().parts)
    table().merge(make((1, "again", 9)), 1, "s")  # the stream's driver died before it wrote down that batch 1 was done
    table().merge(make((2, "c", 0), (4, "d", 1)), 2, "s")
    table().merge(make((5, "e", 1)), 0, "another stream")
    assert sorted(map(tuple, table().read().collect())) == [(1, "b", 2), (2, "a", 1), (3, "a", 1), (4, "d", 1), (5, "e", 1)]
    # only parts with new rows were written anew
    touched = {r[0] for r in make((2, "", 0), (4, "", 0), (5, "", 0)).selectExpr("cast(pmod(xxhash64(k), 4) as int)").collect()}
    now = table()._current().parts
    assert all(now[p] == parts[p] for p in parts if p not in touched) and all(now[p] != parts.get(p) for p in touched)
    # a merge that never came to its pointer row is not there
    spark.createDataFrame([(1, "half", 99)], kind).write.parquet(str(tmp_path / "keyed" / "v-half" / "_part=0"))
    assert table().read().filter("v = 'half'").count() == 0
    table().merge(make().limit(0), 3, "s")
    assert table().read().count() == 5


def dealt(rows, files, seed):
    """The rows in ``files`` lists, in a random order of rows and lists."""
    rng = random.Random(seed)
    rows = rng.sample(rows, len(rows))
    return [part for part in (rows[i::files] for i in range(files)) if part]


@pytest.mark.parametrize(("files", "seed"), [(1, 0), (3, 1), (3, 2), (7, 3), (7, 4)])
def test_folds_equal_their_batch_operators_in_any_order(spark, feed, tmp_path, files, seed):
    rng = random.Random(seed)
    verdicts = [(rng.randint(0, 5), rng.randint(-3, 40), rng.random() < 0.1) for _ in range(150)] + [(0, None, True), (1, 4, None)]
    df = spark.createDataFrame(verdicts, "key long, seq long, passed boolean")
    got = {}
    for n, r in drain(jobs.retry_controller(feed(df, dealt(verdicts, files, seed)), key_type="long"), "update", tmp_path / "a"):
        got[r["key"]] = max(got.get(r["key"], (-1,)), (n, r["attempts"], r["outcome"]))
    assert {k: v[1:] for k, v in got.items()} == {r["key"]: (r["attempts"], r["outcome"]) for r in tracking.attempt_counter(df).collect()}

    updates = [(rng.randint(0, 9), rng.choice(["pending", "completed", "failed"]), rng.randint(0, 12)) for _ in range(80)] + [(3, None, 99), (3, "odd", None)]
    df = spark.createDataFrame(updates, "item_id long, status string, ts long")
    got = {}
    for _, r in drain(jobs.progress_stream(feed(df, dealt(updates, files, seed))), "append", tmp_path / "b"):
        got[r["status"]] = got.get(r["status"], 0) + r["delta"]
    want = tracking.latest_per_key(df.dropna(), ["item_id"], ["ts", "status"]).groupBy("status").count().collect()
    assert {k: v for k, v in got.items() if v} == {r["status"]: r["count"] for r in want}

    named = lambda: {rng.choice("xyz"): rng.choice(["1", "2", None]) for _ in range(rng.randint(0, 2))} if rng.random() < 0.7 else None
    events = [(rng.randint(0, 3), rng.choice("abcdef"), rng.randint(0, 15), rng.random() < 0.5, rng.choice([None, "", "fast", "full"]), named()) for _ in range(70)]
    events += [(1, None, 5, True, "fast", None), (1, "g", None, True, "fast", None)]
    df = spark.createDataFrame(events, "key long, stage string, ts long, completed boolean, flow_mode string, results map<string,string>")
    got = {}
    for n, r in drain(jobs.workflow_state(feed(df, dealt(events, files, seed)), key_type="long"), "update", tmp_path / "c"):
        if n >= got.get(r["key"], (-1,))[0]:
            got[r["key"]] = (n, r["current_stage"], r["flow_mode"], r["completed_stages"], r["results"])
    want = {r["key"]: tuple(r)[1:] for r in tracking.workflow_state(df).collect()}
    assert {k: v[1:] for k, v in got.items()} == want


def test_attempts_count_a_failure_that_comes_after_a_later_one(spark, feed, tmp_path):
    rows = [[("a", 2, False)], [("a", 1, False)], [("a", 3, False)]]
    df = spark.createDataFrame(rows[0], "key string, seq long, passed boolean")
    got = [(r["attempts"], r["outcome"]) for _, r in drain(jobs.retry_controller(feed(df, rows)), "update", tmp_path)]
    assert got == [(1, "RETRY"), (2, "RETRY"), (3, "EXHAUSTED")]


def test_state_with_a_time_to_live(spark, feed, tmp_path):
    """By the clock, so the stream runs until it is stopped."""
    rows = [[("a", 2, False)], [("a", 1, False)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = jobs.retry_controller(feed(spark.createDataFrame(rows[0], "key string, seq long, passed boolean"), rows), ttl_ms=3_600_000)
    got = []
    q = stream.writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ttl"))
    q = q.trigger(processingTime="500 milliseconds").start()
    end = time.time() + 90
    while len(got) < 2 and time.time() < end and q.isActive:
        time.sleep(0.2)
    q.stop()
    assert [r["attempts"] for r in got] == [1, 2]


def test_progress_keeps_the_time_of_an_unchanged_status(spark, feed, tmp_path):
    rows = [[(1, "pending", 5)], [(1, "pending", 20)], [(1, "completed", 10)]]
    df = spark.createDataFrame(rows[0], "item_id long, status string, ts long")
    assert [tuple(r) for _, r in drain(jobs.progress_stream(feed(df, rows)), "append", tmp_path)] == [("pending", 1)]


def test_late_rows_go_to_their_table_and_are_counted(spark, feed, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    files = [[("a", at(100), 1), ("a", at(5), 2)], [("a", at(95), 3), ("b", at(89), 4), ("b", None, 5)], [("b", at(300), 6)], [("a", at(291), 7), ("a", at(100), 8)]]
    text = spark.createDataFrame(files[0], "key string, t string, n long")
    stream = feed(text, files).select("key", F.col("t").cast("timestamp").alias("ts"), "n")
    here = lambda x: str(tmp_path / x)
    for _ in range(2):  # a second run finds nothing new
        jobs.route_late(stream, here("on"), here("late"), "10 seconds", here("cp"))
    numbers = lambda x: sorted(r["n"] for r in spark.read.option("basePath", here(x)).parquet(here(x)).collect())
    assert numbers("late") == [4, 5, 8] and numbers("on") == [1, 2, 3, 6, 7]
    on = spark.readStream.schema("key string, ts timestamp, n long, batch long").option("maxFilesPerTrigger", 1).parquet(here("on"))
    got = {}
    for _, r in drain(jobs.retry_controller(on.select("key", F.col("n").alias("seq"), F.lit(False).alias("passed"))), "update", tmp_path):
        got[r["key"]] = max(got.get(r["key"], 0), r["attempts"])
    assert got == {"a": 4, "b": 1}


def test_pointers_of_a_keyed_table_do_not_pile_up(spark, tmp_path):
    table = jobs.KeyedTable(spark, str(tmp_path / "keyed"), ["k"], ["ts"], buckets=2)
    for i in range(6):
        table.merge(spark.createDataFrame([(i % 3, i)], "k long, ts long"), i, f"source {i % 2}")
    assert len(list((tmp_path / "keyed" / "pointers").glob("no=*"))) == 2 and dict(table._current().batches) == {"source 0": 4, "source 1": 5}
    assert len(list((tmp_path / "keyed").glob("v-*/_part=*"))) <= 4
    assert sorted(map(tuple, table.read().select("k", "ts").collect())) == [(0, 3), (1, 4), (2, 5)]


@pytest.mark.parametrize("files", [1, 4, 9])
def test_sessions_over_several_batches(spark, feed, tmp_path, files):
    """Events out of order within the delay, over any number of batches: the ends of sessions are those of the batch operator."""
    rng = random.Random(5)
    rows = [(f"s{rng.randint(0, 12)}", 1_700_000_000 + rng.randint(0, 4000), rng.random() < 0.05) for _ in range(90)]
    rows.sort(key=lambda r: r[1] + rng.randint(0, 250))
    df = spark.createDataFrame(rows, "session string, t long, done boolean")
    size = -(-len(rows) // files)
    stream = feed(df, [rows[i : i + size] for i in range(0, len(rows), size)]).select("session", F.timestamp_seconds("t").alias("ts"), "done")
    got = sorted(tuple(r) for _, r in drain(jobs.stale_session_stream(stream, 700, 1200, late="300 seconds"), "append", tmp_path))
    mark = F.lit((max(r[1] for r in rows) - 300) * 1000)
    want = tracking.session_ends(df.withColumn("ts", F.timestamp_seconds("t")), "session", "ts", F.col("done"), mark, 700, 1200)
    assert got == sorted(tuple(r) for r in want.collect()) and {r[1] for r in got} == {"done", "stale", "timeout"}


def test_retries_count_each_verdict_once(spark, feed, tmp_path):
    data = [("a", 1, False), ("a", 1, False), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("c", 1, False), ("c", 2, True)]
    got = {}
    for _, r in drain(jobs.retry_controller(feed(spark.createDataFrame(data, "key string, seq long, passed boolean"), 1)), "update", tmp_path):
        got[r["key"]] = (r["attempts"], r["outcome"])
    assert got == {"a": (1, "RETRY"), "b": (3, "EXHAUSTED"), "c": (0, "CONVERGED")}


def test_index_and_log_streams(spark, feed, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i % 4} " * 5) for i in range(12)], "doc_id long, text string")
    store = VectorStore(spark, str(tmp_path / "vectors"), "m", "plain")
    jobs.index_stream(feed(docs), store, str(tmp_path / "cp"), min_len=5)
    assert store.read().count() == 4
    jobs.run_log_stream(feed(docs), str(tmp_path / "log"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 12


def test_gate_stream(spark, feed, tmp_path):
    flow = spark.createDataFrame([("spec", 1, True, True, "judge")], "stage string, pos int, blocking boolean, required boolean, trusted_source string")
    states = spark.createDataFrame([("a", "spec", []), ("b", "spec", [])], "key string, current_stage string, completed_stages array<string>")
    verdicts = spark.createDataFrame([("a", "spec", 1, True, "judge")], "key string, stage string, seq int, passed boolean, source string")
    out = []
    jobs.stage_gate_stream(feed(states, 1), verdicts, flow, lambda b: out.extend(b.collect()), str(tmp_path / "cp"))
    assert {r["key"]: r["decision"] for r in out} == {"a": "advance", "b": "no verdict"}


def test_stale_and_late(spark):
    log = spark.createDataFrame([("a", "2024-01-01 00:00:00", False), ("a", "2024-01-01 00:01:00", True), ("b", "2024-01-01 00:00:00", False), ("c", "2024-01-01 00:04:00", False)], "s string, t string, d boolean")
    log = log.withColumn("t", F.col("t").cast("timestamp"))
    got = tracking.stale_sessions(log, "s", "t", F.col("d"), F.lit("2024-01-01 00:05:00").cast("timestamp"))
    assert {r["s"]: r["state"] for r in got.collect()} == {"a": "done", "b": "stale", "c": "running"}
    assert jobs.late_rows(log, "2024-01-01 00:02:00", "t").count() == 3


def test_registered_streams_that_run_twice(spark, sf_dir):
    """Both runs read the same files, so that the second goes on from the checkpoint of the first and adds nothing."""
    from tracewell.plans.catalog import QUERIES

    log = QUERIES["run_log_stream"](spark, sf_dir).select("detail").collect()
    assert sorted(int(r[0]) for r in log) == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())
    stored = [r[0] for r in QUERIES["index_stream"](spark, sf_dir).collect()]
    assert stored and len(stored) == len(set(stored))
