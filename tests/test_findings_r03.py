"""What the findings of round 3 asked for: work and shuffles that grow with the input only."""

from tracewell.operators import search


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fuzzy_scores_cut_texts_once_a_row(spark):
    names = [(1, "Large Ring"), (2, "large ring"), (None, "large ring"), (4, None), (5, "ring  large"), (6, ""), (7, "LargeRing 12"), (8, "large ring")]
    asked = ["large ring", "large ring", "ring", "", "12"]
    base, queries = spark.createDataFrame(names, "id long, name string"), spark.createDataFrame([(q,) for q in asked], "query string")

    def tokens(t):
        return {w for w in __import__("re").findall(r"[a-z0-9_]+", t.lower()) if len(w) >= 2}

    def score(q, n):
        if n is None:
            return None
        inside = q.lower() in n.lower() or q.lower().replace(" ", "") in n.lower().replace(" ", "")
        a, b = tokens(q), tokens(n)
        return round(0.5 * inside + (0.3 * len(a & b) / len(a | b) if a and b else 0.0), 6)

    want = sorted(((q, k, score(q, n)) for q in set(asked) for k, n in names), key=str)
    for blocks in ((512, 4096), (2, 3)):
        df = search.fuzzy_scores(base, queries, query_block=blocks[0], base_block=blocks[1])
        assert sorted(map(tuple, df.collect()), key=str) == want
        above = plan_of(df).split("Join", 1)[0]  # what is computed for each pair
        assert "array_intersect" in above and "regexp_extract_all" not in above


class CountedState:
    """A state handle of one key that counts calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)

    def getCurrentWatermarkInMs(self):
        return 5_000

    def getCurrentProcessingTimeInMs(self):
        return 0

    def getExpiryTimeInMs(self):
        return 5_000


def test_stream_folds_cost_few_state_calls_a_key_and_batch():
    from pyspark.sql import Row

    from tracewell.streaming import jobs

    verdicts = [[Row(seq=s, passed=s == 40) for s in part] for part in (range(100, 30, -1), range(60, 0, -1))]
    events = [[Row(ms=1000 + i, done=False) for i in part] for part in (range(9_000, 4_000, -50), range(0, 9_000, 50))]
    stages = [[Row(stage=f"s{i}", ts=i, completed=True, flow_mode="fast" if i == 7 else None, results=[("n", str(i))]) for i in part] for part in (range(99, 50, -1), range(60))]
    for fold, batches, want in (
        (jobs._Attempts(3, None), verdicts, [(100, 60, "EXHAUSTED")] * 2),
        (jobs._Silence(3_000, 60_000), events, []),
        (jobs._Workflow(None), stages, [("s99", None, [f"s{i}" for i in range(51, 100)], [("n", "99")]), ("s99", "fast", [f"s{i}" for i in range(100)], [("n", "99")])]),
    ):
        state = CountedState()
        fold.init(state)
        got = [tuple(r)[1:] for b in batches for r in fold.handleInputRows(("k",), iter(b), state)]
        assert got == want and state.calls <= 8
    done = jobs._Silence(3_000, 60_000)
    state = CountedState()
    done.init(state)
    assert not list(done.handleInputRows(("k",), iter([Row(ms=2_500, done=None), Row(ms=7_000, done=True)]), state)) and state.timers == {5_500}
    assert list(done.handleInputRows(("k",), iter([Row(ms=4_900, done=True)]), state)) == [Row(session="k", state="done", at_ms=4_900)] and not state.timers


def test_sets_of_many_texts_are_shuffled_once(spark, monkeypatch):
    from tests.models import near_copies
    from tracewell.operators import quality

    docs = spark.createDataFrame(sorted({k: (k, t) for k, t in near_copies() if k is not None}.values()), "doc_id long, text string")
    want = sorted(map(tuple, quality.near_duplicate_classes(docs, "doc_id", "text").collect()))
    monkeypatch.setattr(quality, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, quality.near_duplicate_classes(docs, "doc_id", "text").collect())) == want
    _, sets, _ = quality._shingle_rows(docs, "doc_id", "text", 5)
    assert "Join" not in plan_of(sets)


def test_layers_of_cycles_broadcast_nothing(spark, monkeypatch):
    from tracewell.operators import graph

    plans, write = [], graph.write_shared
    monkeypatch.setattr(graph, "write_shared", lambda df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, tag))[1])
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (4, 3)], "src long, dst long")
    assert {r["id"]: r["layer"] for r in graph.topo_layers(nodes, edges).collect()} == {0: 0, 2: 1, 1: 2, 3: 1, 4: 2}
    assert plans and not [p for p in plans if "Broadcast" in p]


def model_trees(roots, edges, max_depth, max_nodes):
    """Trees by plain breadth-first search."""
    calls = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            calls.setdefault(a, set()).add(b)
    found = []
    for root in set(roots):
        seen, front = {root: (None, 0)}, [root]
        for depth in range(1, max_depth + 1):
            if max_nodes is not None and len(seen) > max_nodes:
                break
            new = {}
            for a in sorted(front, key=str):
                for b in calls.get(a, ()):
                    if b not in seen:
                        new.setdefault(b, (a, depth))
            seen |= new
            front = list(new)
        found += [(root, node, *rest) for node, rest in seen.items()]
    return sorted(found, key=str)


def test_trees_are_those_of_a_plain_search(spark):
    import random

    from tracewell.operators import graph

    rng = random.Random(7)
    wild = [(f"f{rng.randrange(30)}", f"f{rng.randrange(40)}") for _ in range(90)]
    wild += wild[:20] + [("f1", "f1"), (None, "f2"), ("f2", None), ("elsewhere", "f3")]
    flat = [(f"f{i % 9}", f"p{i % 23}") for i in range(120)]
    roots = ["f0", "f1", "f2", "f2", "f39", "lonely", None]
    for edges in (wild, flat):
        e, r = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(k,) for k in roots], "id string")
        for depth, limit in ((10, None), (10, 4), (10, 1), (10, 0), (0, None), (1, None), (2, 3)):
            got = graph.call_trees(r, e, depth, limit)
            assert got.columns == ["root", "node", "parent", "depth"]
            assert sorted(map(tuple, got.collect()), key=str) == model_trees(roots, edges, depth, limit), (depth, limit)


def test_trees_of_callees_that_call_nothing_shuffle_the_calls_twice(spark, monkeypatch):
    from tracewell.operators import graph

    plans, write = [], graph.write_shared
    monkeypatch.setattr(graph, "write_shared", lambda df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, tag))[1])
    edges = spark.createDataFrame([(f"f{i % 9}", f"p{i % 23}") for i in range(120)], "src string, dst string").repartition(3)
    trees = graph.call_trees(edges.select("src").withColumnRenamed("src", "id"), edges, max_nodes=10_000)
    assert trees.groupBy("root").count().count() == 9
    # roots once, calls for their own distinction and for the roots, callers and callees as partial counts: no search of a second depth
    assert len(plans) == 3 and sum(p.count("Exchange hashpartitioning") for p in plans) <= 7


def test_root_functions_are_the_orders_that_have_lines(spark, tmp_path):
    import __spark_entry__ as entry

    lines = [(1, 10), (1, 10), (1, 11), (2, 12), (9, 1), (None, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, "d")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = entry.queries()["root_functions"](spark, str(tmp_path)).select("key", "root_name", "uuid", "reached", "depth", "kind")
    assert sorted(map(tuple, got.collect())) == [("f1###u1", "f1", "u1", 3, 1, "a"), ("f2###u2", "f2", "u2", 2, 1, None)]
