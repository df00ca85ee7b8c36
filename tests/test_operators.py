"""Operators against small own models, with odd rows and under repartition."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators import catalog, chunking, consolidate, graph, quality, relations, rules, search, tracking
from tracewell.operators.components import connected_components
from tracewell.operators.vector_index import VectorIndex, fit_centres, open_cells
from tracewell.sources import io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- chunks


def window_model(body, size, overlap, least):
    body = body.strip()
    if len(body) <= size:
        return [body] if len(body) >= least else []
    out, start, step = [], 0, max(1, size - overlap)
    while True:
        piece = body[start : start + size]
        if len(piece) >= least and piece.strip():
            out.append(piece.strip())
        if start + size >= len(body):
            return out
        start += step


def chunk_model(text, size, overlap, least):
    import re

    segments, stack, crumb, lines, opened = [], [], [], [], False
    for line in text.split("\n"):
        m = re.match(r"^(#{1,6})\s+(.*)$", line)
        if m:
            if opened:
                segments.append((crumb, "\n".join(lines)))
            stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            crumb, lines = [t for _, t in stack], []
        else:
            lines = [*lines, line]
        opened = True
    segments.append((crumb, "\n".join(lines)))
    if not any(c for c, _ in segments):
        return [("", c) for c in window_model(text, size, overlap, least)]
    out, wait, wait_crumb = [], [], ""
    for c, b in segments:
        b, name = b.strip(), " > ".join(c)
        if not b:
            continue
        if len(b) < least:
            wait.append(b)
            wait_crumb = name
            continue
        full, wait = "\n".join([*wait, b]), []
        use = name or wait_crumb
        pieces = window_model(full, size, overlap, least) if len(full) > size else [full]
        out += [(use, f"{use}\n{p}" if use else p) for p in pieces]
    if wait:
        text = "\n".join(wait)
        out.append((wait_crumb, f"{wait_crumb}\n{text}" if wait_crumb else text))
    return out


def test_chunk_documents_against_model(spark):
    rng = random.Random(3)
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 14)):
            lines.append(rng.choice(["# ", "## ", "### ", "", "", "", ""]) + "".join(rng.choices("abc de", k=rng.choice([0, 3, 12, 90]))))
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame([*docs, (100, None), (101, "")], "doc_id long, text string")
    got = {}
    for r in chunking.chunk_documents(df, size=60, overlap=10, min_len=8).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append((r["breadcrumb"], r["chunk"]))
    for i, text in docs:
        assert got.get(i, []) == chunk_model(text, 60, 10, 8), text
    assert 100 not in got and 101 not in got


def test_long_documents_are_cut_in_linear_time(spark):
    n = 100_000
    text = "\n".join(f"{'##' if i % 3 else '#'} title {i % 977}\nline {i}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    sections = chunking.heading_sections(df)
    assert sections.count() == n and sections.filter("section_no = 4").first()["breadcrumb"] == ["title 3", "title 4"]
    assert chunking.chunk_documents(df, min_len=8).count() > 1000
    found = df.select(X.h2_sections(F.col("text")).alias("m"), X.front_matter(F.concat(F.lit("---\n"), F.regexp_replace("text", "#+ title (\\d+)\n", "k$1: "), F.lit("\n---\n"))).alias("f")).first()
    want = {f"title {i % 977}": i for i in range(n) if i % 3}
    assert {k: v.split("\n")[0] for k, v in found["m"].items()} == {k: f"line {i}" for k, i in want.items()} and len(found["f"]) == 977
    assert time.time() - start < 60


# ---------------------------------------------------------------- catalogue


def test_budget_batches_against_model(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), i, rng.randint(0, 12)) for i in range(200)] + [("c", 1, 99), ("c", 2, 1)]
    want = {}
    for g in "abc":
        batch, n, total = 1, 0, 0
        for _, i, c in sorted(x for x in data if x[0] == g):
            if n and (n >= 5 or total + c > 20):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + c
            want[g, i] = batch
    df = spark.createDataFrame(data, "g string, i long, c long").repartition(5)
    got = {(r["g"], r["i"]): r["batch"] for r in catalog.budget_batches(df, ["g"], ["i"], "c", 5, 20).collect()}
    assert got == want


@pytest.mark.parametrize(("size", "budget", "ranges"), [(5, 20, 1), (5, 20, 9), (3, 1000, 40), (50, 60, 25), (1, 5, 4), (7, 0, 6)])
def test_budget_batches_over_ranges(spark, size, budget, ranges):
    """Groups over many ranges, ranges shorter than a batch, null, zero, negative and too large costs, a null group."""
    rng = random.Random(size)
    data = [(rng.choice(["big", "big", "big", "b", None]), i, rng.choice([None, 0, -3, 1, 2, 5, 9, 100])) for i in range(400)]
    want = {}
    for g in {d[0] for d in data}:
        batch, n, total = 1, 0, 0
        for _, i, c in sorted(d for d in data if d[0] == g):
            c = max(0, c or 0)
            if n and (n >= size or total + c > budget):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + c
            want[g, i] = batch
    df = spark.createDataFrame(data, "g string, i long, c long").repartition(3)
    got = {(r["g"], r["i"]): r["batch"] for r in catalog.budget_batches(df, ["g"], ["i"], "c", size, budget, partitions=ranges).collect()}
    assert got == want
    assert catalog.budget_batches(df.limit(0), ["g"], ["i"], "c", size, budget).count() == 0


def test_one_large_group_is_packed_by_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.col("id").alias("i"), (F.col("id") % 7).alias("c"))
    rows = catalog.budget_batches(df, ["g"], ["i"], "c", 20, 50, partitions=16).withColumn("task", F.spark_partition_id())
    got = rows.agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.max("batch").alias("last")).first()
    batch, n, total = 1, 0, 0
    for i in range(200_000):
        c = i % 7
        if n and (n >= 20 or total + c > 50):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + c
    assert (got["n"], got["last"]) == (200_000, batch) and got["tasks"] > 1


@pytest.mark.parametrize("parts", [1, 7])
def test_renumber_is_consecutive(spark, parts):
    df = spark.range(1500).withColumn("id", F.col("id") * 3).repartition(parts)
    got = catalog.renumber(df, ["id"], template="API-%03d").collect()
    assert {r["number"]: r["id"] for r in got} == {f"API-{i + 1:03d}": 3 * i for i in range(1500)}


def test_fixed_batches_over_all(spark):
    df = spark.range(500).repartition(5)
    assert {r["id"]: r["batch"] for r in catalog.fixed_batches(df, ["id"], 7).collect()} == {i: i // 7 + 1 for i in range(500)}


def test_merge_duplicates(spark):
    df = spark.createDataFrame([(" A ", 2, "x", ["q"]), ("a", 1, "y", ["p", "q"]), ("", 3, "z", ["r"]), (None, 4, "w", []), ("b", 5, "v", None)], "k string, o int, v string, s array<string>")
    assert rows(catalog.merge_duplicates(df, "k", "o", ["s"])) == sorted([("a", 1, "y", ["p", "q"]), ("b", 5, "v", [])], key=str)
    assert catalog.merge_duplicates(df, "k", "o", ["s"], keep_null_key=True).count() == 4


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "id int, x string, y string")
    ch = spark.createDataFrame(
        [(1, "modify", None, "new"), (2, "INSERT", "z", "z"), (3, "INSERT", "c", "r"), (4, "DELETE", None, None), (5, "what", None, None), (6, "INSERT", "a", "a"), (6, "DELETE", "a", "a"), (None, "INSERT", "a", "a")],
        "id int, action string, x string, y string",
    )
    new, errors = catalog.apply_changes(base, ch, "id", ["x", "y"])
    assert rows(new) == [(1, "a", "new"), (2, "b", "q"), (3, "c", "r")]
    assert {(r["id"], r["error"]) for r in errors.collect()} == {(2, "already present"), (4, "not present"), (5, "unknown action"), (6, "several changes"), (None, "no key")}


def test_audits(spark):
    df = spark.createDataFrame([("API-001.md", 1), ("API-002.md", 3), ("x", None)], "file string, batch_number int")
    assert [r["header_error"] for r in catalog.validate_batch_headers(df).orderBy("file").collect()] == [None, "number differs", "no header"]
    paths = spark.createDataFrame([("src/a.py",), ("test/b.py",), ("src/test_a.py",), ("src/c.md",), ("lib/d.py",)], "path string")
    got = catalog.exclude_paths(paths, "path", globs=("*.md",), dirs=("lib",), tests=True)
    assert rows(got) == [("src/a.py",), ("test/b.py",)]
    found = relations.map_tests(paths.filter("path = 'src/a.py'"), paths)
    assert rows(found) == [("src/a.py", "src/test_a.py")]
    # small files can hold millions of paths: none is sent through the driver
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- relations and graphs


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 400)] + [(500, 500), (None, 3), (7, 6)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6))))
    assert all(got[i] == 0 for i in range(41)) and all(got[x] == 100 for x in range(100, 400)) and 500 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0



def test_topo_layers_with_a_cycle(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("d", "c"), ("f", "f"), ("a", "zz")], "src string, dst string")
    # only the cycle is left after layer 2; e has one dependency and d two, one of them done
    assert dict(rows(graph.topo_layers(nodes, edges))) == {"c": 0, "f": 0, "b": 1, "a": 2, "e": 3, "d": 4}


def test_trees_and_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "y"), ("x", "x")], "src string, dst string").withColumn("relation", F.lit("r"))
    nodes = spark.createDataFrame([(c,) for c in "abcxy"], "id string")
    roots = graph.call_roots(nodes, edges)
    assert rows(roots) == [("a",), ("x",)]  # the cycle has no caller: its last layer starts it
    many = spark.createDataFrame([(f"{i}{x}", f"{i}{y}") for i in range(30) for x, y in ("pq", "qp")], "src string, dst string")
    both = many.select(F.col("src").alias("id"))
    assert sorted(r["id"] for r in graph.call_roots(both, many).collect()) == sorted(f"{i}q" for i in range(30))
    assert sorted(Counter(r["layer"] for r in graph.topo_layers(both, many, max_layers=3).collect()).items()) == [(0, 30), (1, 30)]
    with pytest.raises(RuntimeError):
        graph.topo_layers(both, many, max_layers=1)
    capped = graph.call_trees(spark.createDataFrame([("a",)], "id string"), edges, max_nodes=1)
    assert {r["node"] for r in capped.collect()} == {"a", "b", "c"}
    trees = graph.call_trees(spark.createDataFrame([("a",)], "id string"), edges)
    assert rows(trees) == [("a", "a", None, 0), ("a", "b", "a", 1), ("a", "c", "a", 1)]
    pairs = spark.createDataFrame([("b", "c"), ("a", "y")], "a string, b string")
    assert rows(graph.shortest_paths(edges, pairs)) == [("b", "c", 1, ["b", "c"])]
    assert dict(rows(graph.bfs_subgraph(edges, spark.createDataFrame([("b",)], "id string"), 1))) == {"b": 0, "a": 1, "c": 1}
    assert graph.touching_edges(edges, graph.bfs_subgraph(edges, nodes.filter("id = 'x'"), 1)).count() == 2


def test_lookup_and_declarations(spark):
    e = spark.createDataFrame([("f###u1", "s1"), ("g###u2", None)], "key string, uuid string")
    d = spark.createDataFrame([("u2",), ("f###u1",), ("s1",), ("",), (None,)], "ref string")
    assert {r["ref"]: r["key"] for r in graph.lookup_element(d, e).collect()} == {"u2": "g###u2", "f###u1": "f###u1", "s1": "f###u1", "": None, None: None}
    decl = spark.createDataFrame([("C", "m", "d", "h", ["x"], "private"), (None, "n", "d", "h", [], "public")], "class_name string, name string, content string, filename string, dependencies array<string>, access string")
    impl = spark.createDataFrame([("C", "m", "k2", "late", "i", []), ("C", "m", "k1", "body", "i.c", ["y"])], "class_name string, name string, key string, content string, filename string, dependencies array<string>")
    got = {r["name"]: (r["content"], r["filename"], r["dependencies"], r["access"]) for r in graph.merge_decl_impl(decl, impl).collect()}
    assert got == {"m": ("body", "i.c", ["y"], "private"), "n": ("d", "h", [], "public")}


@pytest.mark.parametrize("max_characters", [10**6, 0])
def test_mentions_against_contains(spark, max_characters):
    names = [(1, "alpha beta gamma"), (2, "one"), (3, ""), (4, "x  y"), (5, "beta gamma delta eps"), (6, "one"), (7, None), (8, "\U0001f600 x"), (9, "e o")]
    texts = [(1, "zalpha beta gammaz"), (2, "none one"), (3, None), (4, "x  y"), (5, "beta gamma delta epsilon"), (6, ""), (2, "one"), (7, "\U0001f600 x " * 3000)]
    t, n = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(names, "item_id int, text string")
    want = sorted({(d, i) for d, x in texts for i, m in names if x and m and m in x}, key=str)
    assert rows(graph.mention_edges(t, n, max_characters=max_characters)) == want
    assert rows(graph.mention_edges(t, n.limit(0), max_characters=max_characters)) == rows(graph.mention_edges(t.limit(0), n, max_characters=max_characters)) == []


def test_loose_names_against_all_classes(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abC") for _ in range(rng.randint(1, n)))
    elements = [(f"k{i:03}", rng.choice(["get", "run"]), rng.choice([None, "", word(6)]), "x.py") for i in range(120)]
    calls = [(i, f"{word(4)}.{rng.choice(['get', 'run'])}", "c") for i in range(80)]
    got = {r["call_id"]: r for r in graph.resolve_names(spark.createDataFrame(calls, "call_id int, name string, scope string"), spark.createDataFrame(elements, "key string, name string, class_name string, filename string"), loose=True).collect()}
    for i, name, _ in calls:
        o, m = name.split(".")
        same = [k for k, n, c, _ in elements if n == m and c == o]
        like = [k for k, n, c, _ in elements if n == m and c and o.lower() in c.lower()]
        want = (min(same), 3) if same else (min(like), 6) if like else (min(k for k, n, *_ in elements if n == m), 5)
        assert (got[i]["key"], got[i]["rule"]) == want


# ---------------------------------------------------------------- search


def test_fuzzy_search_against_difflib(spark):
    import difflib
    import re

    rng = random.Random(9)
    names = [(i, " ".join(rng.choices(["vpn", "ipsec", "route", "Config", "x"], k=rng.randint(1, 4)))) for i in range(120)]

    def score(q, n):
        a, b = q.lower(), n.lower()
        sub = float(a in b or a.replace(" ", "") in b.replace(" ", ""))
        t = [{w for w in re.findall(r"[a-z0-9_]+", s) if len(w) > 1} for s in (a, b)]
        jac = len(t[0] & t[1]) / len(t[0] | t[1]) if t[0] and t[1] else 0
        return 0.5 * sub + 0.3 * jac + 0.2 * difflib.SequenceMatcher(None, a, b).ratio()

    queries = ["vpn config", "route", "qqq"]
    got = search.fuzzy_search(spark.createDataFrame(names, "id long, name string"), spark.createDataFrame([(q,) for q in queries], "query string"), 5)
    for q in queries:
        want = sorted(((-score(q, n), i) for i, n in names if score(q, n) > 0))[:5]
        assert sorted((-r["score"], r["id"]) for r in got.collect() if r["query"] == q) == sorted((-round(-s, 4), i) for s, i in want)


def test_searches_ask_every_hundredth_row_of_the_tables(spark, sf_dir):
    import numpy as np

    from tracewell.plans.catalog import QUERIES

    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    base = {r["vec_id"]: (np.array(r["embedding"], dtype=np.float64), r["label"]) for r in t("embeddings").collect()}
    asked = [i for i in base if i % 100 == 0]
    assert max(asked) >= 100
    for name, ok in (("vector_topk", lambda x: True), ("vector_scoped", lambda x: x in (1, 2, 3))):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in QUERIES[name](spark, sf_dir).collect()}
        want = {}
        for q in asked:
            best = sorted((-float(sum(base[q][0] * v)), i) for i, (v, label) in base.items() if ok(label))[:10]
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1) if -s >= 0.3}
        assert set(got) == set(want) and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-4 for x in want)
    parts = t("part").count()
    names = {r["p_name"] for r in t("part").filter("p_partkey % 100 = 0").collect()}
    scores = QUERIES["fuzzy_native"](spark, sf_dir)
    assert {r["query"] for r in scores.select("query").distinct().collect()} == {x.lower() for x in names}
    assert scores.count() == scores.select("query", "p_partkey").distinct().count() == parts * len({x.lower() for x in names})
    assert {r["query"] for r in QUERIES["fuzzy_topk"](spark, sf_dir).collect()} == names
    docs = t("documents")
    assert {r["ref"] for r in QUERIES["resolve_instance"](spark, sf_dir).collect()} >= {f"DOC_{r['doc_id']}" for r in docs.collect()}
    got = {r["a"]: r["hops"] for r in QUERIES["shortest_path"](spark, sf_dir).collect()}
    edges = [(f"n{r['n_nationkey']}", f"r{r['n_regionkey']}") for r in t("nation").collect()] + [(f"c{r['c_custkey']}", f"n{r['c_nationkey']}") for r in t("customer").collect()]
    assert got == distances([*edges, *((f"o{r['o_orderkey']}", f"c{r['o_custkey']}") for r in t("orders").collect())], "c1", {f"c{r['c_custkey']}" for r in t("customer").filter("c_custkey % 100 = 0").collect()})


def distances(edges, end, wanted):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    at, front, d = {end: 0}, {end}, 0
    while front:
        d += 1
        front = {y for x in front for y in near[x]} - set(at)
        at |= dict.fromkeys(front, d)
    return {x: at[x] for x in wanted if x in at}


def test_searches_in_small_tiles(spark):
    import itertools

    rng = random.Random(4)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(vectors, "id long, v array<float>")
    got = search.vector_search(df, df.select(F.col("id").alias("query_id"), F.col("v").alias("query_vector")), "id", "v", 5, -99.0, query_block=20, base_block=30)
    want = {(q, n): i for q, a in vectors for n, (_, i) in enumerate(sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors)[:5], 1)}
    assert {(r["query_id"], r["rank"]): r["id"] for r in got.collect()} == want
    names = spark.createDataFrame([(i, " ".join(rng.choices(["vpn", "ipsec", "route", "x1"], k=3))) for i in range(80)], "id long, name string")
    asked = names.select(F.col("name").alias("query"))
    whole, cut = (rows(search.fuzzy_search(names, asked, 4, query_block=b, base_block=n)) for b, n in ((512, 4096), (3, 9)))
    assert whole == cut and len(cut) == 4 * len({q for q, *_ in cut})
    edges = [(str(rng.randrange(25)), str(rng.randrange(25))) for _ in range(40)]
    nodes = sorted({x for e in edges for x in e})
    pairs = [(a, b) for a in nodes for b in nodes[:4]]
    found = {(r["a"], r["b"]): (r["hops"], r["path"]) for r in graph.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "a string, b string"), 5).collect()}
    near = {n: {b for a, b in [*edges, *((y, x) for x, y in edges)] if a == n and b != n} for n in nodes}
    for a, b in itertools.product(nodes, nodes[:4]):
        d = distances(edges, b, {a}).get(a)
        assert ((a, b) in found) == (d is not None and d <= 5)
        if (a, b) in found:
            paths = [[a]]
            for _ in range(d):
                paths = [[*p, n] for p in paths for n in near[p[-1]]]
            assert found[a, b] == (d, min(p for p in paths if p[-1] == b))


def test_incremental_index(spark, tmp_path):
    store = io.VectorStore(spark, str(tmp_path / "store"), "m1", "plain")
    docs = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text string")
    first = search.build_index(docs, store).first()
    again = search.build_index(docs.union(spark.createDataFrame([("d",)], "text string")), store).first()
    assert (first["entries"], first["new"], first["reused"]) == (3, 2, 0) and (again["new"], again["reused"]) == (1, 2)
    assert store.read().count() == 3 and io.VectorStore(spark, str(tmp_path / "store"), "m2", "plain").read().count() == 0


# ---------------------------------------------------------------- rules, gates and tracking


def test_contract_mutations(spark):
    good = "# Overview\n## Scope\nREQ-1 REQ-2\nGIVEN x"
    rules_ = [("scope", "heading", "Scope", 0), ("reqs", "pattern", r"REQ-\d+", 2), ("given", "token", "GIVEN", 0), ("tbd", "forbidden", "TBD", 0), ("long", "min_chars", "", 10)]
    docs = spark.createDataFrame([(0, good), (1, good.replace("## Scope", "Scope")), (2, good.replace("REQ-2", "")), (3, good + " TBD"), (4, good.replace("GIVEN", "")), (5, None)], "id int, t string")
    got = {r["id"]: r["errors"] for r in quality.contract_check(docs, rules_, "id", "t").collect()}
    assert got == {0: [], 1: ["scope"], 2: ["reqs"], 3: ["tbd"], 4: ["given"], 5: ["given", "long", "reqs", "scope"]}
    assert {r["id"]: r["score"] for r in quality.spec_quality(quality.contract_check(docs, rules_, "id", "t")).collect()}[5] == 0.6


def test_todo_gate_counts_all_orders(spark, sf_dir):
    from tracewell.plans.catalog import QUERIES

    from pyspark.sql.types import ArrayType

    orders = [(r["o_orderstatus"], r["o_orderkey"]) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()]
    gate, failed = QUERIES["todo_gate"](spark, sf_dir), QUERIES["todo_failed"](spark, sf_dir)
    assert max(k for _, k in orders) >= 1000 and not any(isinstance(f.dataType, ArrayType) for f in gate.schema)
    want = {t: [sum(x == t and k % 5 in m for x, k in orders) for m in ((2, 3, 4), (0,), (1,))] for t, _ in orders}
    assert {r["track"]: [r["done"], r["failed"], r["pending"]] for r in gate.collect()} == want and not any(r["passed"] for r in gate.collect())
    assert rows(failed) == sorted(((t, k) for t, k in orders if k % 5 == 0), key=str)
    items = spark.createDataFrame([("a", 1, "Done"), ("a", 2, "completed"), ("b", 3, "FAILED")], "track string, k long, s string")
    assert rows(quality.todo_gate(items, "track", "s")) == [("a", 2, 0, 0, True), ("b", 0, 1, 0, False)] and rows(quality.todo_failed(items, "track", "k", "s")) == [("b", 3)]


def test_audits_of_traces_and_assets(spark):
    t = spark.createDataFrame([("leaf", 9, "x"), ("tired", 9, "x"), ("leaf", 2, "x"), ("leaf", 9, " ")], "stopped_reason string, max_depth_achieved int, leaf_evidence string")
    assert [r["problem"] for r in quality.trace_audit(t, 8, ("leaf",)).collect()] == [None, "stop not allowed", "too shallow", "no leaf evidence"]
    a = spark.createDataFrame([("parsed", "yaml", ["k"], None, ["c"]), ("failed", "", [], "short", [])], "parse_status string, parse_method string, extracted_keys array<string>, structure_summary string, consumer_refs array<string>")
    assert [len(r["problems"]) for r in quality.config_audit(a).collect()] == [0, 4]


def test_attempts_against_model(spark):
    rng = random.Random(2)
    data = [(k, s, rng.random() < 0.3) for k in range(30) for s in rng.sample(range(20), rng.randint(1, 8))]
    data += data[:10]
    want = {}
    for k in range(30):
        n, outcome = 0, None
        for _, _, ok in sorted({x for x in data if x[0] == k}, key=lambda x: x[1]):
            n = 0 if ok else n + 1
            outcome = "CONVERGED" if ok else "EXHAUSTED" if n >= 3 else "RETRY"
        want[k] = (n, outcome)
    got = tracking.attempt_counter(spark.createDataFrame(data, "key int, seq int, passed boolean").repartition(4))
    assert {r["key"]: (r["attempts"], r["outcome"]) for r in got.collect()} == want


def test_stage_gate(spark):
    flow = spark.createDataFrame([("spec", 1, True, True, "judge"), ("plan", 2, False, True, "judge"), ("code", 3, True, True, "judge")], "stage string, pos int, blocking boolean, required boolean, trusted_source string")
    states = spark.createDataFrame([("a", "spec", []), ("b", "spec", []), ("c", "code", ["spec"]), ("d", "plan", ["spec"]), ("e", "odd", []), ("f", "spec", []), ("g", "spec", [])], "key string, current_stage string, completed_stages array<string>")
    v = spark.createDataFrame([("a", "spec", 1, False, "judge"), ("a", "spec", 2, True, "judge"), ("f", "spec", 1, True, "me"), ("g", "spec", 1, False, "judge")], "key string, stage string, seq int, passed boolean, source string")
    got = {r["key"]: r["decision"] for r in tracking.stage_gate(states, v, flow).collect()}
    assert got == {"a": "advance", "b": "no verdict", "c": "earlier stage open", "d": "advance", "e": "unknown stage", "f": "untrusted verdict", "g": "failed"}


def test_consolidate_keeps_unmatched_and_unites(spark):
    e = spark.createDataFrame([(1, "a", ["x"]), (2, "a b", ["y"]), (3, "c", ["z"]), (4, "a b c", ["w"])], "id long, name string, s array<string>")

    def matcher(now):
        a, b = now.select(F.col("id").alias("a"), F.col("name").alias("n")), now.select(F.col("id").alias("b"), F.col("name").alias("m"))
        return a.join(b, F.col("a") < F.col("b")).filter(F.col("m").startswith(F.concat("n", F.lit(" ")))).select("a", "b")

    got = rows(consolidate.consolidate(e, matcher, "id", "id", ["s"]))
    assert got == [(1, "a", ["w", "x", "y"]), (3, "c", ["z"])]
    kept = consolidate.drop_low_value(spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id int, b string"), spark.createDataFrame([(1, "p", True), (2, "p", False)], "id int, b string, valuable boolean"), "id", "b")
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]


def test_consolidated_texts_keep_the_values_of_all_documents(spark):
    base = [f"w{i}" for i in range(60)]
    copy, near, other = " ".join(base), " ".join([*base[:-1], "end"]), "an entirely different text"
    data = [(1, copy, "a"), (2, copy, "b"), (3, copy.upper(), "c"), (4, copy, None), (5, near, "d"), (6, near, "a"), (7, other, None), (8, "", "e"), (9, None, "f"), (10, " \n", None), (None, copy, "g")]
    data += [(i, copy, f"s{i % 7}") for i in range(100, 400)]
    got = consolidate.consolidate_texts(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4), "doc_id", "text", "source", "sources")
    assert rows(got) == rows(spark.createDataFrame([(1, ["a", "b", "c", "d", *(f"s{i}" for i in range(7))]), (7, []), (8, ["e"]), (9, ["f"]), (10, []), (None, ["g"])], "a long, b array<string>"))


def test_consolidate_documents_covers_the_table(spark, sf_dir):
    from tests.models import brute_links
    from tracewell.plans.catalog import QUERIES

    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    _, group = brute_links([(k, t) for k, t, _ in docs])
    want = {}
    for i, (_, _, source) in enumerate(docs):
        want.setdefault(docs[group[i]][0], set()).update({source} - {None})
    assert {r["doc_id"]: r["sources"] for r in QUERIES["consolidate_documents"](spark, sf_dir).collect()} == {k: sorted(v) for k, v in want.items()}


def test_near_duplicates_have_a_row_for_every_document(spark):
    from tests.models import brute_links, near_copies

    crowd = [f"c{i}" for i in range(120)]
    data = sorted({k: (k, t) for k, t in near_copies() if k is not None}.values())
    data += [(9000 + i, " ".join([*crowd[: i % 40], "x", *crowd[i % 40 :]])) for i in range(120)] + [(9500, ""), (9501, None), (9502, " \t"), (9503, "one two"), (9504, "ONE  two")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    links, group = brute_links(data)
    sets = {i: frozenset(quality_shingles(t)) for i, (_, t) in enumerate(data)}
    rep = {}
    for i, (k, _) in enumerate(data):
        rep[sets[i] or k] = min(rep.get(sets[i] or k, k), k)
    whole = {k: (rep[sets[i] or k], min(data[j][0] for j in range(len(data)) if group[j] == group[i]), len(links[i])) for i, (k, _) in enumerate(data)}
    for tile in (512, 7):
        got = quality.near_duplicate_classes(docs, "doc_id", "text", tile_docs=tile).collect()
        assert {r["doc_id"]: (r["representative"], r["class_id"], r["n_links"]) for r in got} == whole and len(got) == len(data)
        pairs = quality.near_duplicates(docs, "doc_id", "text", tile_docs=tile).collect()
        heads = {rep[s]: s for s in sets.values() if s}
        want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in heads.items() for b, y in heads.items() if a < b and len(x & y) / len(x | y) >= 0.8}
        assert {(r["a"], r["b"]): r["similarity"] for r in pairs} == want and len(pairs) == len(want) > 100
    twice = quality.near_duplicate_classes(docs.union(docs), "doc_id", "text").select("doc_id", "representative", "class_id").distinct()
    assert {r["doc_id"]: (r["representative"], r["class_id"]) for r in twice.collect()} == {k: v[:2] for k, v in whole.items()}
    copies = spark.createDataFrame([(i, "the very same words again and again") for i in range(3000)] + [(None, "the very same words again and again")], "doc_id long, text string")
    got = quality.near_duplicate_classes(copies, "doc_id", "text").groupBy("representative", "class_id", "n_links").count()
    assert rows(got) == [(0, 0, 2999, 3000), (None, None, 0, 1)]


def quality_shingles(text):
    import re

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_first_match_order(spark):
    df = spark.createDataFrame([("test_a.py", "route"), ("a.py", "route kafka"), ("b.py", "kafka"), ("c.py", None)], "file string, body string")
    found = [("skip", "file", "^test_", "", 0.0), ("rest", "body", "route", "REST", 0.7), ("mq", "body", "kafka", "MQ", 0.6)]
    assert [r["label"] for r in rules.classify_first_match(df, found).collect()] == ["unknown", "REST", "MQ", "unknown"]


def test_responses_come_before_rules(spark):
    df = spark.createDataFrame([(1, "route"), (2, "route"), (3, "none")], "id int, body string")
    answers = spark.createDataFrame([(1, "CLI", 0.9), (1, "MQ", 0.4), (2, None, 1.0)], "id int, label string, confidence double")
    got = rules.classify_with_responses(df, answers, "id", [("rest", "body", "route", "REST", 0.7)])
    assert {r["id"]: (r["label"], r["basis"]) for r in got.collect()} == {1: ("CLI", "response"), 2: ("REST", "rest"), 3: ("unknown", "none")}


def test_sources_round_trip(spark, tmp_path):
    root = tmp_path / "kb" / "function"
    root.mkdir(parents=True)
    (root / "a.md").write_text("# A")
    (root / "b.txt").write_text("no")
    docs = io.scan_documents(spark, str(tmp_path / "kb"))
    assert [(r["path"], r["stem"]) for r in docs.collect()] == [("function/a.md", "a")]
    deep = tmp_path / "kb" / "x+(1)" / "kb"
    deep.mkdir(parents=True)
    for name in ("B.MD", "c.Md", "d.txt", ".md", "e.md.bak"):
        (deep / name).write_text("deep")
    paths = lambda *how: sorted(r["path"] for r in io.scan_documents(spark, *how).collect())
    assert paths(str(tmp_path / "kb"), (".md", ".txt")) == ["function/a.md", "function/b.txt", "x+(1)/kb/B.MD", "x+(1)/kb/c.Md", "x+(1)/kb/d.txt"]
    assert paths(str(tmp_path / "kb") + "/", (".md",)) == paths(f"file://{tmp_path}/kb") == ["function/a.md", "x+(1)/kb/B.MD", "x+(1)/kb/c.Md"]
    types = spark.createDataFrame([("fn", "function", r"\.md$"), ("other", None, None)], "type_id string, local_name string, file_pattern string")
    assert io.scan_instances(docs, types).first()["type_id"] == "fn"
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "label": "L"}], "edges": [{"source": "a", "target": "b", "relation": "r"}]}')
    nodes, edges = io.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 1 and edges.first()["dst"] == "b"
    rel = spark.createDataFrame([("s", "t")], "source string, target string")
    io.append_run_log(rel, str(tmp_path / "log"))
    io.append_run_log(rel, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_loose_names_of_calls(spark):
    e = spark.createDataFrame(
        [("k1", "load", "DbService", "a/db.py"), ("k2", "load", "Cache", "b/cache.py"), ("k3", "save", "X", "c/x_dao.py"), ("k4", "save", "W", "c/w.py"), ("k0", "save", "V", "c/v.py"), ("k5", "once", None, "d"), ("k6", "Thing", None, "e")],
        "key string, name string, class_name string, filename string",
    )
    c = spark.createDataFrame([(1, "dbService.load", ""), (2, "q.save", ""), (3, "q.once", ""), (4, "Thing.none", ""), (5, "Cache.load", ""), (6, "q.gone", ""), (7, "load", "")], "call_id int, name string, scope string")
    assert rows(graph.resolve_names(c, e, loose=True)) == [(1, "k1", 6), (2, "k3", 7), (3, "k5", 4), (4, "k6", 8), (5, "k2", 3), (7, "k1", 1)]
    assert rows(graph.resolve_names(c, e)) == [(1, "k1", 5), (2, "k0", 5), (3, "k5", 4), (5, "k2", 3), (7, "k1", 1)]


def test_contract_counts_and_sections(spark):
    text = "# T\n## Scope\nshort\n## Plan\n- [ ] one\n- [x] two\nTBD **REQ**\n"
    docs = spark.createDataFrame([(0, text), (1, text + "TBD TBD\n- [X] three"), (2, None)], "id int, t string")
    rules_ = [("plan", "heading", "Plan", 0), ("scope", "section", "Scope", 10), ("tbd", "at_most", "TBD", 1), ("boxes", "checkboxes", "", 3), ("req", "token", "TBD REQ", 0)]
    got = dict(rows(quality.contract_check(docs, rules_, "id", "t")))
    assert got == {0: ["boxes", "scope"], 1: ["scope", "tbd"], 2: ["boxes", "plan", "req"]}


def test_weighted_rules(spark):
    found = [("a", "optional", "x", 0.5), ("a", "exclude", "no", 0.0), ("b", "required", "y", 0.7), ("b", "required", "z", 0.2), ("c", "optional", "x", 0.5)]
    df = spark.createDataFrame([(1, "x"), (2, "x no"), (3, "y"), (4, "yz x"), (5, None), (6, "q")], "k int, t string")
    assert rows(rules.classify_weighted(df, found, "k", "t")) == [(1, "a", 0.5), (2, "c", 0.5), (3, "unknown", 0.0), (4, "b", 0.7), (5, "unknown", 0.0), (6, "unknown", 0.0)]


def test_ranks_of_a_hot_group(spark):
    data = [("hot", i) for i in range(3000)] + [(None, i) for i in range(50)] + [(f"g{i % 7}", i) for i in range(70)]
    df = spark.createDataFrame(data, "g string, i long").repartition(5)
    got = catalog.rank_within(df, ["g"], ["i"], "r", partitions=8)
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append((r["i"], r["r"]))
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values()) and {g: len(v) for g, v in by.items()} == Counter(g for g, _ in data)


def test_paths_carry_relations(spark):
    edges = spark.createDataFrame([("a", "b", "r2", "hi"), ("a", "b", "r1", "lo"), ("c", "b", "s", None)], "src string, dst string, relation string, confidence string")
    nodes = spark.createDataFrame([("a", "First node"), ("b", "Middle"), ("c", "Last node")], "id string, label string")
    assert rows(graph.path_between(nodes, edges, "first", "last node").orderBy("hop")) == [("a", "c", 1, "a", "b", "r1", "lo"), ("a", "c", 2, "b", "c", "s", None)]
    assert graph.path_between(nodes, edges, "first", "zzz").count() == 0


def test_intermediate_tables_can_be_released(spark):
    import os

    from tracewell.sources.shared import release_tables, write_shared

    path = write_shared(spark.range(3), "t").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and release_tables(spark) > 0 and not os.path.exists(path) and release_tables(spark) == 0


def strong_model(nodes, edges):
    """Smallest member of each node's component, by reach from every node."""
    out = {n: {d for s, d in edges if s == n and d in nodes} for n in nodes}

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for d in out[todo.pop()]:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return seen

    to = {n: reach(n) for n in nodes}
    return {n: min(m for m in to[n] if n in to[m]) for n in nodes}


@pytest.mark.parametrize(("n", "m", "seed"), [(30, 25, 1), (40, 60, 2), (60, 200, 3), (12, 0, 4)])
def test_strong_components_against_model(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, n), rng.randint(0, n - 1)) for _ in range(m)] + [(3, 3)]
    nodes = spark.range(n)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    want = strong_model(set(range(n)), edges)
    assert dict(rows(graph.strong_components(nodes, df))) == want
    layers = {r["id"]: (r["component"], r["layer"]) for r in graph.collapsed_layers(nodes, df).collect()}
    assert {k: c for k, (c, _) in layers.items()} == want

    def layer(c):
        return max((layer(want[d]) + 1 for s, d in edges if s in want and d in want and want[s] == c != want[d]), default=0)

    assert {k: x for k, (_, x) in layers.items()} == {k: layer(c) for k, c in want.items()}


def test_a_dense_cyclic_core_is_one_component_in_few_rounds(spark):
    n = 20_000
    i = F.col("id")
    ring = spark.range(n).select(i.alias("src"), ((i + 1) % n).alias("dst"))
    far = spark.range(4 * n).select((i % n).alias("src"), F.pmod(F.xxhash64(i), F.lit(n)).alias("dst"))
    tail = spark.range(50).select((i + n).alias("src"), F.when(i == 0, F.lit(0)).otherwise(i + n - 1).alias("dst"))
    edges = ring.union(far).union(tail)
    got = graph.collapsed_layers(spark.range(n + 50), edges).groupBy("component").agg(F.count("*").alias("c"), F.max("layer").alias("layer"))
    got = {r["component"]: (r["c"], r["layer"]) for r in got.collect()}
    assert got[0] == (n, 0) and len(got) == 51 and got[n + 49] == (1, 50)


def test_paths_from_both_ends_reach_less_of_a_hub_graph(spark):
    """Each end hangs on a line of three, and the lines on a hub with many leaves: the side with the small front goes on."""
    links = [(f"x{k}{i}", f"x{k}{i + 1}") for k in "ab" for i in range(3)] + [("xa3", "hub"), ("xb3", "hub")] + [("hub", f"leaf{i}") for i in range(300)]
    links += [(f"leaf{i}", f"twig{i}") for i in range(300)]
    stats = {}
    got = graph.shortest_paths(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([("xa0", "xb0")], "a string, b string"), 10, stats).collect()
    assert [tuple(r) for r in got] == [("xa0", "xb0", 8, ["xa0", "xa1", "xa2", "xa3", "hub", "xb3", "xb2", "xb1", "xb0"])]
    assert stats["reached"] < 320


def test_paths_to_one_end_share_its_search(spark):
    """Pairs with one end in common, two hubs away: that end is searched once for all, in whichever column it stands."""
    links = [(f"h{k}", "top") for k in range(3)] + [(f"c{k}_{i}", f"h{k}") for k in range(3) for i in range(60)]
    asked = [(f"c{k}_{i}", "c0_0") for k in range(3) for i in range(1, 60)]
    edges = spark.createDataFrame(links, "src string, dst string")
    for way in (1, -1):
        stats = {}
        got = graph.shortest_paths(edges, spark.createDataFrame([p[::way] for p in asked], "a string, b string"), 6, stats)
        got = {(r["a"], r["b"])[::way]: r["path"][::way] for r in got.collect()}
        assert got == {(a, b): [a, f"h{a[1]}", *(["top", "h0"] if a[1] != "0" else []), b] for a, b in asked}
        assert stats["reached"] < 3 * len(asked)


@pytest.mark.parametrize("seed", [1, 2])
def test_smallest_of_the_shortest_paths(spark, seed):
    rng = random.Random(seed)
    links = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    asked = [(rng.randint(0, 42), rng.randint(0, 42)) for _ in range(40)] + [(5, 5), (99, 99), (None, 1)]

    def best(a, b):
        paths = [[a]]
        for _ in range(6):
            hits = [p for p in paths if p[-1] == b]
            if hits:
                return len(hits[0]) - 1, min(hits)
            paths = [[*p, x] for p in paths for x in near.get(p[-1], ()) if x not in p]
        return None

    want = {(a, b): best(a, b) for a, b in asked if a is not None and best(a, b)}
    df = graph.shortest_paths(spark.createDataFrame(list(links), "src long, dst long"), spark.createDataFrame(asked, "a long, b long"), 5)
    assert {(r["a"], r["b"]): (r["hops"], r["path"]) for r in df.collect()} == want


def test_ratios_are_computed_for_few_pairs_only():
    rng = random.Random(1)
    colours = [f"colour{chr(97 + i)}{chr(97 + i * 7 % 26)}" for i in range(26)]
    names = [" ".join(rng.choices(colours, k=3)) for _ in range(600)]
    tile = search.NameTile(names, [set(n.split()) for n in names])
    tried = 0
    for q in names[:20]:
        found, n = tile.best(q, set(q.split()), 5)
        tried += n
        assert len(found) == 5 and names[max(found, key=lambda f: f[1])[0]] == q
    assert tried < 20 * 600 / 3


def test_fuzzy_search_with_odd_names(spark):
    data = [(1, None), (2, ""), (3, "a"), (4, "A b"), (5, "ab"), (6, "日本語"), (7, "日 本"), (None, "ab"), (8, "ab")]
    names = spark.createDataFrame(data, "id long, name string")
    asked = spark.createDataFrame([("ab",), ("本語",), ("  ",), (None,), ("zzz",), ("ab",)], "query string")
    got = {}
    for r in search.fuzzy_search(names, asked, 3).collect():
        got.setdefault(r["query"], []).append((-r["score"], r["id"]))
    assert sorted(got["ab"]) == [(-1.0, 5), (-1.0, 8), (-0.66, 4)] and min(got["本語"])[1] == 6 and "zzz" not in got and "  " not in got
    assert search.fuzzy_search(names.limit(0), asked, 3).count() == 0
    pair = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "q string, n string")
    assert [r["x"] for r in pair.select(search.sequence_ratio("q", "n").alias("x")).collect()] == [0.25, 0.5]


def test_keyword_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abC dé", k=rng.randint(0, 30))) for _ in range(120)] + [None, "", "ab", texts_twice := "abc abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts_twice])], "id long, body string").repartition(3)
    index = search.KeywordIndex(spark, str(tmp_path / "index"), buckets=4)
    words = ["abc", "a", "é", "C d", "dabc", "nothing", "AB"]
    assert index.search(df, "id", "body", words).count() == 0
    assert index.add(df.filter("id % 2 = 0"), "body") + index.add(df, "body") == len({t for t in texts if t is not None}) and index.add(df, "body") == 0
    assert rows(index.search(df, "id", "body", words)) == rows(search.keyword_search(df, "id", "body", words))
    asked = spark.createDataFrame([("dabc",), ("nothing",)], "word string")
    assert index.candidates(asked).count() < 20


def test_keyword_index_packs_its_lists(spark, tmp_path):
    """One row a triple and chunk, not one a triple and text; lists of any gaps come back as they were."""
    import numpy as np

    rng = random.Random(8)
    df = spark.createDataFrame([(i, "".join(rng.choices("abcde", k=200)) + ("needle" if i % 50 == 0 else "")) for i in range(400)], "id long, body string").repartition(2)
    index = search.KeywordIndex(spark, str(tmp_path / "index"), buckets=4, chunk=5000)
    assert index.add(df, "body") == 400
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert stored.filter("gram IS NOT NULL").count() < 400 * 125 / 5 and stored.select("chunk").distinct().count() > 4
    assert sorted(r["id"] for r in index.search(df, "id", "body", ["NEEDLE"]).collect()) == list(range(0, 400, 50))
    lists = [sorted(rng.sample(range(most), n)) for most, n in ((5, 5), (300, 3), (1 << 20, 40), (1 << 30, 9), (1, 1))]
    flat, first = np.array([x for one in lists for x in one]), np.cumsum([0] + [len(one) for one in lists])[:-1]
    raw, size = search.pack_numbers(flat, first)
    cuts = np.append(np.cumsum(size) - size, len(raw))[np.append(first, len(flat))]
    assert [search.unpack_numbers(raw[a:b].tobytes()).tolist() for a, b in zip(cuts, cuts[1:])] == lists


# ---------------------------------------------------------------- stored vectors


def test_vector_index_against_all_rows(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8)) * 4
    x = middle[rng.integers(0, 12, 900)] + rng.normal(scale=0.2, size=(900, 8))
    x[100:160] = x[100]  # copies tie
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 8), (2003, [None] + [1.0] * 7), (2004, [float("inf")] * 8), (2005, []), (None, [9.0] * 8)]
    df = spark.createDataFrame(data + odd, "id long, v array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in data if i % 20 == 0] + [(5000, [0.0] * 8)] + odd[:6], "query_id long, query_vector array<double>")
    index = VectorIndex(spark, str(tmp_path / "cells"), 8, cells=16)
    assert index.search(asked, "id").count() == 0
    assert index.add(df.filter("id < 300"), "id", "v") == 300 and index.add(df, "id", "v") == 600 and index.add(df, "id", "v") == 0
    good = df.filter("id < 1000")
    for k, least, blocks in ((5, -1e9, (512, 4096)), (70, 3.0, (7, 50)), (2000, -1e9, (512, 4096))):
        got = rows(index.search(asked, "id", k, least, query_block=blocks[0], base_block=blocks[1]))
        assert got == rows(search.vector_search(good, asked.filter("query_id < 1000 OR query_id = 5000"), "id", "v", k, least))
        if k == 5:
            # all but the zero vector, which ties with everything, ask few cells
            assert sum(f["pairs"] for f in index.figures) < 46 * 16 / 2
    assert rows(index.search(asked.limit(0), "id")) == []


def test_cells_left_out_hold_nothing_better():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    centres = fit_centres(x, 20)
    cell = np.argmin(((x[:, None] - centres) ** 2).sum(2), axis=1)
    radius = np.array([np.linalg.norm(x[cell == c] - centres[c], axis=1).max(initial=0) for c in range(len(centres))])
    q = rng.normal(size=(30, 6))
    floor = np.sort(q @ x.T, axis=1)[:, -3]
    left_out = 0
    for v, f, here in zip(q, floor, open_cells(q, floor, centres, radius, 0, 20), strict=True):
        assert all(cell[i] in here for i in np.flatnonzero(x @ v >= f))
        left_out += 20 - len(here)
    assert left_out > 100
    assert len(fit_centres(np.ones((5, 3)), 4)) == 1


def test_coverage_is_one_pass_in_small_tasks(spark):
    lines = spark.createDataFrame([(f"f{i % 9}", i // 9, i % 4, i % 3, i % 2) for i in range(900)], "path string, line int, hits int, b int, k int")
    changed = lines.filter("path <> 'f8'").select("path")
    got = quality.incremental_coverage(lines, changed, branches=("b", "k"), lines_a_task=50)
    assert got.rdd.getNumPartitions() == 18
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the changed files only
    assert rows(got) == rows(quality.incremental_coverage(lines, changed, branches=("b", "k")))
    f0 = got.filter("path = 'f0'").first()
    assert (f0["total"], f0["covered"], f0["gaps"]) == (100, 75, ",".join(str(i) for i in range(0, 100, 4))) and f0["branch_percent"] is None
