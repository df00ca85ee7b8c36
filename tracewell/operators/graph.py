"""Call and knowledge graphs: name resolution, layers, trees, breadth-first search and paths.

Loops run on written tables: a round is one join and one anti-join, and lineage never grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import label_tokens
from tracewell.operators.batches import bound_batches
from tracewell.operators.bounded import broadcast_if_small
from tracewell.operators.components import connected_components
from tracewell.operators.search import deal_tiles
from tracewell.sources.shared import write_shared


def resolve_names(calls: DataFrame, elements: DataFrame, loose: bool = False, preferred_files: str = "service|dao|repository") -> DataFrame:
    """(call_id, key, rule): the element of each call (call_id, name, scope) by the first rule that fits.

    1 exact name; 2 ``self.``/``super().`` in the caller's class; 3 ``Class.method`` or ``Class::method``; 4 the only
    element of that last name; 5 ``obj.method`` by method alone. Ties go to the smaller key. ``elements`` (key, name, class_name[, filename]).
    With ``loose`` (names of objects stand for their classes) a class name that ends with or holds the object's name comes
    before rule 4 as rule 6, an element in a file named like ``preferred_files`` before rule 5 as rule 7, and where no
    element has the method the object's own name is looked up as rule 8.

    Elements are reduced to their smallest key a name, and a name and class, before any call meets them, so a method name that
    many elements share costs one row. Only the loose rule on class names compares objects with classes: each distinct pair of method and object once, with those
    of its method's classes that hold the first three letters of the object's name.
    """
    bare = F.regexp_extract("name", r"([^.:]+)$", 1)
    owner = F.regexp_extract("name", r"([^.:()]+)(?:\(\))?(?:\.|::)[^.:]+$", 1)
    c = calls.select("call_id", "scope", bare.alias("_last"), owner.alias("_owner"))
    first = elements.groupBy(F.col("name").alias("_last")).agg(F.min("key").alias("_any"), F.count("*").alias("_n"))
    by_class = elements.filter("class_name IS NOT NULL").groupBy(F.col("name").alias("_last"), F.col("class_name").alias("_class")).agg(F.min("key").alias("_key"))
    mine = F.when(F.col("_owner").isin("self", "super", "this"), F.col("scope")).otherwise(F.col("_owner"))
    rows = c.withColumn("_class", mine).join(first, "_last", "left").join(by_class, ["_last", "_class"], "left")
    is_self, owned = F.col("_owner").isin("self", "super", "this"), F.col("_owner") != ""
    tries = [(~owned, "_any", 1), (is_self & F.col("_key").isNotNull(), "_key", 2), (owned & ~is_self & F.col("_key").isNotNull(), "_key", 3)]
    if loose:
        o, k = F.lower("_owner"), F.lower("_class")
        # a class that holds the object's name holds its first three letters: they join the method in the key, so that a common method is many keys
        start = lambda n: F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.substr(k, i, F.lit(n)))
        grams = F.array_distinct(F.concat(start(1), start(2), start(3)))
        held = by_class.filter(F.length("_class") > 0).select("_last", "_class", "_key", F.explode(grams).alias("_gram"))
        open_ = rows.filter(owned & F.col("_key").isNull() & ~is_self).select("_last", "_owner").distinct().withColumn("_gram", F.left(o, F.lit(3)))
        like = open_.join(held, ["_last", "_gram"]).filter(F.contains(k, o)).groupBy("_last", "_owner").agg(F.min("_key").alias("_like"))
        file = elements.filter(F.lower("filename").rlike(preferred_files)).groupBy(F.col("name").alias("_last")).agg(F.min("key").alias("_file"))
        name = elements.groupBy(F.col("name").alias("_owner")).agg(F.min("key").alias("_named"))
        rows = rows.join(like, ["_last", "_owner"], "left").join(file, "_last", "left").join(name, "_owner", "left")
        tries += [(F.col("_like").isNotNull(), "_like", 6), (F.col("_n") == 1, "_any", 4), (F.col("_file").isNotNull(), "_file", 7), (F.col("_any").isNotNull(), "_any", 5), (F.col("_named").isNotNull(), "_named", 8)]
    else:
        tries += [(F.col("_n") == 1, "_any", 4), (F.col("_any").isNotNull(), "_any", 5)]
    key = rule = None
    for ok, found, number in tries:
        ok = F.coalesce(ok & F.col(found).isNotNull(), F.lit(False))
        key = F.when(ok, F.col(found)) if key is None else key.when(ok, F.col(found))
        rule = F.when(ok, number) if rule is None else rule.when(ok, number)
    return rows.select("call_id", key.alias("key"), rule.alias("rule")).filter("key IS NOT NULL")


@lru_cache(maxsize=1)
def _automaton(names: tuple[str, ...]) -> ahocorasick.Automaton:
    """One automaton over all names, kept by a worker from task to task."""
    made = ahocorasick.Automaton()
    for i, n in enumerate(names):
        made.add_word(n, i)
    made.make_automaton()
    return made


def mention_edges(
    texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name_key: str = "item_id", name: str = "text", max_broadcast: int = 100_000, max_characters: int = 2_000_000
) -> DataFrame:
    """(key, name_key) where the text contains the whole name, each pair once; null and empty names are in no text.

    Names of ``max_characters`` in all are sent to the tasks as one automaton that reads every text once: the work is the length of the
    texts and what they hold, however common a name's words are, and no word is shuffled. More names than that are looked up
    by their rarest inner word (``_mentions_by_word``).
    """
    want = write_shared(names.select(F.col(name_key).alias("_nk"), F.col(name).alias("_name")).filter(F.col("_name") != ""), "names")
    docs = texts.select(F.col(key).alias("_dk"), F.col(text).alias("_text"))
    distinct = want.select("_name").distinct()
    characters = distinct.agg(F.sum(F.length("_name"))).first()[0] or 0
    if characters <= max_characters:
        bound_batches(texts.sparkSession)
        patterns = tuple(sorted(r["_name"] for r in distinct.collect()))  # bounded by the sum of their lengths

        @F.pandas_udf("array<int>")
        def held(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            found = _automaton(patterns)
            for some in parts:
                yield pd.Series([sorted({i for _, i in found.iter(t)}) if t and patterns else [] for t in some], dtype=object)

        numbered = texts.sparkSession.createDataFrame(list(enumerate(patterns)), "_i int, _name string")
        of_name = broadcast_if_small(write_shared(want.join(numbered, "_name").select("_i", "_nk"), "numbered-names"), max_broadcast)
        found = docs.select("_dk", F.explode(held("_text")).alias("_i")).join(of_name, "_i").select("_dk", "_nk")
    else:
        found = _mentions_by_word(docs, want, max_broadcast)
    return found.select(F.col("_dk").alias(key), F.col("_nk").alias(name_key)).distinct()


def _mentions_by_word(docs: DataFrame, names: DataFrame, max_broadcast: int) -> DataFrame:
    """(_dk, _nk): a text is compared only with names it can hold.

    A word that stands between two spaces in the name stands between two spaces in every text that holds it, or at a
    text's end: of each name the inner word that the fewest texts have is looked up among the words of the texts, and only those pairs
    are tested. Names without an inner word are tested against all texts, in tiles.
    """
    parts = F.split(F.col("_name"), " ", -1)
    inner = F.array_distinct(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != ""))
    want = write_shared(names.withColumn("_inner", inner), "names")
    candidates = write_shared(want.select(F.explode("_inner").alias("_w")).distinct(), "name-words")
    words = docs.select("_dk", F.explode(F.array_distinct(F.split("_text", " ", -1))).alias("_w"))
    few = broadcast_if_small(candidates, max_broadcast)
    hits = write_shared(words.join(few, "_w", "left_semi"), "name-word-hits")
    counts = hits.groupBy("_w").agg(F.count("*").alias("_c"))
    rare = want.select("_nk", F.explode("_inner").alias("_w")).join(counts, "_w", "left")
    rare = rare.groupBy("_nk").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), F.col("_w"))).alias("_r")).select("_nk", "_r._w")
    pairs = write_shared(hits.join(broadcast_if_small(write_shared(rare, "rare-words"), max_broadcast), "_w").select("_dk", "_nk").distinct(), "name-pairs")
    found = docs.join(broadcast_if_small(pairs, max_broadcast), "_dk").join(want.select("_nk", "_name"), "_nk").filter(F.contains("_text", "_name")).select("_dk", "_nk")
    short = want.filter(F.size("_inner") == 0).select("_nk", "_name")
    if not short.isEmpty():
        rows, asked = deal_tiles(docs, "_dk", short, "_nk")
        found = found.unionByName(rows.join(asked, ["_qb", "_bb"]).filter(F.contains("_text", "_name")).select("_dk", "_nk"))
    return found


def lookup_element(df: DataFrame, elements: DataFrame, ref: str = "ref") -> DataFrame:
    """``df`` with ``key``: by uuid, then by ``name###uuid``, then by the stored uuid; an empty reference finds none."""
    ok = F.nullif(F.col(ref), F.lit(""))
    uuid = elements.select("key", F.nullif(F.split_part("key", F.lit("###"), F.lit(2)), F.lit("")).alias("_u")).dropna().groupBy("_u").agg(F.min("key").alias("_k1"))
    exact = elements.select(F.col("key").alias("_k2")).distinct()
    stored = elements.select("key", F.col("uuid").alias("_s")).dropna().groupBy("_s").agg(F.min("key").alias("_k3"))
    rows = df.join(uuid, ok == F.col("_u"), "left").join(exact, ok == F.col("_k2"), "left").join(stored, ok == F.col("_s"), "left")
    return rows.withColumn("key", F.coalesce("_k1", "_k2", "_k3")).drop("_u", "_s", "_k1", "_k2", "_k3")


def merge_decl_impl(decl: DataFrame, impl: DataFrame) -> DataFrame:
    """Declarations with the body, file and dependencies of their first implementation (class_name, name); access stays the declared one."""
    first = F.row_number().over(Window.partitionBy("class_name", "name").orderBy("key"))
    body = impl.withColumn("_r", first).filter("_r = 1").select(
        F.col("class_name").alias("_c"), F.col("name").alias("_n"), F.col("content").alias("_content"), F.col("filename").alias("_file"), F.col("dependencies").alias("_deps")
    )
    rows = decl.join(body, F.col("class_name").eqNullSafe(F.col("_c")) & (F.col("name") == F.col("_n")), "left")
    take = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old)).alias(old)
    rest = [c for c in decl.columns if c not in ("content", "filename", "dependencies")]
    return rows.select(*rest, take("_content", "content"), take("_file", "filename"), F.coalesce("_deps", "dependencies").alias("dependencies"))


def topo_layers(nodes: DataFrame, edges: DataFrame, max_layers: int = 10_000) -> DataFrame:
    """(id, layer): a node's layer is 0 without dependencies, else one more than the last of those it depends on.

    ``edges`` (src depends on dst). Where no node is free, only cycles are left: of each connected group of open nodes the one with the
    fewest dependencies, done ones included, is released (ties to the smallest id), so that many separate cycles cost one round. Self links and
    links to unknown nodes are dropped. A round counts down the open dependencies and writes the nodes that are left; links are
    written anew when half of the nodes are done. Joins are merges: a broadcast in each round would pass through the driver. More than
    ``max_layers`` rounds are an error.
    """
    ids = nodes.select("id").distinct()
    links = edges.select("src", "dst").filter("src <> dst").distinct()
    links = links.join(ids.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_semi")
    links = write_shared(links, "open-links")
    counts = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    left = write_shared(ids.join(counts.hint("merge"), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n", F.lit(0)).alias("n0")), "open-nodes")
    total, free = left.agg(F.count("*"), F.count_if(F.col("n") == 0)).first()
    compact, done = total, None
    for layer in range(max_layers + 1):
        if total == 0:
            break
        if layer == max_layers:
            raise RuntimeError(f"{total} nodes are left after {max_layers} layers")
        if free == 0:
            inside = links.join(left.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi").join(left.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi")
            groups = connected_components(inside, "src", "dst", merge=True).withColumnRenamed("node", "id")
            head = left.join(groups.hint("merge"), "id").groupBy("component").agg(F.min(F.struct("n0", "id")).alias("h")).select("h.id")
            left = write_shared(left.join(head.withColumn("_r", F.lit(True)).hint("merge"), "id", "left").select("id", F.when(F.col("_r"), 0).otherwise(F.col("n")).cast("long").alias("n"), "n0"), "open-nodes")
        ready = left.filter("n = 0").select("id")
        now = ready.withColumn("layer", F.lit(layer))
        done = now if done is None else done.unionByName(now)
        gone = links.join(ready.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_gone"))
        left = write_shared(left.filter("n > 0").join(gone.hint("merge"), "id", "left").select("id", (F.col("n") - F.coalesce("_gone", F.lit(0))).alias("n"), "n0"), "open-nodes")
        total, free = left.agg(F.count("*"), F.count_if(F.col("n") == 0)).first()
        if total < compact / 2:
            compact = total
            links = write_shared(links.join(left.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi"), "open-links")
    return done if done is not None else ids.withColumn("layer", F.lit(0))


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, component): the smallest node of each node's strongly connected component, the set of nodes that reach each other.

    Trimming and colouring. Nodes without an open link in or out are components of their own. The others draw a rank, and along the links each takes
    the first rank that reaches it; what a colour's node of that rank can be reached from, inside the colour, is its component. Links between colours
    go, and the rest starts again with new ranks, so the number of turns grows with the logarithm of the components in a row; a turn
    takes as many rounds as a component is wide. Each round ends with a written table; nothing but counts comes to the driver.
    Self links and links to unknown nodes are dropped. More than ``max_rounds`` rounds are an error.
    """
    ids = write_shared(nodes.select("id").filter("id IS NOT NULL").distinct(), "graph-nodes")
    links = edges.select("src", "dst").filter("src <> dst").distinct()
    links = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = write_shared(links, "open-links")
    found, rounds, turn = None, 0, 0
    inside = lambda rows, of: rows.join(of.select(F.col("id").alias("src")), "src", "left_semi").join(of.select(F.col("id").alias("dst")), "dst", "left_semi")
    while True:
        before = None
        for _ in range(3):  # long chains go by colours
            open_ = links.select(F.col("src").alias("id")).intersect(links.select(F.col("dst").alias("id")))
            links = write_shared(inside(links, open_), "open-links")
            now = links.count()
            if now in (0, before):
                break
            before = now
        if now == 0:
            break
        left = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
        rank = F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), F.col("id").alias("of"))
        colour = write_shared(left.select("id", rank.alias("c"), F.lit(True).alias("new")), "colours")
        while True:
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"no end after {max_rounds} rounds")
            sent = links.join(colour.filter("new").select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("s"))
            better = F.coalesce(F.col("s") < F.col("c"), F.lit(False))
            colour = write_shared(colour.join(sent, "id", "left").select("id", F.when(better, F.col("s")).otherwise(F.col("c")).alias("c"), better.alias("new")), "colours")
            if colour.filter("new").isEmpty():
                break
        by = lambda name: colour.select(F.col("id").alias(name), F.col("c.of").alias(f"_{name}"))
        links = write_shared(links.join(by("src"), "src").join(by("dst"), "dst").filter("_src = _dst").select("src", "dst"), "open-links")
        front = write_shared(colour.filter(F.col("c.of") == F.col("id")).select("id", F.col("id").alias("component")), "component-front")
        got = front
        while True:
            rounds += 1
            back = links.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "component").distinct()
            front = write_shared(back.join(got.select("id"), "id", "left_anti"), "component-front")
            if front.isEmpty():
                break
            got = got.unionByName(front)
        got = write_shared(got, "components-found")
        found = got if found is None else found.unionByName(got)
        done = got.select(F.col("id").alias("_id"))
        links = write_shared(links.join(done, F.col("src") == F.col("_id"), "left_anti").join(done, F.col("dst") == F.col("_id"), "left_anti"), "open-links")
        turn += 1
    if found is None:
        return ids.withColumn("component", F.col("id"))
    names = found.groupBy("component").agg(F.min("id").alias("_least"))
    rows = found.join(names, "component").select("id", F.col("_least").alias("component"))
    return ids.join(rows, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def collapsed_layers(nodes: DataFrame, edges: DataFrame, max_layers: int = 10_000) -> DataFrame:
    """(id, component, layer) with each cycle taken as one: the members of a strongly connected component share a layer, which is
    one more than the last layer among what any of them depends on outside it. The number of rounds grows with the layers, not with the cycles."""
    groups = write_shared(strong_components(nodes, edges), "strong-components")
    end = lambda name: groups.select(F.col("id").alias(name), F.col("component").alias(f"_{name}"))
    between = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).filter("src <> dst")
    layers = topo_layers(groups.select(F.col("component").alias("id")), between, max_layers).withColumnRenamed("id", "component")
    return groups.join(layers, "component").select("id", "component", "layer")


def call_trees(roots: DataFrame, edges: DataFrame, max_depth: int = 10, max_nodes: int | None = None) -> DataFrame:
    """(root, node, parent, depth): nodes reached from each root, at their least depth; parent is the smallest at that depth.

    With ``max_nodes`` a tree that has more nodes than that grows no further; the depth that passed the number is whole.

    The first depth is a mark on the written calls, which lie together by caller. Later ones meet only the calls of what is itself
    called, and where no callee calls anything there are none.
    """
    kind = roots.schema["id"].dataType
    first = write_shared(roots.select(F.col("id").alias("root")).distinct(), "tree-roots")
    seen = first.select("root", F.col("root").alias("node"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("parent"), F.lit(0).alias("depth"))
    if max_depth < 1 or (max_nodes is not None and max_nodes < 1):
        return seen
    step = edges.select(F.col("src").alias("node"), "dst").filter("node <> dst").distinct()
    step = write_shared(step.join(first.select(F.col("root").alias("node"), F.lit(True).alias("starts")), "node", "left"), "calls")
    front = step.filter("starts").select(F.col("node").cast(kind).alias("root"), F.col("dst").alias("node"), F.col("node").alias("parent"), F.lit(1).alias("depth"))
    seen = seen.unionByName(front)
    if max_depth == 1:
        return seen
    onward = write_shared(step.select(F.col("dst").alias("node")).distinct().join(step.select("node").distinct(), "node", "left_semi"), "called-callers")
    if onward.isEmpty():
        return seen
    step = write_shared(step.select("node", "dst").join(onward, "node", "left_semi"), "calls")
    for depth in range(2, max_depth + 1):
        if max_nodes is not None:
            full = seen.groupBy("root").count().filter(F.col("count") > max_nodes).select("root")
            front = front.join(full, "root", "left_anti")
        new = front.select("root", "node").join(step, "node").groupBy("root", F.col("dst")).agg(F.min("node").alias("parent"))
        new = new.select("root", F.col("dst").alias("node"), "parent", F.lit(depth).alias("depth")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = write_shared(new, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def call_roots(nodes: DataFrame, edges: DataFrame, max_depth: int = 10, max_rounds: int = 10_000) -> DataFrame:
    """Nodes from which calls start: every node is a root or within ``max_depth`` calls of one.

    All nodes that no other node calls are roots. What they do not reach (cycles without a caller, and what lies
    too deep) gets further roots by layer (``topo_layers``), the highest first: all unreached nodes of that layer at once. No join is a broadcast.
    """
    ids = write_shared(nodes.select("id").distinct(), "callable")
    calls = edges.select("src", "dst").filter("src <> dst").distinct()
    calls = write_shared(calls.join(ids.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_semi"), "calls")
    new = write_shared(ids.join(calls.select(F.col("dst").alias("id")).hint("merge"), "id", "left_anti"), "roots")
    roots, left, layers = new, ids, None
    for _ in range(max_rounds):
        front = new
        left = write_shared(left.join(front.hint("merge"), "id", "left_anti"), "unreached")
        for _ in range(max_depth):
            near = calls.join(front.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            front = write_shared(near.join(left.hint("merge"), "id", "left_semi"), "front")
            if front.isEmpty():
                break
            left = write_shared(left.join(front.hint("merge"), "id", "left_anti"), "unreached")
        if left.isEmpty():
            return roots
        layers = layers if layers is not None else write_shared(topo_layers(ids, calls), "layers")
        rest = layers.join(left.hint("merge"), "id", "left_semi")
        new = write_shared(rest.filter(F.col("layer") == rest.agg(F.max("layer")).first()[0]).select("id"), "roots")
        roots = roots.unionByName(new)
    raise RuntimeError(f"nodes are left after {max_rounds} rounds")


def root_functions(trees: DataFrame, elements: DataFrame) -> DataFrame:
    """Roots with name and uuid split from ``name###uuid``, their element and the size of their tree."""
    sizes = trees.groupBy("root").agg(F.count("*").alias("reached"), F.max("depth").alias("depth"))
    parts = sizes.select(F.col("root").alias("key"), F.split_part("root", F.lit("###"), F.lit(1)).alias("root_name"), F.split_part("root", F.lit("###"), F.lit(2)).alias("uuid"), "reached", "depth")
    return parts.join(elements, "key", "left")


def bfs_subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node, depth): undirected neighbours of the seeds layer by layer."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    both = write_shared(both.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to"))).distinct(), "both-ways")
    front = write_shared(seeds.select(F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0)), "front")
    seen = front
    for d in range(1, depth + 1):
        new = front.select("node").join(both, "node").select(F.col("to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = write_shared(new.withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def touching_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges with both ends among the found nodes."""
    ids = found.select("node")
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10, stats: dict | None = None, max_broadcast: int = 300_000) -> DataFrame:
    """(a, b, hops, path) for each pair that is connected within ``max_depth`` undirected hops; ties to the smallest path.

    Searched from both ends: a pair lets the end go one step on whose step costs it less, until the two sides meet. A step costs the links of the end's
    front, shared by the open pairs of that end, so that an end of many pairs is searched once for all and a small front at a hub waits. Where sides
    meet is looked up from the smaller one. Each step keeps the links by which a node was first reached: paths are followed
    along these alone, never along all links of a node. ``stats`` gets the number of rows reached from all ends.
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    both = write_shared(both.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to"))).filter("node <> to").distinct(), "both-ways")
    degrees = write_shared(both.groupBy("node").agg(F.count("*").alias("w")), "degrees")
    pairs = write_shared(pairs.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "pairs")
    ends = write_shared(pairs.select(F.col("a").alias("end")).union(pairs.select(F.col("b").alias("end"))).distinct(), "path-ends")
    few = lambda df: broadcast_if_small(df, max_broadcast)
    known = degrees.select(F.col("node").alias("end")).join(few(ends), "end").unionByName(pairs.filter("a = b").select(F.col("a").alias("end"))).distinct()
    none = F.lit(None).cast(both.schema["node"].dataType)
    seen = front = grown = write_shared(known.select("end", F.col("end").alias("node"), F.lit(0).alias("d"), none.alias("up")), "path-front")
    cost = lambda rows: degrees.join(few(rows.select("end", "node")), "node").groupBy("end").agg(F.sum("w").alias("_w"))
    one = F.lit(1).cast("long")
    sizes = front.join(cost(front), "end", "left").select("end", one.alias("n"), F.coalesce("_w", F.lit(0)).alias("w"), one.alias("all"), one.alias("new"), F.lit(0).alias("depth"))
    found = links = None
    sized = ["n", "w", "all", "new", "depth"]

    def with_sizes(open_: DataFrame) -> DataFrame:
        side = lambda x: sizes.select(F.col("end").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in sized])
        return write_shared(open_.select("a", "b").join(side("a"), "a").join(side("b"), "b"), "open-pairs")

    def meet(x: str, y: str) -> DataFrame:
        """Open pairs of which something new from end ``x`` has been reached from end ``y``."""
        mine = grown.select(F.col("end").alias(x), "node", F.col("d").alias("_x"))
        other = seen.select(F.col("end").alias(y), "node", F.col("d").alias("_y"))
        rows = open_.filter(F.col(f"{x}_new") > 0).select("a", "b", "a_depth", (F.col(f"{x}_new") <= F.col(f"{y}_all")).alias("_less"))
        met = rows.filter("_less").join(mine, x).join(other, [y, "node"]).select("a", "b", "a_depth", "_x", "_y")
        met = met.unionByName(rows.filter("NOT _less").join(other, y).join(mine, [x, "node"]).select("a", "b", "a_depth", "_x", "_y"))
        return met.select("a", "b", "a_depth", (F.col("_x") + F.col("_y")).alias("hops"))

    sizes = write_shared(sizes, "front-sizes")
    open_ = with_sizes(pairs)
    for _ in range(2 * max_depth + 1):
        met = meet("a", "b").unionByName(meet("b", "a")).groupBy("a", "b").agg(F.min("hops").alias("hops"), F.min("a_depth").alias("_da")).filter(F.col("hops") <= max_depth)
        met = write_shared(met.select("a", "b", "hops", F.least("_da", "hops").alias("split")), "met-pairs")
        found = met if found is None else found.unionByName(met)
        # a pair stays open while both ends have a front and may be near enough
        rest = open_.join(met, ["a", "b"], "left_anti").filter((F.col("a_n") > 0) & (F.col("b_n") > 0) & (F.col("a_depth") + F.col("b_depth") < max_depth))
        rest = write_shared(rest, "open-pairs")
        if rest.isEmpty():
            break
        times = rest.select(F.col("a").alias("end")).union(rest.select(F.col("b").alias("end"))).groupBy("end").agg(F.count("*").alias("m"))
        share = rest.join(times.select(F.col("end").alias("a"), F.col("m").alias("_ma")), "a").join(times.select(F.col("end").alias("b"), F.col("m").alias("_mb")), "b")
        go = F.when(F.col("a_w") / F.col("_ma") <= F.col("b_w") / F.col("_mb"), F.col("a")).otherwise(F.col("b"))
        go = write_shared(share.select(go.alias("end")).distinct(), "growing-ends")
        step = write_shared(front.join(few(go), "end", "left_semi").select("end", "node", "d"), "growing-front")
        step = both.join(few(step), "node").select("end", F.col("to").alias("node"), F.col("node").alias("prev"), (F.col("d") + 1).alias("d"))
        step = write_shared(step.join(seen.select("end", "node"), ["end", "node"], "left_anti"), "path-links")
        links = step if links is None else links.unionByName(step)
        grown = write_shared(step.groupBy("end", "node").agg(F.min("d").alias("d"), F.min("prev").alias("up")), "path-front")
        front = write_shared(front.join(few(go), "end", "left_anti").unionByName(grown), "path-front")
        seen = seen.unionByName(grown)
        steps = sizes.join(go.withColumn("_go", F.lit(True)), "end", "left").join(grown.groupBy("end").agg(F.count("*").alias("_n")), "end", "left").join(cost(grown), "end", "left")
        moved, n = F.col("_go").isNotNull(), F.coalesce("_n", F.lit(0))
        sizes = steps.select(
            "end", F.when(moved, n).otherwise(F.col("n")).alias("n"), F.when(moved, F.coalesce("_w", F.lit(0))).otherwise(F.col("w")).alias("w"),
            (F.col("all") + n).alias("all"), n.alias("new"), (F.col("depth") + moved.cast("int")).alias("depth"),
        )
        sizes = write_shared(sizes, "front-sizes")
        open_ = with_sizes(rest)
    if stats is not None:
        stats["reached"] = seen.count()
    found = write_shared(found.withColumn("left", F.col("hops") - F.col("split")), "found-pairs")
    if links is None:  # no end made a step
        return found.select("a", "b", "hops", F.array("a").alias("path"))
    # nodes in the middle of each pair's shortest paths, from the side that has fewer at that depth
    at_a, at_b = seen.select(F.col("end").alias("a"), "node", F.col("d").alias("split")), seen.select(F.col("end").alias("b"), "node", F.col("d").alias("left"))
    held = write_shared(seen.groupBy("end", "d").agg(F.count("*").alias("n")), "level-sizes")
    both_sizes = found.join(held.select(F.col("end").alias("a"), F.col("d").alias("split"), F.col("n").alias("_na")), ["a", "split"])
    both_sizes = both_sizes.join(held.select(F.col("end").alias("b"), F.col("d").alias("left"), F.col("n").alias("_nb")), ["b", "left"])
    level = both_sizes.filter("_na <= _nb").join(at_a, ["a", "split"]).join(at_b, ["b", "node", "left"]).select("a", "b", "split", "node")
    level = level.unionByName(both_sizes.filter("_na > _nb").join(at_b, ["b", "left"]).join(at_a, ["a", "node", "split"]).select("a", "b", "split", "node"))
    level = write_shared(level.select("a", "b", "node", F.col("split").alias("i")), "on-paths")
    useful, back = level, links.select(F.col("end").alias("a"), "node", "prev")
    for _ in range(max_depth):
        level = write_shared(level.filter("i > 1").join(back, ["a", "node"]).select("a", "b", F.col("prev").alias("node"), (F.col("i") - 1).alias("i")).distinct(), "on-paths")
        if level.isEmpty():
            break
        useful = useful.unionByName(level)
    ahead_of = useful.join(back, ["a", "node"]).select("a", "b", "i", F.col("prev").alias("node"), F.col("node").alias("to"))
    ahead_of = write_shared(ahead_of, "steps-on-paths")
    behind_of = seen.filter("up IS NOT NULL").select(F.col("end").alias("b"), "node", F.col("up").alias("to"))
    walk = found.select("a", "b", "hops", "split", F.col("a").alias("node"), F.array("a").alias("path"))
    done = None
    for d in range(max_depth + 1):
        walk = write_shared(walk, "walks")
        here = walk.filter(F.col("hops") == d).select("a", "b", "hops", "path")
        done = here if done is None else done.unionByName(here)
        walk = walk.filter(F.col("hops") > d)
        if walk.isEmpty():
            break
        ahead = walk.filter(F.col("split") > d).join(ahead_of.filter(F.col("i") == d + 1), ["a", "b", "node"])
        behind = walk.filter(F.col("split") <= d).join(behind_of, ["b", "node"])
        keep = ["a", "b", "hops", "split", "path", "to"]
        walk = ahead.select(*keep).unionByName(behind.select(*keep)).groupBy("a", "b", "hops", "split", "path").agg(F.min("to").alias("node"))
        walk = walk.select("a", "b", "hops", "split", "node", F.concat("path", F.array("node")).alias("path"))
    return done


def path_hops(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, hop, src, dst, relation, confidence) of each path (a, b, path): one row a hop, with the smallest link between its two nodes.

    Links count in both directions; ``edges`` (src, dst, relation[, confidence]).
    """
    c = F.col("confidence") if "confidence" in edges.columns else F.lit(None).cast("string")
    link = edges.select("src", "dst", F.struct("relation", c.alias("confidence")).alias("_l"))
    both = link.unionByName(link.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "_l")).groupBy("src", "dst").agg(F.min("_l").alias("_l"))
    hop = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("hop"), F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    rows = paths.filter(F.size("path") > 1).select("a", "b", F.inline(hop))
    return rows.join(both, ["src", "dst"]).select("a", "b", "hop", "src", "dst", "_l.relation", "_l.confidence")


def seed_nodes(nodes: DataFrame, terms: list[str], k: int = 3) -> DataFrame:
    """The ``k`` nodes whose labels contain most terms; at least one; ties by id."""
    score = sum((F.contains(F.lower("label"), F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return nodes.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def path_between(nodes: DataFrame, edges: DataFrame, term_a: str, term_b: str, max_depth: int = 10) -> DataFrame:
    """The hops of the shortest path between the nodes that match two terms best, each a text of one or more words."""
    ends = [seed_nodes(nodes, term.split(), 1).select(F.col("id").alias(x)) for x, term in (("a", term_a), ("b", term_b))]
    pair = ends[0].join(ends[1], F.lit(True))  # one row each
    return path_hops(shortest_paths(edges, pair, max_depth), edges)


def dfs_subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """(node, depth): what a depth-limited search from the seeds reaches, whatever its order, with each node's least depth."""
    return bfs_subgraph(edges, seeds, depth)


def explain_node(nodes: DataFrame, edges: DataFrame, term: str, k: int = 1) -> DataFrame:
    """Best matches (``k`` at most) with their degree and their connections in both directions."""
    best = F.broadcast(seed_nodes(nodes, [term], k).select("id", "label"))  # at most k rows
    out = edges.select(F.col("src").alias("id"), F.lit("out").alias("way"), "relation", F.col("dst").alias("other"))
    both = out.unionByName(edges.select(F.col("dst").alias("id"), F.lit("in").alias("way"), "relation", F.col("src").alias("other"))).join(best, "id")
    return both.join(F.broadcast(both.groupBy("id").agg(F.count("*").alias("degree"))), "id")


def vocabulary(nodes: DataFrame, label: str = "label") -> DataFrame:
    """Distinct label tokens."""
    return nodes.select(F.explode(label_tokens(F.col(label))).alias("token")).distinct()


def budgeted_context(lines: DataFrame, group: str, order: list, text: str, budget_tokens: int, chars_per_token: int = 4) -> DataFrame:
    """Lines of each group in order while their summed length stays within the budget."""
    total = F.sum(F.length(text) + 1).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_total", total).filter(F.col("_total") <= budget_tokens * chars_per_token).drop("_total")
