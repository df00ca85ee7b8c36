"""Jaccard join, near-duplicate vectors, top-k and WARC on small tables with odd rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.models import brute_links, near_copies, shingles
from tracewell.llm import ngram_join, vectors, warc

# ---------------------------------------------------------------- Jaccard join


@pytest.mark.parametrize("tile_docs", [64, 512])
def test_jaccard_join_against_brute_force(spark, tile_docs):
    rows = near_copies()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, class_id string").repartition(5)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_join(df, tile_docs=tile_docs).collect()}
    links, group = brute_links(rows)
    assert len(got) == len(rows)
    for i, (k, _) in enumerate(rows):
        if k is None:
            assert got[k]["class_id"] is None and got[k]["n_links"] == 0
        else:
            assert (got[k]["n_links"], got[k]["class_id"]) == (len(links[i]), rows[group[i]][0]), k


def test_jaccard_join_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A  b\nc"), (3, "d")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.jaccard_join(df).collect())
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0)]
    assert ngram_join.jaccard_join(df.limit(0)).count() == 0


def one_id_on_many_texts():
    """Rows (id, text) of which several share an id; X ~ X2 and B ~ B2 only."""
    x, b = [f"x{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    text = lambda w, change: " ".join([*w[:-1], change])
    return [
        (3, text(x, "p")), (5, text(x, "q")), (5, text(b, "p")), (7, text(b, "q")), (7, "something else that is like nothing here at all"),
        (5, "again quite another text under the same number"), (5, text(b, "p")), (5, text(x, "q").upper()),
    ]


def test_rows_that_share_an_id_keep_their_own_links(spark):
    rows = one_id_on_many_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, group = brute_links(rows)
    smallest = lambda i: min(rows[j][0] for j in range(len(rows)) if group[j] == group[i])
    want = sorted((k, smallest(i), len(links[i])) for i, (k, _) in enumerate(rows))
    got = ngram_join.jaccard_join(df)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == want
    kept = Counter((r["doc_id"], r["text"]) for r in ngram_join.drop_near_copies(df).collect())
    # one row of each class: no distinct text goes, and of equal rows one stays
    assert kept == Counter([rows[0], rows[2], rows[4], rows[5]])


def test_rows_whose_first_hash_collides_are_not_taken_for_copies(spark, monkeypatch):
    rows = [(i, f"document {i} says something of its own with the words {i * 7} and {i * 13} in it") for i in range(60)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:20])]  # copies, which go
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda key, text: F.pmod(F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")), F.lit(7)).cast("long")
    monkeypatch.setattr(ngram_join, "row_hash", weak)
    assert sorted(r["doc_id"] for r in ngram_join.drop_near_copies(df).collect()) == list(range(60))


def test_recall_against_brute_force(spark):
    """Links of the whole table of sf0.01 that a comparison of all pairs finds."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    by_shingle, sets = {}, {k: shingles(t) for k, t in rows}
    for k, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    common = Counter()
    for ids in by_shingle.values():
        common.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    want = Counter()
    for (a, b), c in common.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            want.update([a, b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_join(df).collect()}
    found = sum(got.values()) / sum(want.values())
    assert found >= 0.999 and all(got[k] <= want[k] for k in got), found


def test_shingle_hashes_do_not_depend_on_neighbours():
    texts = ["a b c d e f", "", None, "x", "a b c d e f", "é è " * 40]
    together = list(ngram_join.shingle_sets(texts))
    alone = [next(ngram_join.shingle_sets([t])) for t in texts]
    assert all(np.array_equal(x, y) for x, y in zip(together, alone, strict=True))
    assert [len(x) for x in together] == [2, 0, 0, 1, 2, 2]


def test_runs_reach_the_recall():
    assert ngram_join.survival(0.8, 1) >= 0.8 and ngram_join.runs_for(0.8, 4, 0.9999) >= 10


# ---------------------------------------------------------------- vectors


def cloud(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    x = base[rng.integers(0, 40, n)] + rng.normal(scale=0.25, size=(n, dim))
    x[10:30] = x[5]
    return x.astype(np.float32)


@pytest.mark.parametrize("block", [32, 4096])
def test_links_against_brute_force(spark, block):
    x = cloud()
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [1.0, 0.0]), (1005, [2.0, 0.0]), (1006, []), (1007, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, n_links string").repartition(4)
    got = {r["vec_id"]: r for r in vectors.link_vectors(df, block=block).collect()}
    d = x.astype(np.float64)
    n = np.linalg.norm(d, axis=1)
    like = d @ d.T / np.outer(n, n) >= 0.9
    np.fill_diagonal(like, False)
    group = vectors.local_components(len(x), *np.nonzero(like))
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (like[i].sum(), group[i])
        assert got[i]["kept"] == (group[i] == i)
    assert got[1005]["component_id"] == 1004 and got[1004]["n_links"] == 1
    for i in (1000, 1001, 1002, 1003, 1006, 1007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert vectors.link_vectors(df.limit(0)).count() == 0


def test_wide_vectors_and_many_without_a_link(spark):
    """Long vectors in many blocks, beside many rows that are null, zero or not finite."""
    x = cloud(240, 300)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bare = [(1000 + i, (None, [0.0] * 300, [float("nan")] * 300)[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows + bare, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.link_vectors(df, block=16).collect()}
    d = x.astype(np.float64)
    n = np.linalg.norm(d, axis=1)
    like = d @ d.T / np.outer(n, n) >= 0.9
    np.fill_diagonal(like, False)
    group = vectors.local_components(len(x), *np.nonzero(like))
    assert got == {i: (like[i].sum(), group[i], group[i] == i) for i in range(len(x))} | {i: (0, i, True) for i, _ in bare}


def test_vectors_that_share_an_id_keep_their_own_links(spark):
    rows = [(3, [1.0, 0.0]), (5, [1.0, 0.1]), (5, [-1.0, 0.0]), (5, [0.0, 1.0]), (9, [0.1, 1.0]), (5, [1.0, 0.1]), (1, [0.0, -1e-200]), (8, [0.0, -3e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.link_vectors(df).collect())
    assert got == sorted([(3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (5, 0, 5, True), (5, 1, 5, True), (9, 1, 5, False), (1, 1, 1, True), (8, 1, 1, False)])


def test_links_at_the_threshold(spark):
    """Many pairs within the error bounds of the threshold: those are computed in full precision."""
    rng = np.random.default_rng(4)
    angle = np.concatenate([np.zeros(40), np.full(60, np.arccos(0.9))]) + rng.normal(scale=1e-4, size=100)
    x = np.stack([np.cos(angle), np.sin(angle), *np.zeros((6, 100))], axis=1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    n = np.linalg.norm(x, axis=1)
    like = x @ x.T / np.outer(n, n) >= 0.9
    for block in (16, 8192):
        got = {r["vec_id"]: r["n_links"] for r in vectors.link_vectors(df, block=block).collect()}
        assert [got[i] for i in range(100)] == (like.sum(1) - 1).tolist()


def test_links_without_pruning(spark):
    x = cloud(200)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    key = lambda f: sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in f.collect())
    assert key(vectors.link_vectors(df, block=32)) == key(vectors.link_vectors(df, block=32, max_centre_bytes=0))


def test_quantisation_bound_holds():
    x = cloud(300).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = vectors.quantise(u)
    near = (q.astype(float) @ q.T.astype(float)) * np.outer(s, s)
    assert (np.abs(near - u @ u.T) <= e[:, None] * (1 + e)[None, :] + e[None, :] + 1e-12).all()


@pytest.mark.parametrize("shard_rows,leaf", [(60, 8), (8192, 256)])
def test_top_k_against_brute_force(spark, shard_rows, leaf):
    x = cloud(300, 8)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 3), (2050, [None] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, score int").repartition(3)
    got = vectors.top_k_products(df, df.filter("vec_id % 7 = 0"), shard_rows=shard_rows, leaf=leaf, query_rows=10).collect()
    w = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(int) for i, v in rows + [odd[1]]}
    want = []
    for i in w:
        if i % 7 == 0:
            best = sorted(((-int(w[i] @ w[j]), j) for j in w if j != i))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert vectors.top_k_products(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_huge_values(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 3.0])], "vec_id long, embedding array<double>")
    got = vectors.top_k_products(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2]
    # sums beyond doubles but within a long are exact; beyond a long they tie at its end
    rows = [(i, [float(2**45 + i), float(2**20)]) for i in range(40)] + [(50, [1e300, 0.0]), (60, [1e301, 0.0]), (70, []), (80, []), (90, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    top, want = (1 << 63) - 1, []
    for q in (7, 50, 80):
        best = sorted((-max(-top, min(top, sum(a * b for a, b in zip(whole[q], w, strict=True)))), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:5])]
    got = vectors.top_k_products(df, df.filter("vec_id IN (7, 50, 80)"), leaf=4)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == sorted(want)


# ---------------------------------------------------------------- WARC


def pages(spark):
    long = "<p>" + "ü" * 80
    rows = [
        (3, "http://b.example.com/x?y=1", long), (1, "https://www.example.com/", long), (2, None, long), (4, "http://b.example.com/x?y=1", "short"),
        (5, "http://b.example.com/x?y=1", "short"), (6, "::bad::", None), (7, "http://é.example/ü z", ""), (None, "http://n.example/", long), (8, "http://b.example.com/x?y=1", "WARC/1.1\r\n\r\n" * 20),
        (8, "http://b.example.com/x?y=1", "WARC/1.1\r\n\r\n" * 20),
    ]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    locations, index = warc.archive_pages(df.repartition(3))
    got = warc.read_records(locations).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if h == html and p is not None), default=None)
        refers = first if len(data) >= 100 and first is not None and page != first else None
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert all(bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else next((h or "").encode() for p, _, h in rows if p == r["page_id"])) for r in got)
    wanted = spark.createDataFrame([(warc.capture_key(rows[0][1], 4),), (warc.capture_key(rows[0][1], 99),), (warc.capture_key(rows[0][1], 8),)], "key string")
    found = lambda **how: sorted((r["key"], r["path"], r["at"]) for r in warc.look_up(index, wanted, **how).collect())
    assert len(found()) == 3 and found() == found(max_directory=1, fan=2)


def test_index_blocks_are_sorted(spark):
    rows = [(warc.capture_key(f"http://h{i % 9}.example/{i}", i), i, "f", i, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, page_id long, path string, at long, size long")
    from tracewell.sources.shared import write_shared

    index = write_shared(warc.build_index(df, lines=16, partitions=3), "index")
    blocks = index.orderBy("first_key").collect()
    assert sum(b["n"] for b in blocks) == 500 and all(a["last_key"] < b["first_key"] for a, b in zip(blocks, blocks[1:], strict=False))
    assert warc.look_up(index, df.select("key", F.lit(1).alias("x"))).count() == 500
    # several levels of directory, and keys cut so short that ranges overlap
    deep = warc.look_up(index, df.select("key").union(df.select(F.concat("key", F.lit("0")))), max_directory=3, fan=3, shown=12)
    assert sorted((r["key"], r["at"]) for r in deep.collect()) == sorted((r[0], r[3]) for r in rows)


def test_warc_of_long_payloads_and_urls(spark):
    rows = [(1, "http://a.example/" + "u" * 100_000, "ü" * 5_000_000), (2, "http://a.example/" + "u" * 100_000, "ü" * 5_000_000), (3, "http://a.example/" + "u" * 99_999 + "v", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, size int")
    locations, index = warc.archive_pages(df)
    wanted = locations.select("key", F.lit(0).alias("block"))
    got = sorted(tuple(r)[:5] for r in warc.read_records(warc.look_up(index, wanted, max_directory=1, fan=2, shown=20)).drop("payload").collect())
    long = hashlib.sha256(rows[0][2].encode()).hexdigest()
    assert got == [(1, 10_000_000, long, "response", None), (2, 10_000_000, long, "revisit", 1), (3, 0, hashlib.sha256(b"").hexdigest(), "response", None)]


def test_warc_of_nothing(spark):
    _, df = pages(spark)
    locations, index = warc.archive_pages(df.limit(0))
    assert locations.count() == 0 and index.count() == 0
    assert warc.read_records(warc.look_up(index, df.limit(0).select(F.lit("k").alias("key")))).count() == 0


def test_stated_share_of_missed_pairs():
    from tracewell.llm.ngram_join import jaccard_join, missed_share

    whole, filtered = missed_share(0.8, 4, 0.9999)
    assert f"{whole:.1e}" == "7.4e-04" and f"{filtered:.1e}" == "1.3e-04"
    assert "7.4e-4" in jaccard_join.__doc__ and "1.3e-4" in jaccard_join.__doc__
