"""Divergence audit, license scan and spelling variants against plain models, on small tables with odd rows."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import divergence, licenses, spelling

# ---------------------------------------------------------------- source divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def divergence_model(rows, min_docs=3, top=200):
    """(lang, source, part, item, value, rank) of rows (text, lang, source), as the contract states it."""
    docs = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        holders = Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in holders.items() if n >= min_docs)
        counts, every = {}, Counter()
        for _, s, terms in mine:
            counts.setdefault(s, Counter()).update(t for t in terms if t in set(kept))
        for c in counts.values():
            every.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        gap = lambda p, q: (p - q) * (p - q) // q
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s in counts:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def spread():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gammagamma", "über", "日本語の文字列", "x", "", "longer" * 12, "longer" * 12 + "s", "longer" * 12 + "t", "shared", "naïve"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randint(0, 20))) + f" rare{i % 50}1once"
        rows.append((text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "", None])))
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("lonely words", "fr", None), rows[0], rows[0], ("y " * 50_000, "en", "a"), ("12 34 !?", "it", "only")]
    return rows


@pytest.mark.parametrize("how", [{}, {"first": 1}, {"first": 2, "max_shipped": 0, "bound": 3}, {"top": 2, "min_docs": 1}])
def test_divergence_against_model(spark, spread, how):
    df = spark.createDataFrame([(*r, "kept", 1) for r in spread], "text string, lang string, source string, term string, p int").repartition(5)
    got = sorted(tuple(r) for r in divergence.source_divergence(df, **how).collect())
    want = divergence_model(spread, how.get("min_docs", 3), how.get("top", 200))
    assert got == want and any(v for *_, v, _ in want)


def test_divergence_of_nothing_and_of_huge_counts(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(none).collect() == []
    # 10^9 times a count of 10^11 needs more than 64 bits on the way
    row = spark.range(1).select(divergence._share("CAST(100000000000 AS BIGINT)", "CAST(300000000000 AS BIGINT)", "CAST(7 AS BIGINT)").alias("p")).first()
    assert row.p == 1 + 10**9 * (10**11 + 1) // (3 * 10**11 + 7)


def test_parts_do_not_depend_on_blocks():
    rng = random.Random(1)
    rows = sorted({(rng.randint(0, 50), rng.randint(0, 8)) for _ in range(900)})
    rows = [(t, g, rng.randint(1, 50), 1000 + g, 26, 9000) for t, g in rows]
    names = ["tid", "gid", "c", "total", "kinds", "every"]

    def parts(cells, size):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + size], strict=True)], names=names) for i in range(0, len(rows), size)]
        pairs, terms = Counter(), set()
        for batch in divergence._compare(3, cells)(iter(batches)):
            for r in batch.to_pylist():
                if r["tid"] is None:
                    pairs[r["gid"], r["other"]] += r["value"]
                else:
                    terms.add(tuple(r.values()))
        return {k: v for k, v in pairs.items() if v}, terms

    whole = parts(10**6, 10**6)
    assert all(parts(cells, size) == whole for cells, size in ((10, 7), (1, 1), (50, 1000), (333, 50)))
    number, sizes = np.arange(1200) % 1100, np.full(1200, 4)  # more sources than a dense table takes, few meetings at a time
    starts, p, p0 = np.arange(1200) // 4 * 4, np.arange(1200) % 37 + 2, np.full(1200, 1)
    codes, sums = divergence._pair_sums(number, 1100, starts, sizes, p, p0, chunk=10)
    want = Counter()
    gap = lambda a, b: (a - b) ** 2 // b
    for i in range(1200):
        for j in range(i // 4 * 4, i // 4 * 4 + 4):
            if i != j:
                want[number[i] * 1100 + number[j]] += gap(int(p[i]), int(p[j])) - gap(int(p[i]), 1) - gap(1, int(p[j])) + gap(1, 1)
    got = Counter()
    for x, v in zip(codes.tolist(), sums.tolist(), strict=True):
        got[x] += v
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# ---------------------------------------------------------------- licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def license_model(text, templates, threshold):
    words = WORD.findall(lowered(text or ""))
    places = sorted(
        (i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
        for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    )
    found = []
    for k, (label, body) in enumerate(templates):
        own = WORD.findall(lowered(body))
        step = 8
        while step < len(own):
            step *= 2
        for a in range(0, len(words), step):
            common = len(set(own) & set(words[a : a + 2 * step]))
            if common >= threshold * len(set(own)) - 1e-9:
                found.append((label, k, a, min(len(words), a + 2 * step), common / len(set(own))))
    return len(words), places, sorted(found, key=lambda x: (x[1], x[2]))


@pytest.mark.parametrize("threshold", [0.9, 0.6, 1.0])
def test_license_blocks_against_all_windows(spark, threshold):
    rng = random.Random(8)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["other", "word", "café", "2024"] * 40
    rows = [None, "", "  \n", "MIT license", "mit license MIT LICENSE general public license", "license", "apache", "apache-license and the gnu general\npublic license"]
    for _ in range(150):
        filler = lambda: rng.choices(pool, k=rng.randint(0, 60))
        body = rng.choice(licenses.TEMPLATES)[1].split()
        if rng.random() < 0.5:
            body.pop(rng.randrange(len(body)))
        rows.append(rng.choice([" ", "\n"]).join([*filler(), *body, *filler()]))
    rows += ["the " * 100_000 + "Licensed under CC BY-NC 4.0.", rows[3], rows[-1]]
    df = spark.createDataFrame([(i, t, "kept", 5) for i, t in enumerate(rows)], "doc_id long, text string, licenses string, n_words int").repartition(3)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df, threshold=threshold).collect()}
    hits = 0
    for i, t in enumerate(rows):
        x = got[i]["licenses"]
        mine = (x["n_words"], [(p["word"], p["label"]) for p in x["places"]], [tuple(m) for m in x["matches"]])
        assert mine == license_model(t, licenses.TEMPLATES, threshold), t
        assert got[i]["n_words"] == 5
        hits += len(x["matches"])
    assert hits > 50
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_notice_in_any_place_is_found_and_order_changes_nothing():
    notice = licenses.TEMPLATES[6][1]
    index = licenses.Index(licenses.TEMPLATES, 0.9, {})
    back = licenses.Index(licenses.TEMPLATES, 0.9, {w: 10**6 - r for w, r in index.rank.items()})
    for before in range(70):
        words = licenses.words_of(("filler " * before + notice + " end" * 40).encode())
        assert any(t == 6 for t, *_ in index.matches(words)) and index.matches(words) == back.matches(words)


def test_many_license_words_in_little_time():
    index = licenses.Index(licenses.TEMPLATES, 0.9, {})
    start = time.process_time()
    index.matches(licenses.words_of(b"nc sa cc by license mit the under " * 40_000))
    assert time.process_time() - start < 20


# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_model(rows, least=5, min_count=3):
    n = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= min_count}
    near = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_near_words_of_a_sorted_list():
    rng = random.Random(3)
    for _ in range(400):
        size, shared = rng.choice([(2, 0), (3, 0), (26, 2)]), 0
        letters, shared = "abcdefghijklmnopqrstuvwxyz"[: size[0]], size[1]
        words = sorted({"zz"[:shared] + "".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 60))})
        want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
        assert set(spelling.near_in_list(words, shared)) == want


@pytest.mark.parametrize("how", [{}, {"list_size": 100, "bound": 10}, {"list_size": 3}])
def test_spelling_against_brute_force(spark, how):
    rng = random.Random(6)
    letters = "aabé" if how.get("list_size") == 3 else "abcdeé"
    base = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(150)]
    rows = [(None, None), (1, ""), (2, "ab cd"), (None, "Straße STRASSE strasse ÀÿÀÿÀ× ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷ 日本語日本語 a日本b"), (3, "q" * 3000 + " " + "q" * 3001), (4, ("q" * 3000 + " " + "q" * 2999 + "x ") * 3)]
    for i in range(300):
        rows.append((i % 200, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(base, weights=range(1, 151), k=12))))
    rows += rows[-3:]
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted((tuple(r) for r in spelling.spelling_variants(df, **how).collect()), key=lambda r: r[0])
    want = spelling_model(rows)
    assert got == want and sum(r[4] for r in want) > 50 and any(r[1] for r in want)
    assert spelling.spelling_variants(df.limit(0), **how).collect() == []


def test_one_hot_beginning_is_cut_and_nothing_is_lost(spark):
    rng = random.Random(7)
    words = sorted({"hot" + "".join(rng.choices("abc", k=rng.randint(3, 6))) for _ in range(500)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if one_edit(a, b))
    assert sorted((r["word"], r["near"]) for r in spelling.near_words(df, list_size=20).collect()) == want


def test_chains_end_at_their_root(spark):
    links = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [("a", "w003"), ("b", "w040")], "word string, form string")
    assert {r["root"] for r in spelling.follow(links).collect()} == {"w040"}
    assert spelling.follow(links.limit(0)).count() == 0


def test_query_against_brute_force_on_the_smallest_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    model = spelling_model(rows)
    got = spelling.op13_spelling_variants(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").orderBy(F.col("word")).collect()
    assert sorted(tuple(r) for r in got) == model and len(model) > 1000
