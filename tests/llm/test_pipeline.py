"""The pipeline stage by stage against direct versions on the smallest tables."""

from collections import Counter

from tests.models import brute_links

import corpus_pipeline as P
from tracewell.llm import secrets, toxicity
from tracewell.llm.packing import default_tokenizer
from tracewell.sources.shared import write_shared

CYCLE = (5.0, 2.0, 1.0)


def test_stages_against_direct_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "mixing", "best_fit_packing"]
    seen = [docs.collect()]
    for _, stage in P.STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        seen.append(docs.collect())
    raw, clean, unique, masked, mixed = seen

    model = toxicity.fold_model(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(clean) == sorted(r for r in raw if model.score(r["text"])[0] < toxicity.THRESHOLD) and 0 < len(clean) <= len(raw)

    rows = [(r["doc_id"], r["text"]) for r in clean]
    _, group = brute_links(rows)
    assert sorted(unique) == sorted(r for i, r in enumerate(clean) if group[i] == i or rows[group[i]][0] == rows[i][0])

    words = secrets.Words(secrets.default_dictionary())
    changed = 0
    for a, b in zip(sorted(unique), sorted(masked, key=lambda r: r["doc_id"]), strict=True):
        spans = secrets.find_spans(a["text"] or "", 9.0, 8, words)
        changed += bool(spans)
        assert (a["text"] == b["text"]) == (not spans) and b["n_chars"] == (len(b["text"]) if spans else a["n_chars"])
        assert all((a["text"][s["start"] : s["end"]] not in b["text"]) for s in spans if s["kind"] != "hex")
    assert changed

    size = lambda r: len([w for w in (r["text"] or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w])
    sources = sorted({r["source"] for r in masked})
    sizes = {s: sum(size(r) for r in masked if r["source"] == s) for s in sources}
    weight = {s: CYCLE[i % 3] for i, s in enumerate(sources)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        level = left / sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and weight[s] * level > 3 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    times = Counter(tuple(r) for r in mixed)
    assert set(times) <= {tuple(r) for r in masked} and max(times.values()) <= 3
    for s in sources:
        target = 3 * sizes[s] if s in full else weight[s] * level
        largest = max(size(r) for r in masked if r["source"] == s)
        assert abs(sum(size(r) for r in mixed if r["source"] == s) - target) <= largest / 2 + 1

    pieces = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got, bins = Counter(), {}
    for r in pieces:
        got[r["doc_id"]] += r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_no_distinct_text_is_lost_under_a_repeated_id(spark, sf_dir):
    from tests.llm.test_pairs import one_id_on_many_texts

    rows = [(k, t, "en", "a", len(t)) for k, t in one_id_on_many_texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_duplicates(spark, docs, sf_dir)
    assert Counter(tuple(r) for r in kept.collect()) == Counter(rows[i] for i in (0, 2, 4, 5))
    # mixing: each row as often as its own plan says, whatever its id
    many = [(7 if i % 2 else None, " ".join(["w"] * (1 + i % 4)), "en", "ab"[i % 3 == 0], i) for i in range(400)]
    docs = spark.createDataFrame(many, docs.schema)
    mixed = Counter(tuple(r) for r in P.mix(spark, docs, sf_dir).collect())
    words = {s: sum(len(r[1].split()) * n for r, n in mixed.items() if r[3] == s) for s in "ab"}
    total = sum(len(r[1].split()) for r in many)
    assert set(mixed) <= set(many) and max(mixed.values()) <= 3
    small = min(total * 5 / 7, 3 * sum(len(r[1].split()) for r in many if r[3] == "a"))
    assert abs(words["a"] - small) <= 4 and abs(words["b"] - (total - small)) <= 4


def test_stages_with_odd_rows(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long, size string, class_id int"
    odd = [
        (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (None, "no key", "en", "a", 6, None, None), (3, "w " * 30_000, "en", "b", 60_000, "x", 1),
        (4, "same text here", "en", "a", 14, "x", 1), (4, "same text here", "en", "a", 14, "x", 1), (5, "token: Gk3vQz81LmPx", "en", None, 19, "x", 1),
    ]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in P.STAGES[:-1]:
            docs = write_shared(stage(spark, docs, sf_dir), "odd-stage")
            assert docs.columns == [c.split()[0] for c in kind.split(", ")], name
            if rows and name == "ngram_jaccard_join":
                assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "2", "3", "4", "5", "None"]
        if rows:
            assert "token: Gk3vQz81LmPx" not in {r["text"] for r in docs.collect()}
        assert (P.STAGES[-1][1](spark, docs, sf_dir).count() > 0) == bool(rows)
