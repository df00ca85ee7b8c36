"""Column helpers: round trips and one fault at a time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators.chunking import nested_block, nested_front_matter


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr.alias("x")).first()["x"]


def test_mixed_tokens(spark):
    assert sorted(one(spark, "Ab a_1 x 配置中心点", X.mixed_tokens(F.col("t")))) == sorted(["ab", "a_1", "配置", "中心"])
    assert one(spark, "配", X.mixed_tokens(F.col("t"))) == []


def test_front_matter_and_body(spark):
    doc = "---\nid: API-1\nname: 'a: b'\nid: API-2\n# note\n---\nrest\n"
    assert one(spark, doc, X.front_matter(F.col("t"))) == {"id": "API-2", "name": "a: b"}
    assert one(spark, doc, X.body(F.col("t"))) == "rest\n"
    assert one(spark, "plain", X.body(F.col("t"))) == "plain" and one(spark, "plain", X.front_matter(F.col("t"))) == {}
    made = one(spark, "plain", X.set_front_matter(F.col("t"), "id", F.lit("Z")))
    assert made == "---\nid: Z\n---\nplain"
    assert one(spark, made, X.set_front_matter(F.col("t"), "id", F.lit("Y"))) == "---\nid: Y\n---\nplain"


def test_sections(spark):
    doc = "# T\norphan\n## A (opt)\nx\n### deep\ny\n\n## B\n## A (opt)\nlast\n"
    assert one(spark, doc, X.h2_sections(F.col("t"), ("(opt)",))) == {"A": "last", "B": ""}
    assert one(spark, doc, X.preamble(F.col("t"))) == "orphan"
    assert one(spark, doc, X.section_body(F.col("t"), "A (opt)")).startswith("x\n### deep\ny")


def test_labelled_field(spark):
    block = "- **类型**: a\n  b\n- **next**: c\n\n- **end**: d"
    assert one(spark, block, X.labelled_field(F.col("t"), "类型")) == "a b"
    assert one(spark, block, X.labelled_field(F.col("t"), "end")) == "d" and one(spark, block, X.labelled_field(F.col("t"), "none")) is None


def test_table_column(spark):
    doc = "## S\ntext\n| k | v |\n|---|:-:|\n| 1 | a |\n| 2 | b |\n\n## E\n"
    assert one(spark, doc, X.table_column(F.col("t"), "S", "v")) == ["a", "b"]
    assert one(spark, doc, X.table_column(F.col("t"), "S", "no")) == [] and one(spark, doc, X.table_column(F.col("t"), "X", "v")) == []


@pytest.mark.parametrize(
    "text,score",
    [
        ('{"score": 3.9}', 3), ('x ```json\n{"score": 2}\n``` y', 2), ("{broken} score: 4", 4), ("评分：1", 1), ("Usefulness (scores ONLY): 0", 0),
        ("score: 9 but 3 maybe", 3), ("of 7 or 2", 2), ("nothing", None), ('{"score": 8}', None),
    ],
)
def test_score_in_text(spark, text, score):
    assert one(spark, text, X.score_in_text(F.col("t"))) == score


def test_total_score(spark):
    f = X.total_score(F.col("t"))
    got = one(spark, '{"scores": {"x": {"score": 1}, "total": 96}, "summary": {"pass": false}}', f)
    assert (got["score"], got["status"], got["passed"]) == (96, "fail", False)
    got = one(spark, "total_score: 0.4\noverall_score: **0.97**\nstatus: FAIL\nstatus: **Pass**", f)
    assert (got["score"], got["status"], got["passed"]) == (97, "pass", True)
    got = one(spark, "nothing", f)
    assert got["score"] is None and got["passed"] is False


def test_names_and_ids(spark):
    assert one(spark, ' a/b: "c"  d ', X.safe_name(F.col("t"))) == "a_b_c_d" and one(spark, "::", X.safe_name(F.col("t"))) == "unnamed"
    assert one(spark, "x/api-1024-name.md", X.id_from_filename(F.col("t"))) == "API_1024" and one(spark, "API-01.md", X.id_from_filename(F.col("t"))) is None
    assert one(spark, " api-1 ", X.canonical_id(F.col("t"))) == "API_1"


def test_snippet_and_durations(spark):
    text = "a" * 50 + "Key" + "b" * 50
    assert one(spark, text, X.snippet(F.col("t"), F.lit("key"))) == "..." + "a" * 40 + "Key" + "b" * 40 + "..."
    assert one(spark, "key", X.snippet(F.col("t"), F.lit("key"))) == "key" and one(spark, "x", X.snippet(F.col("t"), F.lit("key"))) is None
    assert [one(spark, s, X.human_duration(F.col("t")), "double") for s in (45.0, 200.0, 7500.0)] == ["45s", "3m 20s", "2h 5m"]


def test_tokens_and_estimates(spark):
    assert sorted(one(spark, "HTTPServer getUserName x 配置", X.label_tokens(F.col("t")))) == sorted(["http", "server", "get", "user", "name", "配置"])
    assert one(spark, None, X.estimated_tokens(F.col("t")), "int") == 1000 and one(spark, 9000, X.estimated_tokens(F.col("t"), policy="detail"), "int") == 16000
    assert one(spark, 10, X.estimated_tokens(F.col("t"), F.lit(False), "detail"), "int") == 2020


def test_problem_and_code(spark):
    df = spark.createDataFrame([([{"a": "", "b": "x"}, {"a": "y"}], {"f2": ["c"], "f1": ["a", "b"]})], "m array<map<string,string>>, c map<string,array<string>>")
    assert df.select(X.problem_text(F.col("m"), ("a", "b")).alias("x")).first()["x"] == "x; y"
    assert df.select(X.joined_code(F.col("c")).alias("x")).first()["x"] == "a\nb\nc"


def test_reference_text(spark):
    kind = "array<struct<filepath:string,fix_type:string,checker:array<string>,code_block:string>>"
    cases = [
        ([("a", "B", ["x", None, "y"], "z"), ("b", "A", [], "code"), ("a", "A", None, "new"), ("c", "B", [], "no"), ("", "A", ["lost"], ""), (None, "A", ["lost"], "")], "new\ncode"),
        ([("c", "B", [], "no"), ("d", "A", [], "")], None), ([], None), (None, None), ([("a", None, [None], "z"), ("b", "A", None, "w")], "w"),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], f"i int, a {kind}")
    assert [r["x"] for r in df.orderBy("i").select(X.reference_text(F.col("a")).alias("x")).collect()] == [w for _, w in cases]


def test_nested_blocks_round_trip():
    rng = random.Random(1)

    def make(depth):
        k = rng.random()
        if depth == 0 or k < 0.4:
            return rng.choice(["x", "two words", "1.5", "a: b", "http://q", ""])
        if k < 0.75:
            return {f"k{i}": make(depth - 1) for i in range(rng.randint(1, 4))}
        return [make(depth - 1) for _ in range(rng.randint(1, 3))]

    def render(value, indent):
        pad, out = " " * indent, []
        if isinstance(value, dict):
            for k, x in value.items():
                if isinstance(x, str):
                    out.append(f'{pad}{k}: "{x}"' if x else f"{pad}{k}:")
                else:
                    out += [f"{pad}{k}:", *render(x, indent if isinstance(x, list) and rng.random() < 0.3 else indent + 2)]
            return out
        for x in value:
            below = [f'{pad}- "{x}"'] if isinstance(x, str) else render(x, indent + 2)
            out += [below[0] if isinstance(x, str) else f"{pad}- {below[0].lstrip()}", *below[1:]]
        return out

    for _ in range(500):
        value = {f"t{i}": make(3) for i in range(rng.randint(1, 4))}
        assert nested_block(render(value, 0)) == value
    assert nested_block([]) == {} and nested_block(["a: 1", "a: 2", "  b: 3", "# c", "", "d"]) == {"a": "2"}
    start = time.time()
    assert len(nested_block([f"k{i}:" if i % 2 else f"k{i}: v" for i in range(100_000)])) == 100_000 and time.time() - start < 20


def test_nested_front_matter(spark):
    docs = spark.createDataFrame([(1, "---\nid: API-2\ntags:\n  - a\n  - b\n---\nbody"), (2, "no front"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["j"] for r in nested_front_matter(docs).select("doc_id", F.to_json("front").alias("j")).collect()}
    assert got == {1: '{"id":"API-2","tags":["a","b"]}', 2: "{}", 3: "{}"}
