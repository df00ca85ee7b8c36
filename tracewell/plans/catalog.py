"""Registered queries over the given tables, with their SQL.

A query is registered with the decorator below; the SQL stands beside it and gives the same rows and columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators import catalog, chunking, consolidate, graph, quality, relations, rules, search, tracking, vector_index
from tracewell.sources import io
from tracewell.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- chunks and numbering

CHUNKS = """
chunks AS (
  SELECT doc_id, (s // 448)::INTEGER AS chunk_no, s::INTEGER AS start, substr(text, s + 1, 512) AS chunk
  FROM (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(text) <= 512 THEN 0 ELSE 448 * ceil((length(text) - 512) / 448.0)::BIGINT END, 448)) AS s
        FROM documents WHERE length(text) > 0)
  WHERE length(substr(text, s + 1, 512)) >= 40)"""


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_no, start, sha256(chunk) AS hash FROM chunks")
def chunks_window(t):
    return chunking.sliding_chunks(t("documents")).select("doc_id", "chunk_no", "start", X.content_hash(F.col("chunk")).alias("hash"))


@query(f"""WITH {CHUNKS}, h AS (SELECT c.*, sha256(chunk) AS hash, d.lang, d.source FROM chunks c JOIN documents d USING (doc_id)),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id, chunk_no) = 1)
SELECT 'lang' AS dimension, coalesce(lang, 'unknown') AS label, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM f GROUP BY ALL""")
def chunk_summary(t):
    docs = t("documents").select("doc_id", "lang", "source", "text")
    chunks = chunking.sliding_chunks(docs).select("doc_id", "chunk_no", X.content_hash(F.col("chunk")).alias("hash"))
    first = chunks.groupBy("hash").agg(F.min(F.struct("doc_id", "chunk_no")).alias("f")).select("f.doc_id")
    return catalog.summarise(first.join(docs.select("doc_id", "lang", "source"), "doc_id"), ["lang", "source"])


@query("""WITH f AS (SELECT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1)
SELECT doc_id, h, format('CHK_{:06d}', row_number() OVER (ORDER BY doc_id)) AS number FROM f""")
def dedup_renumber(t):
    docs = t("documents").filter("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"))
    return catalog.renumber(catalog.dedup_first(docs, ["h"], ["doc_id"]), ["doc_id"])


@query("""SELECT md5(text) AS h, min(doc_id) AS doc_id, list_sort(list_distinct(list(source))) AS sources FROM documents
WHERE trim(md5(text)) <> '' GROUP BY md5(text)""")
def merge_duplicates(t):
    docs = t("documents").filter("text IS NOT NULL").select(F.md5("text").alias("h"), "doc_id", F.array("source").alias("sources"))
    return catalog.merge_duplicates(docs, "h", "doc_id", ["sources"])


@query("""SELECT 'lang' AS dimension, coalesce(lang, 'unknown') AS label, count(*) AS n FROM documents GROUP BY ALL
UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY ALL""")
def summary_sets(t):
    return catalog.summarise(t("documents"), ["lang", "source"])


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 + 1 AS batch FROM documents")
def fixed_batches(t):
    return catalog.fixed_batches(t("documents").select("doc_id", "source"), ["doc_id"], 20, ["source"])


@query("""WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
s AS (SELECT doc_id, source, n_chars, r, 1::BIGINT AS batch, 1 AS k, n_chars AS total FROM d WHERE r = 1
  UNION ALL SELECT d.doc_id, d.source, d.n_chars, d.r,
    CASE WHEN s.k >= 20 OR s.total + d.n_chars > 15000 THEN s.batch + 1 ELSE s.batch END,
    CASE WHEN s.k >= 20 OR s.total + d.n_chars > 15000 THEN 1 ELSE s.k + 1 END,
    CASE WHEN s.k >= 20 OR s.total + d.n_chars > 15000 THEN d.n_chars ELSE s.total + d.n_chars END
  FROM s JOIN d ON d.source IS NOT DISTINCT FROM s.source AND d.r = s.r + 1)
SELECT doc_id, source, n_chars, batch FROM s""")
def budget_batches(t):
    return catalog.budget_batches(t("documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 20, 15000)


@query("""SELECT doc_id, source || '-' || format('{:03d}', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS number FROM documents WHERE source IS NOT NULL""")
def number_within(t):
    docs = t("documents").filter("source IS NOT NULL").select("doc_id", "source")
    return catalog.number_within(docs, "source", ["doc_id"], F.col("source")).select("doc_id", "number")


@query("""SELECT doc_id, CASE WHEN lang IS NULL THEN 'missing lang' WHEN trim(lang) = '' THEN 'empty lang' WHEN text IS NULL THEN 'missing text' WHEN trim(text) = '' THEN 'empty text' END AS reject_reason FROM documents""")
def validate_records(t):
    return catalog.validate_records(t("documents"), ["lang", "text"]).select("doc_id", "reject_reason")


@query("""SELECT l_orderkey AS item, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(t):
    return catalog.duplicate_ids(t("lineitem").select(F.col("l_orderkey").alias("item")), "item")


@query("""SELECT count(*) AS rows, count(lang) AS labelled_lang, count(source) AS labelled_source, (SELECT max(doc_id) + 1 FROM documents) AS declared,
count(*) = (SELECT max(doc_id) + 1 FROM documents) AND count(lang) = count(*) AND count(source) = count(*) AS consistent FROM documents""")
def totals_check(t):
    return catalog.totals_check(t("documents"), t("documents").agg(F.max("doc_id") + 1).first()[0], ["lang", "source"])


# ---------------------------------------------------------------- change sets

CHANGES = """
ch AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'MODIFY' ELSE 'INSERT' END AS a, 'X' AS s FROM orders WHERE o_orderkey % 7 IN (0, 1, 2)
  UNION ALL SELECT -o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'INSERT' ELSE 'DELETE' END, 'N' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey > 0)"""


def _changes(t):
    o = t("orders").select("o_orderkey")
    k = F.col("o_orderkey")
    own = o.filter(k % 7 < 3).filter(k >= 0).select(k, F.when(k % 7 == 0, "DELETE").when(k % 7 == 1, "MODIFY").otherwise("INSERT").alias("action"), F.lit("X").alias("o_orderstatus"))
    new = o.filter((k % 11 == 0) & (k > 0)).select((-k).alias("o_orderkey"), F.when(k % 2 == 0, "INSERT").otherwise("DELETE").alias("action"), F.lit("N").alias("o_orderstatus"))
    return catalog.apply_changes(t("orders").select("o_orderkey", "o_orderstatus"), own.unionByName(new), "o_orderkey", ["o_orderstatus"])


@query(f"""WITH {CHANGES}
SELECT o.o_orderkey, CASE WHEN a = 'MODIFY' THEN s ELSE o_orderstatus END AS o_orderstatus FROM orders o LEFT JOIN ch USING (o_orderkey) WHERE a IS DISTINCT FROM 'DELETE'
UNION ALL SELECT o_orderkey, s FROM ch WHERE a = 'INSERT' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def apply_changes(t):
    return _changes(t)[0]


@query(f"""WITH {CHANGES} SELECT ch.o_orderkey, a AS action, CASE WHEN a = 'INSERT' THEN 'already present' ELSE 'not present' END AS error
FROM ch LEFT JOIN orders o USING (o_orderkey) WHERE (a = 'INSERT') = (o.o_orderstatus IS NOT NULL)""")
def change_errors(t):
    return _changes(t)[1]


@query("""SELECT doc_id, 'no document' AS problem FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'not listed' FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def dangling(t):
    return catalog.dangling(t("labels").select("doc_id"), t("documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def keep_existing(t):
    return catalog.keep_existing(t("labels").select("doc_id", "quality"), t("documents"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_docs(t):
    return catalog.missing_docs(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("""WITH i AS (SELECT doc_id AS item_id, doc_id // 50 AS batch_number, 'completed' AS status FROM documents),
m AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT item_id, batch_number, CASE WHEN item_id IN (SELECT * FROM m) THEN 'pending' ELSE status END AS status,
bool_or(item_id IN (SELECT * FROM m)) OVER (PARTITION BY batch_number) AS affected FROM i""")
def affected_batches(t):
    items = t("documents").select(F.col("doc_id").alias("item_id"), F.floor(F.col("doc_id") / 50).alias("batch_number"), F.lit("completed").alias("status"))
    gone = t("documents").join(t("labels"), "doc_id", "left_anti").select(F.col("doc_id").alias("item_id"))
    return catalog.affected_batches(items, gone)


@query("""WITH a AS (SELECT doc_id, count(*) AS n, min('doc' || (doc_id % 5)) AS nm FROM labels GROUP BY doc_id)
SELECT coalesce(d.doc_id, a.doc_id) AS doc_id, coalesce(n, 0) AS n_docs, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN nm <> 'doc' || (d.doc_id % 6) THEN 'wrong name' END AS problem
FROM documents d FULL JOIN a ON a.doc_id = d.doc_id""")
def audit_documents(t):
    name = lambda m: F.concat(F.lit("doc"), (F.col("doc_id") % m).cast("string"))
    return catalog.audit_documents(t("documents").select("doc_id", name(6).alias("name")), t("labels").select("doc_id", name(5).alias("file")), "doc_id", "name", "file")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, greatest(n - 5, 0) AS overflow FROM r WHERE r <= 5""")
def cap_with_overflow(t):
    return catalog.cap_with_overflow(t("documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 5).select("doc_id", "source", "overflow")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def rank_counts(t):
    return catalog.rank_counts(t("documents"), "lang")


@query("""SELECT DISTINCT url AS path FROM pages WHERE url IS NOT NULL AND NOT regexp_matches(url, '\\?') AND NOT contains(url, '/de/')""")
def exclude_paths(t):
    pages = t("pages").select(F.col("url").alias("path"))
    return catalog.changed_files(catalog.exclude_paths(pages, "path", globs=("*[?]*",), dirs=("de",)), pages.limit(0))


# ---------------------------------------------------------------- relations

CUST_PART = """
a AS (SELECT DISTINCT c_nationkey AS s, o_orderkey AS m FROM customer JOIN orders ON c_custkey = o_custkey),
b AS (SELECT DISTINCT l_orderkey AS m, l_suppkey AS c FROM lineitem)"""


def _cust_orders(t):
    rows = t("customer").select("c_custkey", "c_nationkey").join(t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return rows.select(F.col("c_nationkey").alias("source"), F.col("o_orderkey").alias("target"))


@query(f"WITH {CUST_PART} SELECT s AS source, list_sort(list(DISTINCT c)) AS targets FROM a JOIN b USING (m) GROUP BY s")
def compose_nation_supplier(t):
    items = t("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"))
    return relations.compose_relations(_cust_orders(t), items)


@query("""SELECT c_custkey AS source, coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_partkey IS NOT NULL)), []) AS targets
FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 49 GROUP BY 1""")
def compose_keep_empty(t):
    orders = t("orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))
    items = t("lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    known = orders.join(t("customer").select(F.col("c_custkey").alias("source")), "source", "left_semi")
    return relations.compose_relations(known, items, keep_empty=True)


@query("SELECT l_partkey AS part, list_sort(list(DISTINCT l_suppkey)) AS targets FROM lineitem GROUP BY 1")
def adjacency(t):
    return relations.adjacency(t("lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey"), "part", "l_suppkey")


@query("SELECT l_suppkey AS source, list_sort(list(DISTINCT l_partkey)) AS targets FROM lineitem GROUP BY 1")
def inverted(t):
    rel = relations.adjacency(t("lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")))
    return relations.invert(rel)


@query("""WITH o AS (SELECT doc_id::VARCHAR AS k, list_sort(list(DISTINCT toxic)) AS targets FROM labels GROUP BY 1), d AS (SELECT DISTINCT doc_id::VARCHAR AS k FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(d.k, o.k) AS doc_id, coalesce(targets, []) AS targets, CASE WHEN d.k IS NULL THEN 'observed' WHEN o.k IS NULL THEN 'known' ELSE 'both' END AS origin FROM d FULL JOIN o ON d.k = o.k""")
def known_and_observed(t):
    seen = t("labels").select("doc_id", F.array("toxic").alias("targets"))
    return relations.merge_known_and_observed(t("documents").filter("doc_id % 2 = 0").select("doc_id"), seen, "doc_id")


@query("""WITH l AS (SELECT doc_id, list_sort(list(DISTINCT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END)) AS s FROM labels GROUP BY 1)
SELECT d.doc_id, coalesce(s, []) AS source_interfaces FROM documents d LEFT JOIN l USING (doc_id)""")
def attach_lineage(t):
    lineage = t("labels").select("doc_id", F.array(F.when(F.col("quality") == 1, "good").otherwise("poor")).alias("interfaces"))
    return relations.attach_lineage(t("documents").select("doc_id"), lineage, "doc_id")


@query(r"""WITH r AS (SELECT DISTINCT 'REQ-' || item_id AS req_id FROM benchmark), t AS (SELECT DISTINCT doc_id AS task_id, 'REQ-' || (doc_id % 60) AS req_id FROM documents)
SELECT coalesce(r.req_id, t.req_id) AS req_id, task_id, CASE WHEN task_id IS NULL THEN 'no task' WHEN r.req_id IS NULL THEN 'unknown requirement' END AS gap FROM r FULL JOIN t ON r.req_id = t.req_id""")
def coverage_matrix(t):
    req = t("benchmark").select(F.concat(F.lit("REQ-"), F.col("item_id").cast("string")).alias("req_id"))
    tasks = t("documents").select(F.col("doc_id").alias("task_id"), F.format_string("implements REQ-%d and REQ-%d", F.col("doc_id") % 60, F.col("doc_id") % 60).alias("text"))
    return relations.coverage_matrix(req, tasks, r"(REQ-\d+)")


@query("""SELECT n_nationkey AS src, n_regionkey + 1000 AS dst, CASE WHEN n_nationkey % 3 = 0 THEN 'knows' ELSE 'in' END AS relation,
CASE WHEN n_nationkey % 3 = 0 THEN 'unknown relation' END AS problem FROM nation
UNION ALL SELECT c_custkey + 2000, c_nationkey, 'in', 'end type not allowed' FROM customer""")
def check_ontology(t):
    nations, regions, cust = t("nation"), t("region"), t("customer")
    nodes = nations.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("type_id"))
    nodes = nodes.unionByName(regions.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit("region").alias("type_id")))
    nodes = nodes.unionByName(cust.select((F.col("c_custkey") + 2000).alias("id"), F.lit("customer").alias("type_id")))
    rel = F.when(F.col("n_nationkey") % 3 == 0, "knows").otherwise("in")
    edges = nations.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 1000).cast("long").alias("dst"), rel.alias("relation"))
    edges = edges.unionByName(cust.select((F.col("c_custkey") + 2000).alias("src"), F.col("c_nationkey").cast("long").alias("dst"), F.lit("in").alias("relation")))
    types = lambda v: F.array(F.lit(v))
    ontology = regions.limit(1).select(F.lit("in").alias("relation"), types("nation").alias("from_types"), types("region").alias("to_types"), F.lit(True).alias("directional"))
    return relations.check_ontology(edges, nodes, ontology)


@query("""SELECT r_name AS source, list_sort(list(DISTINCT c_custkey::VARCHAR)) AS targets FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def trace_region_customer(t):
    nation = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    e1 = nation.select(F.col("r_name").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("has").alias("relation"))
    e2 = t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.col("c_custkey").cast("string").alias("dst"), F.lit("serves").alias("relation"))
    return relations.trace(e1.unionByName(e2), ["has", "serves"])


@query("""SELECT o_orderkey, bool_or(l_returnflag = 'A') AS A, bool_or(l_returnflag = 'N') AS N, bool_or(l_returnflag = 'R') AS R, count(DISTINCT l_returnflag) AS present
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
UNION ALL SELECT o_orderkey, false, false, false, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def artifact_matrix(t):
    items = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("artefact"))
    out = relations.artifact_matrix(t("orders").select("o_orderkey"), items, ["A", "N", "R"], "o_orderkey")
    return out.withColumn("present", F.col("present").cast("long"))


@query("SELECT DISTINCT p_partkey AS root_symbol FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def missing_roots(t):
    return relations.missing_roots(t("part").select(F.col("p_partkey").alias("root_symbol")), t("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("root_symbol")))


# ---------------------------------------------------------------- search


def _instances(t):
    return t("documents").select(
        F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("type_id"), F.col("source").alias("name"), "doc_id", "text",
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("frontmatter"), F.create_map(F.lit("Text"), "text").alias("sections"),
    )


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def filter_instances(t):
    return search.filter_instances(_instances(t), {"Language": "en", "source": ["src1", "src2"]}, {"Language": "lang"}).select("doc_id")


@query("""WITH i AS (SELECT 'DOC_' || doc_id AS id, source FROM documents), w AS (SELECT source AS ref FROM i UNION SELECT id FROM i), n AS (SELECT source, min(id) AS first FROM i GROUP BY source)
SELECT ref, coalesce(i.id, first) AS id FROM w LEFT JOIN (SELECT DISTINCT id FROM i) i ON i.id = ref LEFT JOIN n ON n.source = ref WHERE ref <> ''""")
def resolve_instance(t):
    docs = _instances(t)
    wanted = docs.select(F.col("name").alias("ref")).union(docs.select("id")).distinct().filter("ref <> ''")
    return search.resolve_instance(wanted, docs).select("ref", "id")


@query("SELECT 'DOC_' || doc_id AS id, md5(text) AS Text, lang AS Language FROM documents")
def instance_view(t):
    return search.instance_view(_instances(t), [("Text", "text"), ("Language", "lang")]).withColumn("Text", F.md5("Text"))


@query("SELECT coalesce(lang, 'unknown') AS type_id, count(*) AS n FROM documents GROUP BY 1")
def kb_stats(t):
    return search.kb_stats(_instances(t))


@query("""SELECT 'DOC_' || doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN ['missing Owner', 'id pattern'] ELSE ['missing Owner'] END AS findings FROM documents WHERE lang IN ('en', 'de')
UNION ALL SELECT 'DOC_' || doc_id, CASE WHEN doc_id % 10 = 3 THEN ['missing Owner', 'enum lang', 'id pattern'] ELSE ['missing Owner', 'enum lang'] END FROM documents WHERE lang NOT IN ('en', 'de')""")
def instance_checks(t):
    docs = _instances(t).filter("type_id IS NOT NULL").withColumn("preamble", F.lit(""))
    return search.kb_validate(search.instance_checks(docs, ["lang", "Owner"], {"lang": ["en", "de"]}, r"^DOC_\d*[0-24-9]$", ["Text"]))


KEYWORDS = ["the", "password", "une"]


@query("""SELECT w AS word, doc_id, CASE WHEN p > 41 THEN '...' ELSE '' END || substr(text, greatest(p - 40, 1), least(p + length(w) + 39, length(text)) - greatest(p - 40, 1) + 1)
|| CASE WHEN p + length(w) + 39 < length(text) THEN '...' ELSE '' END AS snippet
FROM (SELECT doc_id, text, w, strpos(lower(text), w) AS p FROM documents, unnest(['the', 'password', 'une']) AS u(w)) WHERE p > 0""")
def keyword_search(t):
    return search.keyword_search(t("documents"), "doc_id", "text", KEYWORDS)


@query(ORACLE_SQL["keyword_search"])
def keyword_indexed(t):
    from tracewell.sources.shared import new_path

    docs = t("documents")
    index = search.KeywordIndex(docs.sparkSession, new_path(docs.sparkSession, "keyword-index"), buckets=8)
    for some in (docs.filter("doc_id % 2 = 0"), docs):  # the second run adds what is new
        index.add(some, "text")
    return index.search(docs, "doc_id", "text", KEYWORDS)


@query(ORACLE_SQL["keyword_search"] + " QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id) <= 20")
def keyword_limited(t):
    return search.keyword_search(t("documents"), "doc_id", "text", KEYWORDS, 20)


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'excluded type' WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(trim(text)) < 400 THEN 'too short' END AS skip_reason FROM documents""")
def index_entries(t):
    return search.index_entries(t("documents"), "text", F.coalesce("lang", F.lit("")), 400, ("de",)).select("doc_id", "skip_reason")


VECTORS_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_dot_product(q, embedding::DOUBLE[]) AS s FROM q, embeddings WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, round(s, 4) AS score FROM r WHERE rank <= 10 AND s >= 0.3"""


def _vector_query(t, scope=None):
    asked = t("embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.vector_search(t("embeddings"), asked, "vec_id", "embedding", 10, 0.3, scope)


@query(VECTORS_SQL.format(where="true"))
def vector_topk(t):
    return _vector_query(t)


@query(VECTORS_SQL.format(where="true"))
def vector_indexed(t):
    from tracewell.sources.shared import new_path

    rows = t("embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    length = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    index = vector_index.VectorIndex(rows.sparkSession, new_path(rows.sparkSession, "vector-index"), length)
    for some in (rows.filter("vec_id % 2 = 0"), rows):  # the second run adds what is new
        index.add(some, "vec_id", "embedding")
    return index.search(asked, "vec_id", 10, 0.3)


@query(VECTORS_SQL.format(where="label IN (1, 2, 3)"))
def vector_scoped(t):
    return _vector_query(t, F.col("label").isin(1, 2, 3))


@query("""SELECT 'run1' AS run, count(*) AS entries, count(DISTINCT text) AS distinct_texts, count(DISTINCT text) AS new, 0::BIGINT AS reused FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0
UNION ALL SELECT 'run2', count(*), count(DISTINCT text), count(DISTINCT text) - (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 0),
(SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 0) FROM documents WHERE text IS NOT NULL""")
def index_incremental(t):
    from tracewell.sources.shared import new_path

    docs = t("documents").select("doc_id", "text")
    spark = docs.sparkSession
    store = io.VectorStore(spark, new_path(spark, "store"), "hashing", "plain")
    first = search.build_index(docs.filter("doc_id % 2 = 0"), store).withColumn("run", F.lit("run1"))
    return first.unionByName(search.build_index(docs, store).withColumn("run", F.lit("run2")))


@query("""WITH q AS (SELECT lower(p_name) AS q FROM part WHERE p_partkey % 100 = 0), n AS (SELECT p_partkey, lower(p_name) AS n FROM part),
x AS (SELECT q, p_partkey, list_distinct(list_filter(regexp_extract_all(q, '[a-z0-9_]+'), lambda w: length(w) >= 2)) AS a, list_distinct(list_filter(regexp_extract_all(n, '[a-z0-9_]+'), lambda w: length(w) >= 2)) AS b, n FROM q, n)
SELECT q AS query, p_partkey, round(0.5 * (contains(n, q) OR contains(replace(n, ' ', ''), replace(q, ' ', '')))::INT + CASE WHEN len(a) > 0 AND len(b) > 0 THEN 0.3 * len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) AS score
FROM (SELECT DISTINCT * FROM x)""")
def fuzzy_native(t):
    asked = t("part").filter("p_partkey % 100 = 0").select(F.lower("p_name").alias("query"))
    return search.fuzzy_scores(t("part").select("p_partkey", "p_name"), asked, "p_partkey", "p_name")


@query()
def fuzzy_topk(t):
    asked = t("part").filter("p_partkey % 100 = 0").select(F.col("p_name").alias("query"))
    return search.fuzzy_search(t("part").select("p_partkey", "p_name"), asked, 10, "p_partkey", "p_name")


# ---------------------------------------------------------------- rules and gates


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)apache license|all rights reserved') THEN 'licence' WHEN regexp_matches(text, '(?i)password|api_?key') THEN 'credential' WHEN regexp_matches(text, '[!?]{2}') THEN 'noise' ELSE 'unknown' END AS label,
CASE WHEN regexp_matches(text, '(?i)apache license|all rights reserved') THEN 0.7 WHEN regexp_matches(text, '(?i)password|api_?key') THEN 0.65 WHEN regexp_matches(text, '[!?]{2}') THEN 0.6 ELSE 0.0 END AS confidence FROM documents""")
def classify_first(t):
    found = [("r1", "text", "(?i)apache license|all rights reserved", "licence", 0.7), ("r2", "text", "(?i)password|api_?key", "credential", 0.65), ("r3", "text", "[!?]{2}", "noise", 0.6)]
    return rules.classify_first_match(t("documents"), found).select("doc_id", "label", "confidence")


WEIGHTED = [("buyer", "optional", "purchase", 0.9), ("buyer", "exclude", "error", 0.0), ("visitor", "optional", "view|click", 0.6), ("new", "required", "signup", 0.8)]


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'buyer' WHEN 'view' THEN 'visitor' WHEN 'click' THEN 'visitor' WHEN 'signup' THEN 'new' ELSE 'unknown' END AS label,
CASE event_type WHEN 'purchase' THEN 0.9 WHEN 'view' THEN 0.6 WHEN 'click' THEN 0.6 WHEN 'signup' THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence FROM events""")
def classify_weighted(t):
    return rules.classify_weighted(t("events"), WEIGHTED, "event_id", "event_type")


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'sales' WHEN 'error' THEN 'support' END AS domain, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'fail' END AS "function" FROM events""")
def tag_semantics(t):
    return rules.tag_semantics(t("events"), [(1, "purch", "sales", "buy"), (2, "err", "support", "fail")], "event_id", "event_type")


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https:') THEN 'secure' ELSE 'plain' END AS type, coalesce(nullif(regexp_extract(url, '^([^/]+)/', 1), ''), 'root') AS module FROM pages WHERE url IS NOT NULL""")
def normalise_catalogue(t):
    pages = t("pages").filter("url IS NOT NULL").select("page_id", "url", F.regexp_extract("url", "^([a-zA-Z]+):", 1).alias("scheme"))
    return rules.normalise_catalogue(pages, "scheme", "url", {"https": "secure", "http": "plain"}, {}).select("page_id", "type", "module")


@query("""SELECT user_id, event_type, CASE WHEN event_type IN ('view', 'click') THEN 'system' WHEN event_type IN (SELECT event_type FROM events WHERE event_id < 3) THEN 'local' ELSE 'external' END AS kind, count(*) AS n FROM events GROUP BY ALL""")
def classify_imports(t):
    e = t("events").select("event_id", "user_id", F.col("event_type").alias("module"))
    out = rules.classify_imports(e, e.filter("module IN ('view', 'click')"), e.filter("event_id < 3"))
    return out.groupBy("user_id", F.col("module").alias("event_type"), "kind").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT source, CASE WHEN lang IN ('de', 'fr') THEN 'c' WHEN lang = 'es' THEN 'cpp' ELSE 'python' END AS language, count(*) AS n FROM documents GROUP BY ALL),
f AS (SELECT source, CASE WHEN language IN ('c', 'cpp') AND max(n) FILTER (language = 'c') OVER w > 0 AND max(n) FILTER (language = 'cpp') OVER w > 0
  THEN CASE WHEN max(n) FILTER (language = 'cpp') OVER w >= max(n) FILTER (language = 'c') OVER w THEN 'cpp' ELSE 'c' END ELSE language END AS language, n FROM n WINDOW w AS (PARTITION BY source)),
s AS (SELECT source, language, sum(n)::BIGINT AS files, sum(n) * CASE WHEN language = 'c' THEN 0.8 ELSE 1.0 END::DOUBLE AS score FROM f GROUP BY source, language)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, language) = 1""")
def language_vote(t):
    lang = F.when(F.col("lang").isin("de", "fr"), "c").when(F.col("lang") == "es", "cpp").otherwise("python")
    return rules.language_vote(t("documents").select("source", lang.alias("language")), "source", "language")


@query("""SELECT source, round_even(count(*) * 1.05 * 0.9, 0)::BIGINT AS lower, round_even(count(*) * 1.05 * 1.3, 0)::BIGINT AS upper,
CASE WHEN count(text) FILTER (lang = 'en') < greatest(5, round_even(count(*) * 1.05 * 0.9, 0)) THEN 'too_few' ELSE 'pass' END AS status FROM documents GROUP BY source""")
def quantity_gate(t):
    rows = t("documents").groupBy("source").agg((F.count("*") * 1.05).alias("estimated"), F.count(F.when(F.col("lang") == "en", F.col("text"))).alias("actual"))
    rows = rows.withColumn("baseline", F.lit(5)).withColumn("list_ok", F.lit(True))
    return quality.quantity_gate(rows).select("source", "lower", "upper", "status")


@query("""WITH b AS (SELECT source, greatest(1, ceil(sum(n_chars) * 0.002))::BIGINT AS baseline, greatest(1, ceil(sum(n_chars) * 0.001))::BIGINT AS floor_ FROM documents GROUP BY source),
h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kind) AS ord FROM (SELECT source, lang AS kind, count(*) AS hits FROM documents GROUP BY ALL)),
e AS (SELECT h.*, baseline, floor_, sum(hits) OVER w AS t, count(*) OVER w AS k, round_even(baseline * hits / sum(hits) OVER w, 0)::BIGINT AS e0 FROM h JOIN b USING (source) WINDOW w AS (PARTITION BY source)),
g AS (SELECT *, greatest(0, baseline - sum(e0) OVER (PARTITION BY source)) AS gap FROM e),
f AS (SELECT *, (e0 + gap // k + CASE WHEN ord - 1 < gap % k THEN 1 ELSE 0 END)::BIGINT AS e1 FROM g)
SELECT source, kind, ord::INTEGER AS ord, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY e1 DESC, ord) = 1 THEN greatest(e1, floor_) ELSE e1 END AS estimate, baseline FROM f""")
def estimate_counts(t):
    from pyspark.sql import Window

    hits = t("documents").groupBy("source", F.col("lang").alias("kind")).agg(F.count("*").alias("hits"))
    hits = hits.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy("kind")))
    return quality.estimate_counts(t("documents").select("source", F.col("n_chars").alias("lines")), hits, "source")


RESPONSES = """'```json\n{"score": ' || quality * 3 || ', "inconsistencies": []}\n```'"""


@query("SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN quality * 3 WHEN doc_id % 3 = 1 THEN quality + 1 ELSE toxic END)::INTEGER AS score FROM labels")
def score_in_text(t):
    q, x = F.col("quality"), F.col("toxic")
    text = (
        F.when(F.col("doc_id") % 3 == 0, F.format_string('Verdict:\n```json\n{"score": %d, "note": "ok"}\n```', q * 3))
        .when(F.col("doc_id") % 3 == 1, F.format_string("Usefulness (scores ONLY): %d of 4", q + 1))
        .otherwise(F.format_string("I would give it a %d .", x))
    )
    return t("labels").select("doc_id", X.score_in_text(text).alias("score"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (quality + toxic) * 45.0 + 10 WHEN 1 THEN 95.0 + toxic ELSE 96.5 END::DOUBLE AS score, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'fail' ELSE 'pass' END AS status,
CASE doc_id % 3 WHEN 0 THEN quality + toxic = 2 WHEN 1 THEN false ELSE true END AS passed FROM labels""")
def total_score(t):
    n, q, x = F.col("doc_id") % 3, F.col("quality"), F.col("toxic")
    text = F.when(n == 0, F.format_string('{"scores": {"a": {"score": 3}, "total": %d}, "status": "OK"}', (q + x) * 45 + 10))
    text = text.when(n == 1, F.format_string("# report\ntotal_score: 0.%d\nstatus: pass\nstatus: FAIL\n", 95 + x)).otherwise(F.lit("overall_score = 40\ntotal_score: **96.5**\nStatus: Pass"))
    return t("labels").select("doc_id", X.total_score(text).alias("s")).select("doc_id", "s.*")


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 100.0 ELSE 100.0 - least(100, p) END::DOUBLE AS score FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n, sum(CASE l_returnflag WHEN 'A' THEN 5 WHEN 'R' THEN 50 ELSE 0 END) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def severity_score(t):
    sev = F.when(F.col("l_returnflag") == "A", "Small").when(F.col("l_returnflag") == "R", "Major").otherwise("Minor")
    found = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.lit("x").alias("inconsistency"), sev.alias("severity"))).alias("i"))
    return t("orders").select("o_orderkey").join(found, "o_orderkey", "left").select("o_orderkey", quality.severity_score(F.col("i")).alias("score"))


@query("""SELECT doc_id AS case_id, quality * 3 / 4.0 AS functional_correctness, CASE WHEN doc_id % 5 > 0 THEN toxic * 2 / 4.0 END AS usefulness, 0.8 AS code_judge,
CASE WHEN doc_id % 5 > 0 THEN round_even((quality * 3 / 4.0 + toxic * 2 / 4.0 + 0.8) / 3, 4) END AS mean FROM labels""")
def judge_metric(t):
    l = t("labels").select(F.col("doc_id").alias("case_id"), "quality", "toxic")  # noqa: E741
    rows = l.select("case_id", F.lit("functional_correctness").alias("metric"), (F.col("quality") * 3.0).alias("score"))
    rows = rows.unionByName(l.filter("case_id % 5 > 0").select("case_id", F.lit("usefulness").alias("metric"), (F.col("toxic") * 2.0).alias("score")))
    return quality.judge_metric(rows.unionByName(l.select("case_id", F.lit("code_judge").alias("metric"), F.lit(80.0).alias("score"))))


@query("""SELECT user_id, round_even(sum(CASE event_type WHEN 'view' THEN 0.2 WHEN 'click' THEN 0.3 ELSE 0 END * 100), 2)::DOUBLE AS total,
CASE WHEN round_even(sum(CASE event_type WHEN 'view' THEN 0.2 WHEN 'click' THEN 0.3 ELSE 0 END * 100), 2) >= 95 THEN 'pass' WHEN round_even(sum(CASE event_type WHEN 'view' THEN 0.2 WHEN 'click' THEN 0.3 ELSE 0 END * 100), 2) >= 80 THEN 'warning' ELSE 'fail' END AS verdict
FROM events GROUP BY user_id""")
def rubric_score(t):
    dims = t("events").select("user_id", F.col("event_type").alias("dimension"), F.lit(100.0).alias("score"))
    return quality.rubric_score(dims, "user_id", {"view": 0.2, "click": 0.3})


@query("""WITH m AS (SELECT md5(text) AS k, CASE WHEN quality = 1 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, source AS note, source FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL AND text IS NOT NULL)
SELECT k, max(confidence) AS confidence, min(note) FILTER (confidence = mx) AS note, list_sort(list(DISTINCT source)) AS sources, CASE WHEN max(confidence) >= 0.9 THEN 'high' ELSE 'low' END AS tier
FROM (SELECT *, max(confidence) OVER (PARTITION BY k) AS mx FROM m) GROUP BY k""")
def merge_best(t):
    rows = t("documents").join(t("labels"), "doc_id").filter("source IS NOT NULL AND text IS NOT NULL").select(
        F.md5("text").alias("k"), F.when(F.col("quality") == 1, 0.9).otherwise(0.6).alias("confidence"), F.col("source").alias("note"), F.array("source").alias("sources")
    )
    return catalog.merge_best(rows, "k", "confidence", "note", ["sources"])


PLAIN = "translate(regexp_replace(coalesce(text, ''), '[*_`]+', '', 'g'), '：，（）；！？', ':,();!?')"


@query(f"""SELECT doc_id, list_sort(list_filter([CASE WHEN NOT contains({PLAIN}, 'the') THEN 'has the' END, CASE WHEN contains({PLAIN}, '!!') THEN 'no shouting' END,
CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) < 2 THEN 'two numbers' END, CASE WHEN length(coalesce(text, '')) < 500 THEN 'long enough' END, 'heading',
CASE WHEN len(regexp_extract_all(coalesce(text, ''), 'qu')) > 3 THEN 'few qu' END, 'boxes'], lambda x: x IS NOT NULL)) AS errors FROM documents""")
def contract_check(t):
    rows = [
        ("has the", "token", "the", 0), ("no shouting", "forbidden", "!!", 0), ("two numbers", "pattern", "[0-9]+", 2), ("long enough", "min_chars", "", 500),
        ("heading", "heading", "Overview of everything", 0), ("section", "section", "Overview of everything", 20), ("few qu", "at_most", "qu", 3), ("boxes", "checkboxes", "", 1),
    ]
    return quality.contract_check(t("documents"), rows, "doc_id", "text")


@query("""WITH m AS (SELECT conv_id, count(*) AS n, string_agg(role || ' ' || turn, ',') AS h FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, length(trim(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^#+\\s', '', 'g'), '^\\s+|\\s+$', '', 'g'))) AS c FROM conversations WHERE role = 'user' AND turn = 0)
SELECT conv_id, list_filter(['no appendix', CASE WHEN c BETWEEN 1 AND 199 THEN 'short question' END], lambda x: x IS NOT NULL) AS errors, (1 - 0.1 * len(errors))::DOUBLE AS score FROM m LEFT JOIN u USING (conv_id)""")
def section_rules(t):
    checked = quality.contract_check(_conversation_md(t), [("no appendix", "heading", "Appendix of tables", 0), ("short question", "section", "user 0", 200)], "conv_id", "text")
    return quality.spec_quality(checked)


@query("""SELECT doc_id, term, severity, len(regexp_extract_all(lower(text), '\\b' || term || '\\b'))::INTEGER AS n FROM documents, (VALUES ('the', 'low'), ('with', 'high')) AS v(term, severity)
WHERE len(regexp_extract_all(lower(text), '\\b' || term || '\\b')) > 0""")
def ambiguity_findings(t):
    return quality.ambiguity_findings(t("documents").filter("text IS NOT NULL"), "doc_id", "text", [("the", "low"), ("with", "high")])


def _todo_items(t):
    s = F.when(F.col("o_orderkey") % 5 == 0, "failed").when(F.col("o_orderkey") % 5 == 1, "pending").otherwise("DONE")
    return t("orders").select(F.col("o_orderstatus").alias("track"), F.col("o_orderkey").alias("k"), s.alias("s"))


@query("""WITH l AS (SELECT o_orderstatus AS track, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'done' END AS s FROM orders)
SELECT track, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s <> 'done') = 0 AS passed FROM l GROUP BY track""")
def todo_gate(t):
    return quality.todo_gate(_todo_items(t), "track", "s")


@query("SELECT o_orderstatus AS track, o_orderkey AS k FROM orders WHERE o_orderkey % 5 = 0")
def todo_failed(t):
    return quality.todo_failed(_todo_items(t), "track", "k", "s")


@query("""WITH l AS (SELECT l_orderkey AS path, l_linenumber AS line, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS h FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2),
m AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM l WHERE h = 0), r AS (SELECT path, min(line) AS a, max(line) AS b FROM m GROUP BY path, g),
x AS (SELECT path, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS gaps FROM r GROUP BY path)
SELECT path, sum(h)::BIGINT AS covered, count(*) AS total, round_even(100.0 * sum(h) / count(*), 2)::DOUBLE AS percent, round_even(100.0 * sum(h) / count(*), 2) >= 80 AS passed, coalesce(max(gaps), '') AS gaps FROM l LEFT JOIN x USING (path) GROUP BY path""")
def incremental_coverage(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "N").cast("int").alias("hits"))
    return quality.incremental_coverage(lines, t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path")))


SHINGLES = r"""
w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
st AS (SELECT doc_id, list_sort(list(s)) AS st FROM sh GROUP BY doc_id), rep AS (SELECT st, min(doc_id) AS doc_id, len(st) AS n FROM st GROUP BY st),
sr AS (SELECT sh.* FROM sh JOIN rep USING (doc_id)),
cm AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sr x JOIN sr y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)"""


@query(f"WITH {SHINGLES} SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM cm JOIN rep x ON x.doc_id = a JOIN rep y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8")
def near_duplicates(t):
    return quality.near_duplicates(t("documents").select("doc_id", "text"), "doc_id", "text")


@query(f"""WITH RECURSIVE {SHINGLES},
m AS (SELECT st.doc_id, rep.doc_id AS r, count(*) OVER (PARTITION BY rep.doc_id) AS w FROM st JOIN rep USING (st)),
p AS (SELECT a, b FROM cm JOIN rep x ON x.doc_id = a JOIN rep y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT doc_id AS a, doc_id AS b FROM rep UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS g FROM reach GROUP BY a), k AS (SELECT l.a, sum(w) AS k FROM l JOIN (SELECT DISTINCT r, w FROM m) ON r = l.b GROUP BY l.a)
SELECT doc_id, coalesce(r, doc_id) AS representative, coalesce(g, doc_id) AS class_id, (coalesce(k, 0) + coalesce(w, 1) - 1)::BIGINT AS n_links
FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN g ON g.a = r LEFT JOIN k ON k.a = r""")
def near_duplicate_classes(t):
    return quality.near_duplicate_classes(t("documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "representative", "class_id", "n_links")


@query(f"""WITH RECURSIVE {SHINGLES},
p AS (SELECT a, b FROM cm JOIN rep x ON x.doc_id = a JOIN rep y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT doc_id AS a, doc_id AS b FROM rep UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS g FROM reach GROUP BY a), m AS (SELECT st.doc_id, rep.doc_id AS r FROM st JOIN rep USING (st))
SELECT g AS doc_id, coalesce(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), []) AS sources FROM m JOIN g ON g.a = m.r JOIN documents d ON d.doc_id = m.doc_id GROUP BY g
UNION ALL SELECT doc_id, list_filter([source], lambda x: x IS NOT NULL) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM st)""")
def consolidate_documents(t):
    return consolidate.consolidate_texts(t("documents").select("doc_id", "text", "source"), "doc_id", "text", "source", "sources")


# ---------------------------------------------------------------- graph


def _geo_edges(t):
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in_region").alias("relation"))
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("in_nation").alias("relation"))
    o = t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), F.lit("by").alias("relation"))
    return n.unionByName(c).unionByName(o)


GEO = """g AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in_region' AS relation FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation' FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'by' FROM orders), u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g)"""


@query(f"WITH RECURSIVE {GEO}, w AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN u ON u.a = w.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def bfs(t):
    edges = _geo_edges(t)
    return graph.bfs_subgraph(edges, t("region").filter("r_regionkey = 0").select(F.concat(F.lit("r"), "r_regionkey").alias("id")), 3)


@query(f"WITH RECURSIVE {GEO}, w AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN u ON u.a = w.node WHERE depth < 2) SELECT src, dst, relation FROM g WHERE src IN (SELECT node FROM w) AND dst IN (SELECT node FROM w)")
def touching_edges(t):
    edges = _geo_edges(t)
    found = graph.bfs_subgraph(edges, t("region").filter("r_regionkey = 0").select(F.concat(F.lit("r"), "r_regionkey").alias("id")), 2)
    return graph.touching_edges(edges, found)


@query(f"""WITH RECURSIVE {GEO}, w AS (SELECT 'c1' AS node, 0 AS d UNION SELECT u.b, d + 1 FROM w JOIN u ON u.a = w.node WHERE d < 6)
SELECT 'c' || c_custkey AS a, 'c1' AS b, min(d) AS hops FROM customer JOIN w ON node = 'c' || c_custkey WHERE c_custkey % 100 = 0 GROUP BY 1, 2""")
def shortest_path(t):
    pairs = t("customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.lit("c1").alias("b"))
    return graph.shortest_paths(_geo_edges(t), pairs, 6).select("a", "b", "hops")


@query(f"""WITH {GEO}, b AS (SELECT 'n' || n_nationkey AS id, n_name AS label FROM nation WHERE contains(lower(n_name), 'nation_1') ORDER BY 1 LIMIT 5),
x AS (SELECT src AS id, 'out' AS way, relation, dst AS other FROM g UNION ALL SELECT dst, 'in', relation, src FROM g)
SELECT id, way, relation, other, label, count(*) OVER (PARTITION BY id) AS degree FROM x JOIN b USING (id)""")
def explain(t):
    nodes = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return graph.explain_node(nodes, _geo_edges(t), "Nation_1", 5)


def _geo_nodes(t):
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("label"))
    return n.unionByName(r).unionByName(t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lower("c_name").alias("label")))


GEO_NODES = """ns AS (SELECT 'n' || n_nationkey AS id, n_name AS label FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region UNION ALL SELECT 'c' || c_custkey, lower(c_name) FROM customer)"""


@query(f"""WITH {GEO_NODES} SELECT id, label, contains(lower(label), 'east')::INT + contains(lower(label), 'customer')::INT + contains(lower(label), '7')::INT AS score FROM ns
WHERE contains(lower(label), 'east') OR contains(lower(label), 'customer') OR contains(lower(label), '7') ORDER BY score DESC, id LIMIT 50""")
def seed_nodes(t):
    return graph.seed_nodes(_geo_nodes(t), ["East", "customer", "7"], 50)


@query(f"""WITH {GEO}, {GEO_NODES}, a AS (SELECT id FROM ns WHERE contains(lower(label), 'customer#000000007') ORDER BY id LIMIT 1),
p AS (SELECT c.src AS c, c.dst AS n, n.dst AS r FROM g c JOIN g n ON n.src = c.dst JOIN a ON a.id = c.src WHERE c.src LIKE 'c%'),
h AS (SELECT 1 AS hop, c AS src, n AS dst, 'in_nation' AS relation FROM p UNION ALL SELECT 2, n, r, 'in_region' FROM p)
SELECT a.id AS a, r AS b, hop, src, dst, relation, NULL::VARCHAR AS confidence FROM h, a, p""")
def path_between(t):
    nation = t("customer").filter("c_custkey = 7").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    region = nation.join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name").first()[0]
    return graph.path_between(_geo_nodes(t), _geo_edges(t), "Customer#000000007", region)


@query(f"WITH RECURSIVE {GEO}, w AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN u ON u.a = w.node WHERE depth < 6) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def dfs(t):
    return graph.dfs_subgraph(_geo_edges(t), t("nation").filter("n_nationkey = 3").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))


# a ring of four parts for every four, with a caller outside where the number of the ring is even; keys come in whole fours in the given tables
RINGS = """e AS (SELECT p_partkey AS src, p_partkey // 4 * 4 + (p_partkey + 1) % 4 AS dst FROM part UNION ALL SELECT -1 - p_partkey // 4, p_partkey FROM part WHERE p_partkey % 8 = 2),
n AS (SELECT p_partkey AS id FROM part UNION SELECT src FROM e)"""


def _rings(t):
    k = F.col("p_partkey")
    ring = F.floor(k / 4)
    e = t("part").select(k.alias("src"), (ring * 4 + (k + 1) % 4).alias("dst")).unionByName(t("part").filter(k % 8 == 2).select((-1 - ring).alias("src"), k.alias("dst")))
    return t("part").select(k.alias("id")).union(e.select("src")).distinct(), e


# of a ring with a caller the caller is released first (it has no more open links than the others), and the ring when all others are done
@query(f"""WITH {RINGS} SELECT id, CASE WHEN id < 0 THEN 0 ELSE (4 - id % 4) % 4 + CASE WHEN id // 4 % 2 = 0 THEN 4 ELSE 0 END END::INTEGER AS layer FROM n""")
def cycle_layers(t):
    return graph.topo_layers(*_rings(t))


@query(f"""WITH {RINGS} SELECT id, CASE WHEN id < 0 THEN id ELSE id // 4 * 4 END AS component FROM n""")
def strong_components(t):
    return graph.strong_components(*_rings(t))


@query(f"""WITH {RINGS} SELECT id, CASE WHEN id < 0 THEN id ELSE id // 4 * 4 END AS component, CASE WHEN id < 0 THEN 1 ELSE 0 END::INTEGER AS layer FROM n""")
def collapsed_layers(t):
    return graph.collapsed_layers(*_rings(t))


@query(f"""WITH {RINGS} SELECT id FROM n WHERE id < 0 UNION ALL SELECT p_partkey + 1 FROM part WHERE p_partkey % 8 = 4""")
def cycle_roots(t):
    nodes, edges = _rings(t)
    return graph.call_roots(nodes, edges)


@query("""SELECT 'f' || o_orderkey || '###u' || o_orderkey AS key, 'f' || o_orderkey AS root_name, 'u' || o_orderkey AS uuid, (1 + count(DISTINCT l_partkey))::BIGINT AS reached, 1 AS depth, o_orderpriority AS kind
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority""")
def root_functions(t):
    name = lambda k: F.concat(F.lit("f"), k, F.lit("###u"), k)
    edges = t("lineitem").select(name("l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    calling = t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).hint("merge"), "o_orderkey", "left_semi")
    trees = graph.call_trees(calling.select(name("o_orderkey").alias("id")), edges, max_nodes=10_000)
    elements = t("orders").select(name("o_orderkey").alias("key"), F.col("o_orderpriority").alias("kind"))
    return graph.root_functions(trees, elements)


ELEMENTS = """el AS (SELECT 'c' || c_custkey || '###u' || c_custkey AS key, 's' || c_custkey AS uuid FROM customer),
rf AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'u' || o_custkey WHEN 1 THEN 'c' || o_custkey || '###u' || o_custkey WHEN 2 THEN 's' || o_custkey WHEN 3 THEN '' END AS ref, o_custkey FROM orders)"""


@query(f"""WITH {ELEMENTS} SELECT o_orderkey, ref, CASE WHEN ref <> '' AND o_custkey IN (SELECT c_custkey FROM customer) THEN 'c' || o_custkey || '###u' || o_custkey END AS key FROM rf""")
def lookup_element(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ref = F.when(k % 5 == 0, F.concat(F.lit("u"), c)).when(k % 5 == 1, F.format_string("c%d###u%d", c, c)).when(k % 5 == 2, F.concat(F.lit("s"), c)).when(k % 5 == 3, "")
    elements = t("customer").select(F.format_string("c%d###u%d", "c_custkey", "c_custkey").alias("key"), F.concat(F.lit("s"), "c_custkey").alias("uuid"))
    return graph.lookup_element(t("orders").select(k, ref.alias("ref"), c), elements).select("o_orderkey", "ref", "key")


@query("""WITH i AS (SELECT p_brand AS c, p_name AS n, min(p_partkey) AS k FROM part GROUP BY ALL), b AS (SELECT i.*, CASE WHEN k % 3 > 0 THEN p_type ELSE '' END AS body FROM i JOIN part ON p_partkey = k)
SELECT s_suppkey, 'public' AS access, CASE WHEN body <> '' THEN body ELSE 'declared' END AS content, CASE WHEN k IS NULL THEN 'h' ELSE 'f' || k END AS filename, CASE WHEN k IS NULL THEN ['none'] ELSE ['d' || k] END AS dependencies
FROM supplier LEFT JOIN part p ON p.p_partkey = s_suppkey * 3 LEFT JOIN b ON b.c = p.p_brand AND b.n = p.p_name""")
def merge_decl_impl(t):
    named = t("part").select(F.col("p_partkey").alias("_k"), F.col("p_brand").alias("class_name"), F.col("p_name").alias("name"))
    decl = t("supplier").select("s_suppkey", (F.col("s_suppkey") * 3).alias("_k"), F.lit("public").alias("access"), F.lit("declared").alias("content"), F.lit("h").alias("filename"), F.array(F.lit("none")).alias("dependencies"))
    decl = decl.join(named, "_k", "left").drop("_k")
    k = F.col("p_partkey")
    impl = t("part").select(
        F.format_string("%012d", k).alias("key"), F.col("p_brand").alias("class_name"), F.col("p_name").alias("name"), F.when(k % 3 > 0, F.col("p_type")).otherwise("").alias("content"),
        F.concat(F.lit("f"), k).alias("filename"), F.array(F.concat(F.lit("d"), k)).alias("dependencies"),
    )
    return graph.merge_decl_impl(decl, impl).select("s_suppkey", "access", "content", "filename", "dependencies")


@query("""WITH m AS (SELECT p_name AS n, min(p_partkey) AS k, count(*) AS c FROM part GROUP BY 1), b AS (SELECT p_name AS n, lower(p_brand) AS cl, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT o_orderkey AS call_id, coalesce((SELECT min(b.k) FROM b WHERE b.n = p_name AND contains(b.cl, '#' || o_orderkey % 30)), m.k) AS key, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.n = p_name AND contains(b.cl, '#' || o_orderkey % 30)) THEN 6 WHEN c = 1 THEN 4 ELSE 5 END AS rule
FROM orders JOIN part p ON p_partkey = o_orderkey % (SELECT count(*) FROM part) JOIN m ON m.n = p_name""")
def resolve_loosely(t):
    elements = t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("class_name"), F.lit("a.py").alias("filename"))
    n = t("part").count()
    named = t("part").select(F.col("p_partkey").alias("_p"), "p_name")
    calls = t("orders").withColumn("_p", F.col("o_orderkey") % n).join(named, "_p")
    call = F.concat(F.lit("#"), (F.col("o_orderkey") % 30).cast("string"), F.lit("."), F.col("p_name"))
    return graph.resolve_names(calls.select(F.col("o_orderkey").alias("call_id"), call.alias("name"), F.lit("x").alias("scope")), elements, loose=True)


@query(f"""WITH RECURSIVE {GEO}, d AS (SELECT src AS id FROM g UNION SELECT dst FROM g),
w AS (SELECT id, 0 AS l FROM d WHERE id LIKE 'r%' UNION SELECT src, l + 1 FROM w JOIN g ON g.dst = w.id) SELECT id, max(l) AS layer FROM w GROUP BY id""")
def topo_layers(t):
    e = _geo_edges(t)
    return graph.topo_layers(e.select(F.col("src").alias("id")).union(e.select("dst")), e)


@query("""SELECT 'o' || o_orderkey AS root, 'o' || o_orderkey AS node, 0 AS depth FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 1 FROM orders UNION ALL SELECT 'o' || o_orderkey, 'n' || c_nationkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'o' || o_orderkey, 'r' || n_regionkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def call_trees(t):
    e = _geo_edges(t)
    roots = graph.call_roots(t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id")), e)
    return graph.call_trees(roots, e).select("root", "node", "depth")


@query("""WITH e AS (SELECT 'n' || n_nationkey AS key, n_name AS name, r_name AS cls FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey AS call_id, key, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 2 ELSE 3 END AS rule FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN e ON e.name = n_name""")
def resolve_names(t):
    geo = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    elements = geo.select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("r_name").alias("class_name"))
    calls = t("customer").join(geo, F.col("n_nationkey") == F.col("c_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("self."), "n_name")).otherwise(F.concat("r_name", F.lit("::"), "n_name"))
    return graph.resolve_names(calls.select(F.col("c_custkey").alias("call_id"), name.alias("name"), F.col("r_name").alias("scope")), elements)


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0")
def mention_edges(t):
    return graph.mention_edges(t("documents"), t("benchmark"))


@query("""SELECT DISTINCT lower(w) AS token FROM (SELECT unnest(regexp_extract_all(p_name, '[A-Za-z]+')) AS w FROM part) WHERE length(w) BETWEEN 3 AND 30 AND NOT regexp_matches(w, '[a-z][A-Z]|[A-Z]{2}')""")
def vocabulary(t):
    return graph.vocabulary(t("part").select(F.col("p_name").alias("label")))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, sum(n_chars + 1) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT doc_id, lang, length(text) AS n_chars FROM documents WHERE text IS NOT NULL)) WHERE s <= 80000""")
def budgeted_context(t):
    return graph.budgeted_context(t("documents").filter("text IS NOT NULL").select("doc_id", "lang", "text"), "lang", ["doc_id"], "text", 20000).select("doc_id", "lang")


# ---------------------------------------------------------------- tracking

STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'unknown' END"


def _status():
    s = F.col("event_type")
    return F.when(s == "signup", "pending").when(s == "view", "processing").when(s == "purchase", "completed").when(s == "error", "failed").otherwise("unknown")


def _events(t):
    return t("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), _status().alias("status"), F.col("value").alias("seconds"))


@query(f"""WITH e AS (SELECT user_id, {STATUS} AS s FROM events) SELECT user_id, count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'processing') AS processing, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed,
count(*) FILTER (s IN ('completed', 'failed')) AS processed, round_even(100.0 * count(*) FILTER (s IN ('completed', 'failed')) / count(*), 2)::DOUBLE AS percent FROM e GROUP BY user_id""")
def progress(t):
    return tracking.progress(_events(t), ["user_id"])


@query(f"""WITH e AS (SELECT user_id, value, {STATUS} AS s FROM events) SELECT user_id, round(avg(value) FILTER (s = 'completed'), 6) AS mean_seconds, count(*) FILTER (s NOT IN ('completed', 'failed')) AS "left",
round(avg(value) FILTER (s = 'completed') * count(*) FILTER (s NOT IN ('completed', 'failed')), 3) AS eta_seconds FROM e GROUP BY user_id""")
def eta(t):
    return tracking.eta(_events(t), ["user_id"])


@query(f"""WITH e AS (SELECT user_id, {STATUS} AS s FROM events) SELECT user_id, CASE WHEN bool_and(s = 'pending') THEN 'pending' WHEN bool_or(s IN ('processing', 'pending')) THEN 'processing' WHEN bool_or(s = 'completed') THEN 'completed' ELSE 'failed' END AS status FROM e GROUP BY user_id""")
def group_status(t):
    return tracking.group_status(_events(t), "user_id")


@query(f"""WITH e AS (SELECT user_id AS batch_number, {STATUS} AS s FROM events) SELECT batch_number, count(*) AS total, count(*) FILTER (s = 'completed') AS done, CASE WHEN count(*) FILTER (s = 'completed') = count(*) THEN 'completed' ELSE 'incomplete' END AS status FROM e GROUP BY 1""")
def recount_batches(t):
    return tracking.recount_batches(_events(t).withColumnRenamed("user_id", "batch_number"))


@query(f"SELECT user_id, event_id, {STATUS} AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(t):
    return tracking.latest_per_key(_events(t), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "status")


@query("""WITH f AS (SELECT user_id, event_type AS stage, min({'a': ts, 'b': event_id}) AS m FROM events GROUP BY ALL) SELECT user_id, list(stage ORDER BY m) AS stages FROM f GROUP BY user_id""")
def stage_list(t):
    return tracking.accumulate_distinct(t("events").withColumnRenamed("event_type", "stage"), "user_id", "stage", ["ts", "event_id"])


@query("""WITH v AS (SELECT user_id, event_id, event_type = 'purchase' AS p FROM events WHERE event_type IN ('purchase', 'error')),
l AS (SELECT user_id, max(event_id) FILTER (p) AS lastp, max(event_id) AS e FROM v GROUP BY 1)
SELECT user_id, count(*) FILTER (NOT p AND event_id > coalesce(lastp, -1)) AS attempts, CASE WHEN lastp = e THEN 'CONVERGED' WHEN count(*) FILTER (NOT p AND event_id > coalesce(lastp, -1)) >= 3 THEN 'EXHAUSTED' ELSE 'RETRY' END AS outcome FROM v JOIN l USING (user_id) GROUP BY user_id, lastp, e""")
def attempts(t):
    v = t("events").filter("event_type IN ('purchase', 'error')").select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("passed"))
    return tracking.attempt_counter(v, "user_id")


@query("""WITH o AS (SELECT o_orderpriority, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END AS s FROM orders),
m AS (SELECT *, min(CASE s WHEN 'pending' THEN 0 WHEN 'processing' THEN 1 END) OVER (PARTITION BY o_orderpriority) AS m FROM o WHERE s <> 'completed')
SELECT o_orderpriority, o_orderkey FROM m WHERE (m = 0) = (s = 'pending') QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 3""")
def next_work(t):
    s = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed")
    rows = t("orders").select("o_orderpriority", "o_orderkey", s.alias("status"))
    return tracking.next_work(rows, ["o_orderpriority"], catalog.order_by_numeric_id(rows, "o_orderkey"), 3).select("o_orderpriority", "o_orderkey")


@query("""WITH n AS (SELECT max(ts) AS n FROM events), l AS (SELECT user_id, min(ts) AS a, max(ts) AS b, bool_or(event_type = 'purchase') AS d FROM events GROUP BY 1)
SELECT user_id, CASE WHEN d THEN 'done' WHEN epoch(n - a) > 864000 THEN 'timeout' WHEN epoch(n - b) > 86400 THEN 'stale' ELSE 'running' END AS state FROM l, n""")
def stale_sessions(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts")).first()[0]
    out = tracking.stale_sessions(e, "user_id", "ts", F.col("event_type") == "purchase", F.lit(now), 86400.0, 864000.0)
    return out.select("user_id", "state")


@query("""SELECT user_id, event_id, row_number() OVER w AS iteration, lead(1) OVER w IS NOT NULL AS followed, CASE WHEN event_type <> 'error' THEN 'stop' WHEN row_number() OVER w >= 3 THEN 'abort' ELSE 'retry' END AS action FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def iteration_history(t):
    out = tracking.iteration_history(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return out.select("user_id", "event_id", F.col("iteration").cast("long").alias("iteration"), "followed", "action")


# ---------------------------------------------------------------- Markdown: render known rows, parse them back


def _conversation_md(t):
    turns = t("conversations").select("conv_id", "turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^#+\s", "").alias("text"))
    item = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))), lambda s: s["x"]), "")
    return turns.groupBy("conv_id").agg(F.concat(F.lit("# conversation\nintro\n"), joined).alias("text"))


MD_TURNS = """m AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '(?m)^#+\\s', '', 'g') AS text FROM conversations)"""


@query(rf"""WITH {MD_TURNS} SELECT conv_id, role || ' ' || turn AS heading, md5(regexp_replace(text, '\s+$', '')) AS body FROM m""")
def sections_roundtrip(t):
    sections = X.h2_sections(F.col("text"))
    return _conversation_md(t).select("conv_id", F.explode(sections).alias("heading", "b")).select("conv_id", "heading", F.md5("b").alias("body"))


@query(rf"""WITH {MD_TURNS} SELECT conv_id, 'conversation > ' || role || ' ' || turn AS breadcrumb, md5(trim(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS body FROM m
UNION ALL SELECT DISTINCT conv_id, 'conversation', md5('intro') FROM m""")
def breadcrumbs(t):
    rows = chunking.heading_sections(_conversation_md(t), "conv_id").filter(F.size("breadcrumb") > 0)
    return rows.select("conv_id", F.array_join("breadcrumb", " > ").alias("breadcrumb"), F.md5(X.strip(F.col("body"))).alias("body"))


@query()
def chunk_markdown(t):
    return chunking.chunk_documents(_conversation_md(t), "conv_id").select("conv_id", "chunk_no", "breadcrumb", "location", X.content_hash(F.col("chunk")).alias("hash"))


@query("SELECT doc_id, lang, source, 'x' AS extra, md5(coalesce(text, '')) AS body FROM documents")
def frontmatter_roundtrip(t):
    text = F.concat(F.lit("---\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\nsource: old\n---\n"), F.coalesce("text", F.lit("")))
    docs = t("documents").select("doc_id", X.set_front_matter(X.set_front_matter(text, "source", F.coalesce("source", F.lit(""))), "extra", F.lit("x")).alias("t"))
    fm = X.front_matter(F.col("t"))
    pick = lambda k: F.try_element_at(fm, F.lit(k)).alias(k)
    return docs.select("doc_id", pick("lang"), pick("source"), pick("extra"), F.md5(X.body(F.col("t"))).alias("body"))


@query("""SELECT n_nationkey AS doc_id, (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey))::INTEGER AS number, s_name AS title, 'S-' || s_suppkey AS id, 'supplier of ' || n_name AS type, s_suppkey::VARCHAR AS diagram
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def fields_roundtrip(t):
    s = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    n = F.format_string("\n### %d. %s\n- **id**: S-%d\n- **type**: supplier  of\n  %s\n\n```plantuml\n%d\n```\n", "r", "s_name", "s_suppkey", "n_name", "s_suppkey")
    from pyspark.sql import Window

    s = s.withColumn("r", F.row_number().over(Window.partitionBy("n_nationkey").orderBy("s_suppkey")))
    docs = s.groupBy(F.col("n_nationkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", n.alias("x")))), lambda z: z["x"]), "").alias("text"))
    return consolidate.entity_blocks(docs, fields=("id", "type")).select("doc_id", "number", "title", "id", "type", "diagram")


@query("SELECT r_regionkey AS doc_id, n_name AS cell FROM region JOIN nation ON n_regionkey = r_regionkey")
def table_roundtrip(t):
    rows = t("nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.format_string("| %d | %s |", "n_nationkey", "n_name")), "\n").alias("rows"))
    text = F.concat(F.lit("# a\n| name |\n|---|\n| no |\n\n## Nations\n\n| key | name |\n|---|:-:|\n"), F.col("rows"), F.lit("\n\n## End\n"))
    return rows.select(F.col("n_regionkey").alias("doc_id"), F.explode(X.table_column(text, "Nations", "name")).alias("cell"))


@query("""SELECT o_orderkey AS item, (l_linenumber - 1)::INTEGER AS pos, l_partkey AS part FROM (SELECT o_orderkey, l_partkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey)""")
def records_roundtrip(t):
    items = t("lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("part")))).alias("a"))
    arr = F.to_json(F.transform("a", lambda x: F.struct(x["part"].alias("part"))))
    text = F.when(F.col("item") % 2 == 0, arr).otherwise(F.concat(F.lit('{"version": 1, "items": '), arr, F.lit("}")))
    bad = t("region").select(F.lit(-1).cast("long").alias("item"), F.lit('{"items": [').alias("text"))
    good, _ = io.parse_records(items.select("item", text.alias("text")).unionByName(bad), "part long")
    return good.select("item", "pos", "part").join(t("orders").select(F.col("o_orderkey").alias("item")), "item", "left_semi")


@query("SELECT DISTINCT 'S' || s_suppkey AS entity_id, s_name AS title FROM supplier")
def lineage_roundtrip(t):
    e = F.struct(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("title"))
    listed = t("supplier").filter("s_suppkey % 2 = 0").select(F.to_json(F.struct(F.array(e).alias("entities"))).alias("text"))
    mapped = t("supplier").filter("s_suppkey % 2 = 1").select(F.to_json(F.create_map(e["entity_id"], F.struct(F.col("s_name").alias("title")))).alias("text"))
    return io.parse_lineage(listed.unionByName(mapped)).select("entity_id", "title")


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(url), '[\\/:*?"<>|\s]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') AS name FROM pages WHERE url IS NOT NULL""")
def safe_names(t):
    return t("pages").filter("url IS NOT NULL").select("page_id", X.safe_name(F.col("url")).alias("name"))


@query(r"""SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_props(t):
    n = F.col("event_id") % 3
    text = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("note: "), F.col("props"), F.lit(" end"))).otherwise(F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```\nwith {more} after")))
    return t("events").select("event_id", "user_id", X.json_in_text(text, "k int")["k"].alias("k"))


# ---------------------------------------------------------------- files: write the tables to the shared folder and read them back


def _shared(t, tag):
    from tracewell.sources.shared import new_path

    spark = t("nation").sparkSession
    return spark, new_path(spark, tag)


@query("""SELECT 'nation=' || c_nationkey AS folder, '.txt' AS ext, count(*) AS files_lines, md5(string_agg(c_name, chr(10) ORDER BY c_custkey)) AS text FROM customer GROUP BY c_nationkey""")
def scan_documents(t):
    spark, root = _shared(t, "documents")
    lines = t("customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name").repartition("nation").sortWithinPartitions("nation", "c_custkey")
    lines.select("nation", "c_name").write.partitionBy("nation").text(root)
    found = io.scan_documents(spark, root, (".txt", ".md")).filter(F.col("stem").startswith("part-"))
    body = F.regexp_replace("text", r"\n$", "")
    return found.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "ext", F.size(F.split(body, "\n")).cast("long").alias("files_lines"), F.md5(body).alias("text"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'NATION_' || c_nationkey END AS type_id FROM customer
WHERE (c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING') OR (c_custkey % 3 > 0 AND c_custkey % 2 = 0)""")
def scan_instances(t):
    k = F.col("c_custkey")
    path = F.when(k % 3 == 0, F.format_string("kb/NATION_%d/seg-%s/%d.md", "c_nationkey", F.lower("c_mktsegment"), k)).otherwise(F.format_string("kb/NATION_%d/other/%d.md", "c_nationkey", k))
    types = t("nation").select(F.col("n_name").alias("type_id"), F.lit(None).cast("string").alias("local_name"), F.lit(r"[02468]\.md$").alias("file_pattern"))
    segments = t("customer").select("c_mktsegment").distinct().filter("c_mktsegment <> 'BUILDING'")
    types = types.unionByName(segments.select(F.col("c_mktsegment").alias("type_id"), F.concat(F.lit("seg-"), F.lower("c_mktsegment")).alias("local_name"), F.lit(None).cast("string").alias("file_pattern")))
    files = t("customer").select("c_custkey", path.alias("path")).filter((k % 3 > 0) | (F.col("c_mktsegment") != "BUILDING"))
    return io.scan_instances(files, types).select("c_custkey", "type_id")


@query("""SELECT p_partkey, 'src/' || p_brand || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' ELSE '.PY' END AS path FROM part WHERE p_partkey % 4 < 2 AND p_type <> 'SMALL'""")
def scan_code_files(t):
    k = F.col("p_partkey")
    folder = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("src/build/"), "p_brand")).otherwise(F.concat(F.lit("src/"), "p_brand"))
    ext = F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".PY").when(k % 4 == 2, ".md").otherwise("")
    return io.scan_code_files(t("part").select("p_partkey", F.concat(folder, F.lit("/"), k.cast("string"), ext).alias("path")), "path", (".py", ".java"), ("build", "node_modules"))


@query("""SELECT o_orderkey AS item, o_custkey AS cust, CASE WHEN o_orderkey % 2 = 0 THEN 'list' ELSE 'envelope' END AS shape FROM orders UNION ALL SELECT -1, count(*), 'rejected' FROM region""")
def read_records(t):
    spark, root = _shared(t, "records")
    o = t("orders").withColumn("k", F.when(F.col("o_orderkey") % 2 == 0, "list").otherwise("envelope")).groupBy("k", F.floor(F.col("o_orderkey") / 500).alias("n"))
    arr = F.to_json(F.col("a"))
    o = o.agg(F.collect_list(F.struct(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("cust"))).alias("a"))
    texts = o.select(F.concat("k", F.lit("-"), "n").alias("file"), F.when(F.col("k") == "list", arr).otherwise(F.concat(F.lit('{"version": 1, "files": '), arr, F.lit("}"))).alias("text"))
    bad = t("region").select(F.concat(F.lit("bad-"), "r_regionkey").alias("file"), F.lit('{"files": [').alias("text"))
    texts.unionByName(bad).repartition("file").write.partitionBy("file").text(root)
    good, rejected = io.read_records(spark, root, "item long, cust long")
    good = good.select("item", "cust", F.regexp_extract("file", "file=([a-z]+)-", 1).alias("shape"))
    return good.unionByName(rejected.agg(F.lit(-1).cast("long").alias("item"), F.count("*").alias("cust")).withColumn("shape", F.lit("rejected")))


@query("""SELECT DISTINCT n_name AS source, c_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT DISTINCT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def read_relations(t):
    spark, root = _shared(t, "relations")
    c = t("customer").select(F.col("c_nationkey").alias("n"), F.col("c_name").alias("target")).unionByName(t("supplier").select(F.col("s_nationkey").alias("n"), F.col("s_name").alias("target")))
    edges = relations.distinct_edges(c.join(t("nation"), F.col("n") == F.col("n_nationkey")).select(F.col("n_name").alias("source"), "target"))
    rows = relations.adjacency(edges).select("source", F.to_json(F.array(F.struct("source", "targets"))).alias("text"))
    # one array a file
    rows.repartition("source").write.partitionBy("source").text(root)
    return io.read_relations(spark, f"{root}/*/part-*")


@query("SELECT DISTINCT o_custkey AS source, o_orderkey AS target FROM orders WHERE o_totalprice > 1000")
def write_relations(t):
    spark, root = _shared(t, "rebuilt")
    edges = t("orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), "o_totalprice")
    io.write_relations(edges.select("source", "target"), root)
    io.write_relations(edges.filter("o_totalprice > 1000").select("source", "target"), root)
    return spark.read.schema("source long, target long").json(root)


@query("""SELECT 'node' AS kind, 'c' || c_custkey AS src, c_name AS dst, c_mktsegment AS relation FROM customer UNION ALL SELECT 'edge', 'c' || c_custkey, 'n' || c_nationkey, 'in_nation' FROM customer""")
def read_graph(t):
    spark, root = _shared(t, "graph")
    c = t("customer").groupBy("c_nationkey").agg(
        F.collect_list(F.struct(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("file_type"))).alias("nodes"),
        F.collect_list(F.struct(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit("in_nation").alias("relation"))).alias("links"),
    )
    text = F.when(F.col("c_nationkey") % 2 == 0, F.to_json(F.struct("nodes", "links"))).otherwise(F.to_json(F.struct("nodes", F.col("links").alias("edges"))))
    c.select("c_nationkey", text.alias("text")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(root)
    nodes, edges = io.read_graph(spark, f"{root}/*/part-*")
    rows = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("src"), F.col("label").alias("dst"), F.col("file_type").alias("relation"))
    return rows.unionByName(edges.select(F.lit("edge").alias("kind"), "src", "dst", "relation"))


LOGGED = f"SELECT event_id::VARCHAR AS detail, user_id::VARCHAR AS session, event_type AS action, {STATUS} AS status FROM events"


def _log_rows(e):
    fields = {"time": F.col("ts").cast("string"), "session": F.col("user_id").cast("string"), "stage": F.lit("s"), "action": F.col("event_type"), "status": _status(), "elapsed": F.lit(None).cast("string"), "message": F.lit(""), "detail": F.col("event_id").cast("string")}
    return e.select(*[c.alias(n) for n, c in fields.items()])


@query(LOGGED)
def append_run_log(t):
    spark, root = _shared(t, "run-log")
    for part in (0, 1):
        io.append_run_log(_log_rows(t("events").filter(F.col("event_id") % 2 == part)), root)
    return spark.read.schema(io.RUN_LOG).parquet(root).select("detail", "session", "action", "status")


@query("""SELECT user_id AS batch_number, 'd' || event_id AS path, event_type AS body FROM events WHERE user_id % 3 = 0 AND event_type <> 'view'""")
def load_completed_batches(t):
    e = t("events")
    name = F.concat(F.lit("d"), "event_id")
    state = F.when(F.col("batch_number") % 3 == 0, "Completed").otherwise("failed")
    index = e.groupBy(F.col("user_id").alias("batch_number")).agg(F.collect_list(name).alias("entity_files")).withColumn("status", state)
    return io.load_completed_batches(index, e.filter("event_type <> 'view'").select(name.alias("path"), F.col("event_type").alias("body"))).select("batch_number", "path", "body")


@query("""SELECT row_number() OVER (ORDER BY source) AS no, source, array_to_string(list_sort(list(doc_id))[1:3], ', ') AS files_shown, (greatest(count(*) - 3, 0))::INTEGER AS files_more, 'docs/' || source AS link FROM documents WHERE source IS NOT NULL GROUP BY source""")
def inventory(t):
    rows = t("documents").filter("source IS NOT NULL").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    rows = rows.select("source", F.transform("ids", lambda x: x.cast("string")).alias("ids"))
    return catalog.inventory(rows, ["source"], "ids", link=F.concat(F.lit("docs/"), "source")).drop("ids")


@query("""SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, source, doc_id FROM documents""")
def rank_within(t):
    return catalog.rank_within(t("documents").select("source", "doc_id"), ["source"], ["doc_id"], "r")


# ---------------------------------------------------------------- instances, keys and headers


@query("SELECT 'DOC_' || doc_id AS id, lang AS type_id, source AS name, source AS brief FROM documents")
def instance_cards(t):
    return search.instance_cards(_instances(t), "source")


@query("""SELECT r_name AS type_id, coalesce(n, 0) AS n FROM region LEFT JOIN (SELECT 'ASIA' AS r_name, count(*) FILTER (c_nationkey % 5 = 2) AS n FROM customer UNION ALL SELECT 'EUROPE', count(*) FILTER (c_nationkey % 5 = 3) FROM customer) USING (r_name)""")
def describe_types(t):
    kind = F.when(F.col("c_nationkey") % 5 == 2, "ASIA").when(F.col("c_nationkey") % 5 == 3, "EUROPE")
    found = t("customer").select(kind.alias("type_id")).filter("type_id IS NOT NULL")
    return search.describe_types(t("region").select(F.col("r_name").alias("type_id")), found)


@query("""SELECT p_partkey, (f AND k) AS effective, CASE WHEN NOT f THEN 'not flagged' WHEN NOT k THEN 'type is not text' END AS note FROM (SELECT p_partkey,
CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_type IN ('SMALL', 'LARGE') ELSE false END AS f, p_brand <> 'Brand#1' AS k FROM part)""")
def searchable_attributes(t):
    n = F.col("p_size") % 4
    kind = F.when(F.col("p_type") == "SMALL", "vector").when(F.col("p_type") == "LARGE", "both").otherwise("none")
    rows = t("part").select("p_partkey", F.when(n == 0, True).when(n == 1, False).alias("vector"), F.when(n == 2, kind).alias("searchable"), F.when(F.col("p_brand") == "Brand#1", "code").when(n == 0, "list").alias("content_type"))
    return search.searchable_attributes(rows).select("p_partkey", "effective", "note")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'no header' WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 = 0 THEN 'number differs' END AS header_error FROM orders""")
def validate_batch_headers(t):
    k = F.col("o_orderkey")
    number = F.when(k % 3 == 0, None).when((k % 3 == 1) & (k % 5 == 0), k + 1).otherwise(k)
    rows = t("orders").select("o_orderkey", F.format_string("out/2024/batch_%d_result.json", k).alias("file"), number.alias("batch_number"))
    return catalog.validate_batch_headers(rows).select("o_orderkey", "header_error")


@query("""SELECT p_partkey, coalesce(regexp_matches(p_brand, '^Brand#[0-9]$'), false) AS key_ok FROM part""")
def validate_keys(t):
    return catalog.validate_keys(t("part"), "p_brand", r"^Brand#\d$").select("p_partkey", "key_ok")


@query("""SELECT o_orderkey AS k, o_orderstatus AS origin, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS source_no, CASE o_orderstatus WHEN 'P' THEN o_totalprice END AS price FROM orders""")
def union_batches(t):
    part = lambda s, *more: t("orders").filter(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("origin"), *more)
    return catalog.union_batches(part("O"), part("P", F.col("o_totalprice").alias("price")), part("F"))


@query("""WITH k AS (SELECT *, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand || ' ' ELSE '  ' END, '  '), p_name) AS key0 FROM part)
SELECT trim(key0) AS key, min(p_partkey) AS p_partkey, 'pending' AS status FROM k GROUP BY 1""")
def distinct_todos(t):
    rows = t("part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).otherwise("  ").alias("a"), F.lit(None).cast("string").alias("b"), F.col("p_name").alias("c"))
    return catalog.distinct_todos(rows, ["a", "b", "c"], ["p_partkey"]).select("key", "p_partkey", "status")


@query("""SELECT coalesce(source, '') AS h, doc_id, list_distinct(list_transform([source], x -> x)) AS sources FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT md5(text), min(doc_id), list_sort(list(DISTINCT source)) FROM documents WHERE doc_id % 4 > 0 AND text IS NOT NULL GROUP BY 1""".replace("coalesce(source, '') AS h", "'' AS h").replace("list_distinct(list_transform([source], x -> x))", "[source]"))
def merge_keep_null_key(t):
    d = t("documents").filter("doc_id % 4 = 0 OR text IS NOT NULL").select(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.md5("text")).alias("h"), "doc_id", F.array("source").alias("sources"))
    return catalog.merge_duplicates(d, "h", "doc_id", ["sources"], keep_null_key=True)


@query("""WITH o AS (SELECT lower(trim(p_brand)) AS k, min(p_name) AS name, min(p_type) AS kind FROM part GROUP BY 1) SELECT s_suppkey, name, kind FROM supplier LEFT JOIN o ON k = lower('BRAND#' || s_suppkey % 40)""")
def restore_payload(t):
    slim = t("supplier").select("s_suppkey", F.format_string(" BRAND#%d ", F.col("s_suppkey") % 40).alias("id"))
    originals = t("part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    return consolidate.restore_payload(slim, originals, "id", ["name", "kind"]).select("s_suppkey", "name", "kind")


@query("""WITH v AS (SELECT doc_id, bool_or(quality = 1) AS v FROM labels WHERE doc_id % 5 > 0 GROUP BY 1), j AS (SELECT DISTINCT doc_id // 50 AS b FROM labels WHERE doc_id % 5 > 0 AND doc_id // 50 % 2 = 0)
SELECT d.doc_id FROM documents d LEFT JOIN (SELECT * FROM v WHERE doc_id // 50 % 2 = 0) v USING (doc_id) WHERE coalesce(v, d.doc_id // 50 NOT IN (SELECT b FROM j))""")
def drop_low_value(t):
    b = F.floor(F.col("doc_id") / 50).alias("b")
    verdicts = t("labels").filter("doc_id % 5 > 0").select("doc_id", b, (F.col("quality") == 1).alias("valuable")).filter("b % 2 = 0")
    return consolidate.drop_low_value(t("documents").select("doc_id", b), verdicts, "doc_id", "b").select("doc_id")


@query("""SELECT l_orderkey AS batch_number, count(*) AS files, coalesce(sum(CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber ELSE 0 END), 0)::BIGINT AS entities, count(*) FILTER (l_returnflag = 'R') AS failed,
CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'completed' WHEN count(*) FILTER (l_returnflag = 'R') < count(*) THEN 'partial' ELSE 'failed' END AS status FROM lineitem GROUP BY 1""")
def extraction_index(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("batch_number"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber")).alias("entities"), F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("ok").alias("status"))
    return consolidate.extraction_index(rows)


# ---------------------------------------------------------------- audits


@query("""WITH a AS (SELECT lang AS name, count(*) FILTER (source = 'src1') AS hits FROM documents WHERE lang IS NOT NULL GROUP BY 1 UNION ALL SELECT 'src' || (doc_id % 7), count(*) FROM documents GROUP BY 1)
SELECT coalesce(d.name, a.name) AS name, coalesce(hits, 0) AS hits, CASE WHEN d.name IS NULL THEN 'not declared' WHEN impact = 'hit' AND coalesce(hits, 0) = 0 THEN 'declared hit without one' WHEN impact = 'no_hit' AND coalesce(hits, 0) > 0 THEN 'declared none but hit'
WHEN impact = 'no_hit' AND r = '' THEN 'no rationale' END AS problem, true AS has_primary
FROM (SELECT DISTINCT source AS name, CASE WHEN length(source) > 4 THEN 'hit' ELSE 'no_hit' END AS impact, CASE WHEN source IN ('src8', 'src9') THEN '' ELSE 'because' END AS r FROM documents WHERE source IS NOT NULL) d FULL JOIN a USING (name)""")
def audit_declared(t):
    d = t("documents")
    actual = d.filter("lang IS NOT NULL").groupBy(F.col("lang").alias("name")).agg(F.count_if(F.col("source") == "src1").alias("hits"))
    actual = actual.unionByName(d.groupBy(F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("name")).agg(F.count("*").alias("hits")))
    s = F.col("name")
    declared = d.select(F.col("source").alias("name")).dropna().distinct().select(
        "name", F.when(s == "src3", "primary").otherwise("other").alias("role"), F.when(F.length(s) > 4, "hit").otherwise("no_hit").alias("impact_status"), F.when(s.isin("src8", "src9"), " ").otherwise("because").alias("rationale")
    )
    return quality.audit_declared(declared, actual).select("name", F.coalesce("hits", F.lit(0)).alias("hits"), "problem", "has_primary")


@query("""WITH b AS (SELECT source, count(*) AS files, count(*) FILTER (lang IN ('en', 'de', 'fr')) AS listed, round_even(count(*) * 1.1 * 0.9, 0) AS least, count(*) FILTER (lang <> 'es') AS actual FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT source, files, listed, round_even(listed / files, 6) AS ratio, round_even(listed / files, 6) < 0.8 AS low, actual < least AS below_estimate FROM b""")
def scan_coverage(t):
    d = t("documents").filter("source IS NOT NULL").select("source", F.col("doc_id").cast("string").alias("path"), "lang")
    extra = d.select("source", F.concat(F.lit("gone-"), "path").alias("path"))
    listed = d.filter("lang IN ('en', 'de', 'fr')").select("source", "path")
    counts = d.groupBy("source").agg((F.count("*") * 1.1).alias("estimated"), F.count_if(F.col("lang") != "es").alias("actual"))
    return quality.scan_coverage(listed.unionByName(listed).unionByName(extra), d.select("source", "path"), "source", "path", counts=counts)


@query("""SELECT o_orderkey, n AS raw, CASE WHEN n > 0 THEN round_even(100.0 * (n - d) / n, 2) ELSE 0 END::DOUBLE AS dedup_rate, CASE WHEN d > 0 THEN round_even(100.0 * (d - m) / d, 2) ELSE 0 END::DOUBLE AS merge_rate,
CASE WHEN m > 0 THEN round_even(100.0 * (m - k) / m, 2) ELSE 0 END::DOUBLE AS filter_rate, CASE WHEN n > 0 THEN round_even(100.0 * (n - k) / n, 2) ELSE 0 END::DOUBLE AS compression_rate
FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(DISTINCT l_linenumber) AS d, count(DISTINCT l_returnflag) AS m, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN 1 END) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def stage_rates(t):
    l = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(  # noqa: E741
        F.count("*").alias("raw"), F.countDistinct("l_linenumber").alias("deduped"), F.countDistinct("l_returnflag").alias("merged"), F.max((F.col("l_returnflag") == "N").cast("long")).alias("kept")
    )
    rows = t("orders").select("o_orderkey").join(l, "o_orderkey", "left").fillna(0)
    return quality.stage_rates(rows).select("o_orderkey", "raw", "dedup_rate", "merge_rate", "filter_rate", "compression_rate")


TRACES = """tr AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'stop not allowed' WHEN l_quantity < 10 THEN 'too shallow' WHEN l_linestatus = 'O' AND l_quantity < 20 THEN 'no leaf evidence' END AS problem FROM lineitem)"""


def _traces(t):
    stop = F.when(F.col("l_returnflag") == "A", "leaf").when(F.col("l_returnflag") == "N", "external")
    evidence = F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 20), " ").otherwise("file:1")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", stop.alias("stopped_reason"), F.col("l_quantity").alias("max_depth_achieved"), evidence.alias("leaf_evidence"))
    return quality.trace_audit(rows, 10, ("leaf", "external"))


@query(f"WITH {TRACES} SELECT l_orderkey, l_linenumber, problem FROM tr")
def trace_audit(t):
    return _traces(t).select("l_orderkey", "l_linenumber", "problem")


@query(f"""WITH {TRACES}, f AS (SELECT l_orderkey AS k, count(problem) AS found FROM tr GROUP BY 1) SELECT o_orderkey AS l_orderkey, o_orderkey % 3 AS declared, coalesce(found, 0) AS found, o_orderkey % 3 = coalesce(found, 0) AS agrees FROM orders LEFT JOIN f ON k = o_orderkey""")
def trace_totals(t):
    return quality.trace_totals(_traces(t), t("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3).alias("declared")), "l_orderkey")


@query("""SELECT p_partkey, list_filter([CASE WHEN p_size % 4 > 1 THEN 'not parsed' END, CASE WHEN p_size % 3 = 0 THEN 'no method' END, CASE WHEN p_size % 5 > 0 AND length(p_name) < 12 THEN 'no keys or summary' END, CASE WHEN p_size % 7 > 0 THEN 'no consumer' END], lambda x: x IS NOT NULL) AS problems FROM part""")
def config_audit(t):
    n = F.col("p_size")
    rows = t("part").select(
        "p_partkey", F.when(n % 4 == 0, "parsed").when(n % 4 == 1, "ok").otherwise(F.lit("raw")).alias("parse_status"), F.when(n % 3 > 0, "yaml").otherwise(" ").alias("parse_method"),
        F.when(n % 5 == 0, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")).alias("extracted_keys"), F.col("p_name").alias("structure_summary"),
        F.when(n % 7 == 0, F.array(F.lit("a.py"))).alias("consumer_refs"),
    )
    return quality.config_audit(rows, 12).select("p_partkey", "problems")


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal > 6000), f AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 9900)
SELECT 'NATION_' || n AS dir, 'not scanned' AS problem FROM (SELECT n FROM e EXCEPT SELECT n FROM f) UNION ALL SELECT 'NATION_' || n, 'out of scope' FROM (SELECT n FROM f EXCEPT SELECT n FROM e)""")
def uncovered_dirs(t):
    name = lambda c: F.concat(F.lit("NATION_"), c).alias("dir")
    return quality.uncovered_dirs(t("supplier").filter("s_acctbal > 6000").select(name("s_nationkey")), t("customer").filter("c_acctbal > 9900").select(name("c_nationkey")))


@query("""SELECT DISTINCT url AS path, 'excluded path covered' AS problem FROM pages WHERE contains(url, '/de/') UNION ALL SELECT DISTINCT url, 'not scanned' FROM pages WHERE page_id % 5 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 > 0)
UNION ALL SELECT DISTINCT url, 'out of scope' FROM pages WHERE page_id % 5 > 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)""")
def scope_problems(t):
    p = t("pages").select("page_id", F.col("url").alias("path"))
    return quality.scope_problems(p.filter("page_id % 5 > 0").select("path"), p.filter("page_id % 5 = 0").select("path"), p.select("path"), ("*/de/*",))


@query("""SELECT event_id, 'check ' || k AS check_type, 'i' AS check_info, ['a' || event_id, 'b'] AS logs FROM events, (VALUES (0), (1), (2)) v(k) WHERE (event_id + k) % 4 > 1""")
def failed_checks(t):
    k = F.col("event_id")
    one = lambda i: F.struct(
        F.lit(f"check {i}").alias("check_type"), F.when((k + i) % 4 == 0, "PASSED").when((k + i) % 4 == 1, "Success").when((k + i) % 4 == 2, "fail").alias("check_result"),
        F.lit("i").alias("check_info"), F.concat(F.lit("a"), k.cast("string"), F.lit(", b;")).alias("check_log"),
    )
    return quality.failed_checks(t("events").select("event_id", F.array(one(0), one(1), one(2)).alias("checks")), "event_id")


@query("""SELECT o_orderkey AS batch_number, r IS NULL AS complete, r AS reason FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'status' WHEN o_orderkey % 5 = 0 THEN 'no output' WHEN o_orderkey % 5 = 1 THEN 'output does not parse' WHEN o_orderkey % 5 = 2 THEN 'time format' END AS r FROM orders)""")
def completion_check(t):
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "O", "processing").otherwise("Completed")
    at = F.when(k % 5 == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    text = F.when(k % 5 == 1, '{"a": [').otherwise(F.concat(F.lit('{"a": '), k.cast("string"), F.lit("}")))
    return quality.completion_check(t("orders").select(k.alias("batch_number"), state.alias("status"), at.alias("completed_at")), t("orders").filter(k % 5 > 0).select(k.alias("batch_number"), text.alias("text")))


@query("""SELECT user_id AS session, count(*) AS lines, bool_or(event_type = 'purchase') AS done FROM events WHERE event_id >= user_id * 50 GROUP BY 1""")
def since_offset(t):
    log = t("events").select(F.col("user_id").alias("session"), F.col("event_id").alias("offset"), F.concat(F.lit("event "), "event_type").alias("line"))
    sessions = t("events").select(F.col("user_id").alias("session")).distinct().withColumn("offset", F.col("session") * 50)
    return tracking.since_offset(log, sessions, "event purchase")


@query("""WITH m AS (SELECT 'REQ-' || item_id AS req_id FROM benchmark), c AS (SELECT count(DISTINCT req_id) AS n, count(DISTINCT req_id) FILTER (req_id IN (SELECT 'REQ-' || (doc_id % 60) FROM documents WHERE doc_id % 60 % 3 > 0)) AS k FROM m)
SELECT n AS requirements, k AS covered, round_even(100.0 * k / n, 2)::DOUBLE AS percent FROM c""")
def coverage_percent(t):
    req = t("benchmark").select(F.concat(F.lit("REQ-"), F.col("item_id").cast("string")).alias("req_id"))
    tasks = t("documents").filter("doc_id % 60 % 3 > 0").select(F.col("doc_id").alias("task_id"), F.format_string("for REQ-%d.", F.col("doc_id") % 60).alias("text"))
    out = relations.coverage_percent(relations.coverage_matrix(req, tasks, r"(REQ-\d+)"))
    return out.withColumn("covered", F.col("covered").cast("long"))


@query("""SELECT 'src/' || p_brand || '/m' || p_partkey || '.py' AS path, CASE p_partkey % 4 WHEN 0 THEN 'src/' || p_brand || '/test_m' || p_partkey || '.py' WHEN 1 THEN 'src/' || p_brand || '/tests/m' || p_partkey || '_test.py' ELSE 'tests/m' || p_partkey || 'Test.py' END AS test_path FROM part WHERE p_partkey % 4 < 3""")
def map_tests(t):
    k = F.col("p_partkey")
    name = lambda pattern: F.format_string(pattern, "p_brand", k)
    path = F.when(k % 4 == 0, name("src/%s/test_m%d.py")).when(k % 4 == 1, name("src/%s/tests/m%d_test.py")).when(k % 4 == 2, F.format_string("tests/m%dTest.py", k)).otherwise(name("src/%s/other_m%d.py"))
    return relations.map_tests(t("part").select(name("src/%s/m%d.py").alias("path")), t("part").select(path.alias("path")))


@query("""WITH l AS (SELECT l_orderkey AS path, l_linenumber AS line, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS h, max(CASE WHEN l_quantity > 25 THEN 2 ELSE 0 END) AS b, max(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2)
SELECT path, sum(h)::BIGINT AS covered, count(*) AS total, round_even(100.0 * sum(k) / nullif(sum(b), 0), 2)::DOUBLE AS branch_percent FROM l GROUP BY path""")
def branch_coverage(t):
    return _covered(t).select("path", "covered", "total", "branch_percent")


def _covered(t):
    q = F.col("l_quantity")
    lines = t("lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "N").cast("int").alias("hits"), F.when(q > 25, 2).otherwise(0).alias("b"), F.when(q > 40, 1).otherwise(0).alias("k")
    )
    return quality.incremental_coverage(lines, t("orders").select(F.col("o_orderkey").alias("path")), branches=("b", "k"))


@query("""WITH l AS (SELECT l_orderkey AS path, l_linenumber AS line, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS h FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2)
SELECT count(DISTINCT path) AS files, sum(h)::BIGINT AS covered, count(*) AS total, round_even(100.0 * sum(h) / count(*), 2)::DOUBLE AS percent, round_even(100.0 * sum(h) / count(*), 2) >= 80 AS passed FROM l""")
def overall_coverage(t):
    return quality.overall_coverage(_covered(t))


# ---------------------------------------------------------------- text helpers over whole tables


@query(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '([A-Z][a-z]{2,5})', 1))) AS ids FROM documents WHERE text IS NOT NULL""")
def mentioned_ids(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", X.mentioned_ids(F.col("text"), r"([A-Z][a-z]{2,5})").alias("ids"))


@query(rf"""WITH {MD_TURNS}, u AS (SELECT conv_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body FROM m WHERE role = 'assistant' AND turn = 1) SELECT conv_id, body, body IS NOT NULL AS has_it FROM (SELECT DISTINCT conv_id FROM m) LEFT JOIN u USING (conv_id)""")
def section_bodies(t):
    return _conversation_md(t).select("conv_id", F.md5(X.section_body(F.col("text"), "assistant 1")).alias("body"), X.has_heading(F.col("text"), "assistant 1").alias("has_it"))


@query("""SELECT doc_id, md5(translate(regexp_replace(text, '[*_`]+', '', 'g'), '：，（）；！？', ':,();!?')) AS plain FROM documents WHERE text IS NOT NULL""")
def plain_markup(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.md5(X.plain_markup(F.col("text"))).alias("plain"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1000 ELSE n_chars * 5 END AS scan, least(1200 + 2 * CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END, 16000) + CASE WHEN lang = 'de' THEN 800 ELSE 0 END AS detail FROM documents""")
def estimated_tokens(t):
    lines = F.when(F.col("doc_id") % 7 > 0, F.col("n_chars"))
    return t("documents").select("doc_id", X.estimated_tokens(lines).alias("scan"), X.estimated_tokens(lines, F.col("lang") != "de", "detail").alias("detail"))


@query("""SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate::DATE::VARCHAR ELSE l_returnflag END, '; ' ORDER BY l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate::DATE::VARCHAR ELSE l_returnflag END) FILTER (l_linenumber % 3 < 2) AS problem, string_agg(l_partkey::VARCHAR, chr(10) ORDER BY l_linenumber, l_partkey) AS code FROM lineitem GROUP BY 1""")
def problem_and_code(t):
    n = F.col("l_linenumber")
    info = F.when(n % 3 == 0, F.create_map(F.lit("title"), F.lit(""), F.lit("text"), F.date_format("l_shipdate", "yyyy-MM-dd"))).when(n % 3 == 1, F.create_map(F.lit("title"), "l_returnflag")).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.to_json(info).alias("i")))).alias("a"))
    infos = F.transform("a", lambda x: F.from_json(x["i"], "map<string,string>"))
    blocks = F.map_from_entries(F.array(F.struct(F.lit("a.py"), F.transform("a", lambda x: x["l_partkey"].cast("string")))))
    out = X.problem_text(infos, ("title", "text"))
    return rows.select("l_orderkey", F.nullif(out, F.lit("")).alias("problem"), X.joined_code(blocks).alias("code"))


@query("""WITH s AS (SELECT event_id, floor(value * value)::BIGINT AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'm' END AS took FROM s""")
def human_durations(t):
    return t("events").select("event_id", X.human_duration(F.col("value") * F.col("value")).alias("took"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey >= 100 THEN 'API_' || o_orderkey END AS id FROM orders""")
def ids_from_filenames(t):
    mark = F.when(F.col("o_orderkey") % 2 == 0, "docs/api-").otherwise("a/b_c/API_")
    return t("orders").select("o_orderkey", X.id_from_filename(F.concat(mark, F.col("o_orderkey").cast("string"), F.lit("-name.md"))).alias("id"))


@query("""WITH x AS (SELECT l_orderkey, 'f' || l_partkey % 3 AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r,
CASE WHEN l_linenumber % 2 = 0 THEN l_partkey || chr(10) || l_suppkey WHEN l_returnflag = 'A' THEN 'b' || l_partkey END AS c FROM lineitem),
p AS (SELECT l_orderkey, path, min(r) AS f, arg_max(c, r) AS c FROM x WHERE c IS NOT NULL GROUP BY ALL), o AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT l_orderkey, string_agg(c, chr(10) ORDER BY f) AS reference FROM o LEFT JOIN p USING (l_orderkey) GROUP BY 1""")
def reference_text(t):
    k, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    checker = F.when(F.col("l_linenumber") % 2 == 0, F.array(k, s)).otherwise(F.array().cast("array<string>"))
    answer = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string")).alias("filepath"), F.col("l_returnflag").alias("fix_type"),
        checker.alias("checker"), F.concat(F.lit("b"), k).alias("code_block"),
    )
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(answer)).alias("a"))
    return rows.select("l_orderkey", X.reference_text(F.col("a")).alias("reference"))


@query("""SELECT doc_id, coalesce(lang, '') AS lang, n_chars::VARCHAR AS second_size, 'name ' || doc_id AS name, 2::INTEGER AS people, 'flat: pair' AS flat FROM documents""")
def nested_front_matter(t):
    row = F.format_string("---\nflat: \"flat: pair\"\nmeta:\n  lang: %s\n  sizes:\n  - 1\n  - %d\n# note\npeople:\n  - name: name %d\n    role: author\n  - name: other\n---\n%s", F.coalesce("lang", F.lit("")), "n_chars", "doc_id", F.coalesce(F.substring("text", 1, 100), F.lit("")))
    rows = chunking.nested_front_matter(t("documents").select("doc_id", row.alias("t")), "doc_id", "t")
    at = lambda path, kind="string": F.try_variant_get("front", path, kind)
    people = F.size(at("$.people", "array<variant>"))
    return rows.select("doc_id", at("$.meta.lang").alias("lang"), at("$.meta.sizes[1]").alias("second_size"), at("$.people[0].name").alias("name"), people.alias("people"), at("$.flat").alias("flat"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'answered' WHEN event_type IN ('view', 'click') THEN 'looking' ELSE 'unknown' END AS label, CASE WHEN event_id % 3 = 0 THEN 0.9 WHEN event_type IN ('view', 'click') THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence,
CASE WHEN event_id % 3 = 0 THEN 'response' WHEN event_type IN ('view', 'click') THEN 'r' ELSE 'none' END AS basis FROM events""")
def classify_with_responses(t):
    e = t("events").select("event_id", "event_type")
    said = e.filter("event_id % 3 < 2").select("event_id", F.when(F.col("event_id") % 3 == 0, "answered").alias("label"), F.lit(0.9).alias("confidence"))
    said = said.unionByName(e.filter("event_id % 3 = 0").select("event_id", F.lit("less sure").alias("label"), F.lit(0.4).alias("confidence")))
    return rules.classify_with_responses(e, said, "event_id", [("r", "event_type", "view|click", "looking", 0.6)]).select("event_id", "label", "confidence", "basis")


@query("""WITH n AS (SELECT source, list_extract(['php', 'r', 'css', 'matlab', 'xml', 'kotlin'], (doc_id % 6 + 1)::INTEGER) AS language, count(*) AS files FROM documents GROUP BY ALL),
s AS (SELECT *, files * CASE language WHEN 'php' THEN 0.9 WHEN 'r' THEN 0.8 WHEN 'css' THEN 0.4 WHEN 'matlab' THEN 0.8 WHEN 'xml' THEN 0.3 ELSE 1.0 END::DOUBLE AS score FROM n) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, language) = 1""")
def language_weights(t):
    names = F.array(*map(F.lit, ("php", "r", "css", "matlab", "xml", "kotlin")))
    return rules.language_vote(t("documents").select("source", F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("language")), "source", "language")


# ---------------------------------------------------------------- streams over the event table


def _stream(t, name, files=5, by=None):
    """The whole table dealt into files, one file a micro-batch: in no order, or in ranges of ``by``, the first range first."""
    from tracewell.sources.shared import new_path, write_shared

    batch = t(name)
    spark, path = batch.sparkSession, new_path(batch.sparkSession, "stream-in")
    rows = batch.repartition(files) if by is None else batch.repartitionByRange(files, by)
    rows = write_shared(rows.withColumn("_file", F.spark_partition_id()), "stream-files")
    for i in range(files):  # one after the other, so that files are read in this order
        rows.filter(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _collect_stream(df, mode):
    """Run a stream to its end into a shared Parquet table, with the micro-batch number of each row."""
    from tracewell.sources.shared import new_path

    spark = df.sparkSession
    path, checkpoint = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def each(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    q = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", path).parquet(path)


@query(f"""SELECT {STATUS} AS status, count(*) AS items FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, {STATUS} DESC) = 1) GROUP BY 1""")
def progress_stream(t):
    from tracewell.streaming import jobs

    e = _stream(t, "events")
    deltas = jobs.progress_stream(e.select(F.col("user_id").alias("item_id"), _status().alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")))
    return _collect_stream(deltas, "append").groupBy("status").agg(F.sum("delta").alias("items")).filter("items > 0")


@query(ORACLE_SQL["attempts"].replace("SELECT user_id, count(*) FILTER (NOT p", "SELECT user_id AS key, count(*) FILTER (NOT p"))
def retry_stream(t):
    from pyspark.sql import Window

    from tracewell.streaming import jobs

    v = _stream(t, "events").filter("event_type IN ('purchase', 'error')")
    v = v.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("passed"))
    out = _collect_stream(jobs.retry_controller(v, key_type="long"), "update")
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("batch"), F.desc("seq")))
    return out.withColumn("_r", last).filter("_r = 1").select("key", "attempts", "outcome")


# at the end of the stream the watermark is ten seconds before the last event: what is due by then has fired
SESSION_ENDS = """WITH e AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS ms, bool_or(event_type = 'purchase' AND value > 180) AS d FROM events GROUP BY 1, 2), w AS (SELECT epoch_us(max(ts)) // 1000 - 10000 AS w FROM events),
x AS (SELECT session, ms, d, min(ms) OVER (PARTITION BY session) AS a, lag(ms) OVER (PARTITION BY session ORDER BY ms) AS p FROM e, w WHERE ms <= w),
y AS (SELECT *, count(*) FILTER (ms > p + 172800000 OR ms > a + 1728000000) OVER (PARTITION BY session ORDER BY ms) AS cut FROM x),
l AS (SELECT session, min(a) AS a, max(ms) AS z, min(ms) FILTER (d) AS m FROM y WHERE cut = 0 GROUP BY 1)
SELECT session, CASE WHEN m IS NOT NULL THEN 'done' WHEN a + 1728000000 <= z + 172800000 THEN 'timeout' ELSE 'stale' END AS state, coalesce(m, z) AS at_ms FROM l, w WHERE m IS NOT NULL OR least(a + 1728000000, z + 172800000) <= w"""


@query(SESSION_ENDS)
def session_ends(t):
    done = (F.col("event_type") == "purchase") & (F.col("value") > 180)
    e = t("events").withColumnRenamed("user_id", "session")
    newest = e.agg((F.unix_millis(F.max("ts").cast("timestamp")) - 10_000).alias("_mark"))
    rows = e.join(F.broadcast(newest), F.lit(True))  # one row
    return tracking.session_ends(rows.withColumn("session", F.struct("session", "_mark")), "session", "ts", done, F.col("session._mark"), 172_800, 1_728_000).withColumn("session", F.col("session.session"))


@query(SESSION_ENDS)
def stale_session_stream(t):
    from tracewell.streaming import jobs

    done = (F.col("event_type") == "purchase") & (F.col("value") > 180)
    e = _stream(t, "events", by="ts").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), done.alias("done"))
    return _collect_stream(jobs.stale_session_stream(e, 172_800, 1_728_000, key_type="long"), "append").drop("batch")


@query("""WITH m AS (SELECT *, CASE event_type WHEN 'click' THEN 'fast' WHEN 'view' THEN 'full' END AS mode FROM events), f AS (SELECT user_id, event_type AS s, min(epoch_us(ts)) AS m FROM events WHERE event_type <> 'error' GROUP BY ALL),
l AS (SELECT user_id, arg_max(event_type, {'a': epoch_us(ts), 'b': event_type}) AS current_stage, arg_max(mode, {'a': epoch_us(ts), 'b': event_type}) FILTER (mode IS NOT NULL) AS flow_mode FROM m GROUP BY 1)
SELECT user_id AS key, list(s ORDER BY m, s) AS completed_stages, any_value(current_stage) AS current_stage, any_value(flow_mode) AS flow_mode FROM f JOIN l USING (user_id) GROUP BY user_id""")
def workflow_stream(t):
    from tracewell.streaming import jobs

    e = _stream(t, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_type") != "error").alias("completed"),
        F.when(F.col("event_type") == "click", "fast").when(F.col("event_type") == "view", "full").alias("flow_mode"),
    )
    out = _collect_stream(jobs.workflow_state(e, key_type="long"), "update")
    return out.groupBy("key").agg(F.max_by(F.struct("completed_stages", "current_stage", "flow_mode"), "batch").alias("s")).select("key", "s.*")


# rows older than the latest event of all batches before, less the delay: with files in ranges of time there are none, and every event is counted once
@query("SELECT event_type, count(*) AS on_time, 0::BIGINT AS late FROM events GROUP BY 1")
def late_route(t):
    from tracewell.sources.shared import new_path
    from tracewell.streaming import jobs

    spark = t("events").sparkSession
    on_time, late = new_path(spark, "on-time"), new_path(spark, "late")
    events = _stream(t, "events", by="ts").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    jobs.route_late(events, on_time, late, "10 seconds", new_path(spark, "stream-state"))
    read = lambda path: spark.read.schema("event_type string, ts timestamp, batch long").option("basePath", path).parquet(path)
    both = read(on_time).withColumn("_late", F.lit(0)).unionByName(read(late).withColumn("_late", F.lit(1)))
    return both.groupBy("event_type").agg(F.count_if(F.col("_late") == 0).alias("on_time"), F.count_if(F.col("_late") == 1).alias("late"))


@query(f"""SELECT event_id % 500 AS item_id, {STATUS} AS status FROM events WHERE {STATUS} <> 'unknown' QUALIFY row_number() OVER (PARTITION BY event_id % 500 ORDER BY epoch_us(ts) DESC, {STATUS} DESC) = 1""")
def status_stream(t):
    return _status_run(t)[0]


def _status_run(t):
    from tracewell.sources.shared import new_path
    from tracewell.streaming import jobs

    spark = t("events").sparkSession
    updates = _stream(t, "events").select("event_id", (F.col("event_id") % 500).alias("item_id"), _status().alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    items = t("events").select((F.col("event_id") % 500).alias("item_id")).distinct()
    keyed = jobs.KeyedTable(spark, new_path(spark, "status-table"), ["item_id"], ["ts", "status"])
    rejects = new_path(spark, "status-rejects")
    jobs.status_stream(updates, items, keyed, lambda bad: bad.write.mode("append").parquet(rejects), new_path(spark, "stream-state"), ("pending", "processing", "completed", "failed"))
    return keyed.read().select("item_id", "status"), spark.read.parquet(rejects)


@query(f"SELECT event_id, 'unknown status' AS error FROM events WHERE {STATUS} = 'unknown'")
def status_rejects(t):
    return _status_run(t)[1].select("event_id", "error")


@query("""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(text) <= 512 THEN 0 ELSE 448 * ceil((length(text) - 512) / 448.0)::BIGINT END, 448)) AS s FROM documents WHERE length(text) > 0)
SELECT DISTINCT sha256(substr(text, s + 1, 512)) AS hash FROM c WHERE length(substr(text, s + 1, 512)) >= 40""")
def index_stream(t):
    from tracewell.sources.shared import new_path
    from tracewell.streaming import jobs

    spark = t("documents").sparkSession
    store = io.VectorStore(spark, new_path(spark, "store"), "hashing", "plain")
    checkpoint, documents = new_path(spark, "stream-state"), _stream(t, "documents").select("doc_id", "text")
    for _ in range(2):  # a second run on the same files finds nothing new
        jobs.index_stream(documents, store, checkpoint)
    return store.read().select("hash")


@query(LOGGED)
def run_log_stream(t):
    from tracewell.sources.shared import new_path
    from tracewell.streaming import jobs

    spark = t("events").sparkSession
    path, checkpoint, events = new_path(spark, "run-log"), new_path(spark, "stream-state"), _log_rows(_stream(t, "events"))
    for _ in range(2):  # a second run on the same files writes nothing
        jobs.run_log_stream(events, path, checkpoint)
    return spark.read.schema(io.RUN_LOG).parquet(path).select("detail", "session", "action", "status")


# the stages signup, view, click, purchase in this order; purchase asks for a verdict of a trusted source, and signup must be done before it
@query("""WITH f AS (SELECT user_id, arg_max(event_type, {'a': epoch_us(ts), 'b': event_type}) AS stage, bool_or(event_type = 'signup') AS signed FROM events GROUP BY 1),
v AS (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_id, event_id) AS e FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id AS key, stage, CASE WHEN stage = 'error' THEN 'unknown stage' WHEN stage <> 'signup' AND NOT signed THEN 'earlier stage open' WHEN stage = 'purchase' AND e % 2 = 1 THEN 'untrusted verdict'
WHEN stage = 'purchase' AND value <= 50 THEN 'failed' ELSE 'advance' END AS decision FROM f LEFT JOIN v USING (user_id)""")
def stage_gate_stream(t):
    from tracewell.sources.shared import new_path
    from tracewell.streaming import jobs

    events = t("events")
    spark = events.sparkSession
    order = F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_type")
    states = events.groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", order).alias("current_stage"), F.collect_set("event_type").alias("completed_stages"))
    source, out = new_path(spark, "stage-states"), new_path(spark, "stage-decisions")
    states.write.parquet(source)
    trusted = F.when(F.col("event_id") % 2 == 0, "judge").otherwise("author")
    verdicts = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), (F.col("value") > 50).alias("passed"), trusted.alias("source"))
    flow = [("signup", 1, False, True, None), ("view", 2, False, False, None), ("click", 3, False, False, None), ("purchase", 4, True, False, "judge")]
    workflow = spark.createDataFrame(flow, "stage string, pos int, blocking boolean, required boolean, trusted_source string")
    stream = spark.readStream.schema(states.schema).parquet(source)
    jobs.stage_gate_stream(stream, verdicts, workflow, lambda rows: rows.write.mode("append").parquet(out), new_path(spark, "stream-state"))
    return spark.read.schema("key long, stage string, decision string").parquet(out)
