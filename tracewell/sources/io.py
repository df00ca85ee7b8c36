"""Sources and sinks: documents, JSON envelopes, relations, graphs, vector stores and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_documents(spark: SparkSession, root: str, exts: tuple[str, ...] = (".md",)) -> DataFrame:
    """(path, stem, ext, text) of the files below ``root`` with one of the extensions, in any case.

    ``path`` is relative: what follows the root's own path, whole and as it is written, whatever its names look like. The extension begins at the last
    dot of the name and is given in lower case; a name whose only dot leads it has none. Only files that match are read.
    """
    home = spark._jvm.org.apache.hadoop.fs.Path(root)
    home = home.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(home).toString().rstrip("/")
    any_case = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else f"\\{c}" if c in "*?[]{},\\" else c for c in e) for e in exts)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{{{any_case}}}")
    files = files.load(root).select("path", F.col("content").cast("string").alias("text"))
    # a root given without its store's name is still the end of what stands before the relative path
    relative = F.substring("path", F.lit(len(home) + 2), F.length("path"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))
    found = files.select(relative.alias("path"), F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1").alias("stem"), ext.alias("ext"), "text")
    return found.filter(F.col("ext").isin(*[e.lower() for e in exts]))


def scan_code_files(files: DataFrame, path: str, exts: tuple[str, ...], skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``files`` with a code extension and no skipped directory above them."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    inside = F.arrays_overlap(F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/"), F.array(*map(F.lit, skip_dirs or ("",))))
    return files.filter(ext.isin(*exts) & (~inside if skip_dirs else F.lit(True)))


def scan_instances(files: DataFrame, types: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``type_id``: of the nearest ancestor directory that names a type, local name before type id.

    ``types`` (type_id, local_name, file_pattern) is a schema table, small by nature; a null pattern takes any file.
    Files of no type are left out.
    """
    from pyspark.sql import Window

    dirs = files.select("*", F.posexplode(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))).alias("_d", "_dir"))
    names = types.select("type_id", "file_pattern", F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col("local_name").alias("n")), F.struct(F.lit(1).alias("p"), F.col("type_id").alias("n")))).alias("_x"))
    names = names.select("type_id", "file_pattern", F.col("_x.p").alias("_p"), F.col("_x.n").alias("_dir")).filter("_dir IS NOT NULL")
    hits = dirs.join(names, "_dir").filter(F.col("file_pattern").isNull() | F.regexp_like(F.regexp_extract(path, r"([^/]*)$", 1), F.col("file_pattern")))
    row = F.row_number().over(Window.partitionBy(path).orderBy(F.desc("_d"), "_p", "type_id"))
    return hits.withColumn("_r", row).filter("_r = 1").drop("_r", "_d", "_p", "_dir", "file_pattern")


def parse_records(texts: DataFrame, schema: str, envelope_keys: tuple[str, ...] = ("interfaces", "files", "items"), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON texts that are an array or an object with one of the keys; other columns pass through."""
    arr = f"array<struct<{schema}>>"
    parsed = F.coalesce(
        F.when(F.col(text).rlike(r"^\s*\["), F.from_json(text, arr)), *[F.from_json(F.get_json_object(text, f"$.{k}"), arr) for k in envelope_keys]
    )
    valid = F.try_parse_json(text).isNotNull()
    both = texts.withColumn("_records", F.when(valid, parsed))
    rest = [c for c in texts.columns if c != text]
    good = both.filter("_records IS NOT NULL").select(*rest, F.posexplode("_records").alias("pos", "_r")).select(*rest, "pos", "_r.*")
    return good, both.filter("_records IS NULL").drop("_records")


def read_records(spark: SparkSession, path: str, schema: str, **how) -> tuple[DataFrame, DataFrame]:
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_records(texts, schema, **how)


ENTITY = "entity_id string, title string, index int, interfaces array<string>"


def parse_lineage(texts: DataFrame, text: str = "text") -> DataFrame:
    """(entity_id, title, interfaces) from lineage in both shapes: ``{"entities": [...]}`` or a map of id to object."""
    as_list = F.from_json(F.get_json_object(text, "$.entities"), f"array<struct<{ENTITY}>>")
    as_map = F.from_json(text, f"map<string,struct<{ENTITY}>>")
    entries = F.transform(F.map_entries(as_map), lambda e: F.struct(F.coalesce(e["value"]["entity_id"], e["key"]).alias("entity_id"), e["value"]["title"].alias("title"), e["value"]["interfaces"].alias("interfaces")))
    listed = F.transform(as_list, lambda e: F.struct(e["entity_id"].alias("entity_id"), e["title"].alias("title"), e["interfaces"].alias("interfaces")))
    rows = texts.select(F.explode(F.coalesce(listed, entries)).alias("e"))
    return rows.select("e.*").filter("entity_id IS NOT NULL")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) edges of relation arrays ``[{source, targets[]}]``."""
    texts = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    rows = texts.select(F.explode(F.from_json("text", "array<struct<source:string,targets:array<string>>>")).alias("r"))
    return rows.select("r.source", F.explode("r.targets").alias("target"))


def write_relations(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Full rebuild; the commit protocol shows all of the new output or none."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link JSON with ``links`` or ``edges``."""
    node = "array<struct<id:string,label:string,source_file:string,source_location:string,file_type:string>>"
    edge = "array<struct<source:string,target:string,relation:string,confidence:string>>"
    doc = spark.read.text(path, wholetext=True)
    nodes = doc.select(F.inline(F.from_json(F.get_json_object("value", "$.nodes"), node)))
    links = F.coalesce(*[F.from_json(F.get_json_object("value", p), edge) for p in ("$.links", "$.edges")])
    edges = doc.select(F.inline(links)).withColumnsRenamed({"source": "src", "target": "dst"})
    return nodes, edges


RUN_LOG = T.StructType([T.StructField(c, T.StringType()) for c in ("time", "session", "stage", "action", "status", "elapsed", "message", "detail")])


def append_run_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


class VectorStore:
    """Vectors by content hash, valid for one model and mode; other models' files are pruned away."""

    def __init__(self, spark: SparkSession, path: str, model: str, mode: str):
        self.spark, self.path, self.model, self.mode = spark, path, model, mode
        self.schema = "hash string, embedding array<float>, model string, mode string"

    def read(self) -> DataFrame:
        own = self.spark.read.schema(self.schema).option("basePath", self.path)
        try:
            rows = own.parquet(self.path)
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], self.schema)
        return rows.filter((F.col("model") == self.model) & (F.col("mode") == self.mode)).select("hash", "embedding")

    def append(self, vectors: DataFrame) -> None:
        rows = vectors.select("hash", "embedding", F.lit(self.model).alias("model"), F.lit(self.mode).alias("mode"))
        rows.write.mode("append").partitionBy("model", "mode").parquet(self.path)


def load_completed_batches(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents named by batches whose status is completed; ``index`` (batch_number, status, entity_files)."""
    named = index.filter(F.lower("status") == "completed").select("batch_number", F.explode("entity_files").alias("path"))
    return named.join(documents, "path")
