"""The corpus pipeline: toxicity, near duplicates, secrets, mixing and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.mixing import mix_sources
from tracewell.llm.ngram_join import drop_near_copies
from tracewell.llm.packing import pack_documents
from tracewell.llm.secrets import redact_secrets
from tracewell.llm.toxicity import THRESHOLD, fold_model, score_toxicity
from tracewell.sources.shared import write_shared
from tracewell.sources.tables import table

#: What mixing adds to a row; columns of ``docs`` with these names are kept aside.
MIXED = ("size", "source_size", "target", "repeats", "part")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is at least the threshold go."""
    scored = score_toxicity(docs, fold_model(spark, sf_dir, docs), out="_toxicity")
    return scored.filter(F.col("_toxicity.score") < THRESHOLD).drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates its first row, by id and then by a hash of the text, stays; rows without an id or words stay.

    Rows are told apart by id and text, so distinct texts under one id are separate documents. Of equal rows one stays.
    """
    return drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark; documents without one stay as they are."""
    marked = redact_secrets(docs.withColumn("_before", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", n_chars).drop("_before")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix repeats it; the one at a source's cut is rounded to whole repetitions.

    The plan is applied row by row, so rows that share an id, or have none, are each repeated as planned.
    """
    planned = mix_sources(docs.select(*docs.columns, *[F.col(c).alias(f"_own_{c}") for c in docs.columns if c in MIXED]), keep=True)
    # a size is only asked for where a part of a document is in the mix
    times = F.col("repeats") + F.when(F.col("part") == 0, 0).when(2 * F.col("part") >= F.col("size"), 1).otherwise(0)
    rows = planned.withColumn("_times", times).filter("_times > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return rows.select(*[F.col(f"_own_{c}").alias(c) if c in MIXED else F.col(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: its document, its ids' digest and its place in a sequence.

    The workers have run other stages and hold their memory too, so few tokenized cuts are kept, and none after a task.
    """
    return pack_documents(docs, keep=150_000, warm=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact),
    ("mixing", mix),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None
