"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.shared import drop_path, new_path, write_shared


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, merge: bool = False) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and the label of its own
    label, so a path of length n needs about log n rounds and a star two. Neither links nor
    labels leave the executors but for small tables that Spark broadcasts; a round ends with a written table and one existence test. With ``merge`` no join is
    a broadcast, which would pass through the driver in each round.
    Null endpoints and self links are dropped; repeated links count once.
    """
    spark = edges.sparkSession
    side = lambda df: df.hint("merge") if merge else df
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = write_shared(both, "links")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    labels = labels.select("node", F.least("node", "m").alias("component"), F.lit(True).alias("changed"))
    old = None
    for _ in range(max_rounds):
        path = new_path(spark, "labels")
        labels.write.parquet(path)
        labels = spark.read.schema(labels.schema).parquet(path)
        if old is not None:
            drop_path(spark, old)
        old = path
        if labels.filter("changed").isEmpty():
            break
        now = labels.select("node", "component")
        near = (
            both.join(side(now.withColumnRenamed("node", "v")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        jump = now.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = (
            now.join(side(near), "node")
            .join(side(jump), "component", "left")
            .select("node", "component", F.least("component", "near", "up").alias("new"))
            .select("node", F.col("new").alias("component"), (F.col("new") < F.col("component")).alias("changed"))
        )
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return labels.select("node", "component")
