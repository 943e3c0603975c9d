"""Connected components of small graphs by least labels: edges in, (node, root) out."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the one that the session names. Only a session on one machine that names none gets its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(named)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges: columns a, b. Each round every node takes the least label around it and follows its label's own."""
    with_checkpoints(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")).checkpoint()
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = labels.join(seen, "node").select("node", F.least("root", "near").alias("root"))
        jumped = moved.join(moved.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce(F.least("root", "further"), "root").alias("root")).checkpoint()
        same = jumped.join(labels, ["node", "root"], "left_anti").isEmpty()
        labels = jumped
        if same:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
