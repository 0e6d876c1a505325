"""Components of a graph given as links, by hooking to least neighbours and pointer jumping."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share (``spark.checkpoint.dir``).

    Where that is unset, a local master (one machine, as in tests) gets a folder of its own; any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='voxels-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that executors share and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def graph_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable, for every node of the links (a, b).

    Every round each node looks at the labels of its neighbours and at the label of its label, so chains
    shrink by half.  Raises if labels still change after ``max_rounds``.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    labels = written(labels, "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = written(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"), "labels")
        changed = new.where("component <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
