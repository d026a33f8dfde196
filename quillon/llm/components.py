"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names in spark.checkpoint.dir.

    Where none is named, one process (a local master, as in tests) gets a temporary folder; a cluster gets an error,
    since its machines share no such folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: integers); root is the least node of its component.

    Alternates two steps until the links no longer change: every node hands its larger neighbours its least
    neighbour, then every node hands its smaller neighbours their least. Each step is an aggregate with partial
    sums and an equi-join, whose hot keys AQE can split, so a star of any size is no one task's. The number of
    rounds grows with the logarithm of the longest chain. Each round is checkpointed to the shared folder.
    Self-links, repeated links and nulls are ignored; an empty table has no nodes.
    """
    ensure_checkpoint_dir(links.sparkSession)
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        # Large step: among all neighbours and itself, the least; given to the larger neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small step: each node's smaller neighbours, and itself, go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        now = small.where("a <> b").distinct().checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
