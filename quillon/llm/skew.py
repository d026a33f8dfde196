"""Rows of one key together, and a join whose left side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is split beyond this many rows, and beyond this share of all rows; so at most 1 / SHARE keys are.
ROWS, SHARE = 500, 1e-5


def join_unique(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """``left`` joined to ``right``, which has one row per ``key`` (not null), inner.

    Keys with many rows are dealt into parts by a hash of ``by``, and their one row of ``right`` is given to each part.
    What is broadcast is one row per split key, at most 100,000 of two integers, whatever the size of the input.
    ``left`` is read three times, so it is best a checkpoint. Neither side may have columns named __parts or __part.
    """
    part = max(ROWS, int(left.count() * SHARE))
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    hot = F.broadcast(counts.where(F.col("n") > part).select(key, F.ceil(F.col("n") / part).alias("__parts")))
    dealt = left.join(hot, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0).cast("long"))).drop("__parts")
    given = right.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1).cast("long")) - 1))).drop("__parts")
    return dealt.join(given, [key, "__part"]).drop("__part")


def together(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with rows of equal keys in one partition, by a hash of the keys.

    ``repartition`` by the plain columns is left out by the optimizer where a join below deals by the same columns; if
    that join becomes a broadcast join while it runs, its shuffle may be read without regard to keys. No operator
    below deals by this hash, so the exchange always stays.
    """
    return df.repartition(F.xxhash64(*keys))
