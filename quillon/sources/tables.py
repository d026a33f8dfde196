"""Readers of Parquet tables by directory, with the types that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; columns without a time zone are read as UTC once, here."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def spread(df: DataFrame) -> DataFrame:
    """A plain scan that makes fewer tasks than there are cores, dealt out evenly; any larger one as it is.

    Worth its shuffle only before costly expressions over a small file, which Spark cannot split. For scans only: of
    a plan with a shuffle, counting the partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
