"""The ledger of a pipeline's stages: rows in and out, seconds and outcome of each attempt."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, stage string, attempt int, started_at timestamp, seconds double, rows_in long, rows_out long, outcome string, error string"


class StageLedger:
    """An append-only table of attempts in a shared folder; a stage's last attempt is the one that counts."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run

    def attempts(self) -> DataFrame:
        """All attempts of all runs; none before the first."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def stages(self) -> DataFrame:
        """The last attempt of each stage, so that a stage that was tried again counts once."""
        return self.attempts().groupBy("run", "stage").agg(F.max_by(F.struct("attempt", "started_at", "seconds", "rows_in", "rows_out", "outcome", "error"), "attempt").alias("r")).select("run", "stage", "r.*")

    def record(self, stage: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
        """Writes what ``make`` makes of ``rows`` to the folder ``out``, notes the attempt, and returns what was written.

        Rows out are counted by the write itself. A stage that fails is noted as such and its error raised again; its
        next attempt writes over what it left. What a lost task's retry writes or counts again is not counted twice.
        """
        earlier = self.attempts().where((F.col("run") == self.run) & (F.col("stage") == stage)).agg(F.max("attempt")).first()[0] or 0
        began, clock = time.time(), time.perf_counter()
        error, n_in, n_out = None, None, None
        try:
            n_in = rows.count()
            seen = Observation(f"{stage} {earlier + 1}")
            make(rows).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out)
            n_out = seen.get["rows"]
            return self.spark.read.parquet(out)
        except Exception as x:
            error = f"{type(x).__name__}: {x}"[:1000]
            raise
        finally:
            row = (self.run, stage, earlier + 1, time.perf_counter() - clock, n_in, n_out, "failed" if error else "done", error)
            frame = self.spark.createDataFrame([row], "run string, stage string, attempt int, seconds double, rows_in long, rows_out long, outcome string, error string").withColumn("started_at", F.timestamp_seconds(F.lit(began)))
            frame.select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(self.path)
