"""Columns by any name, and batches of texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.components import ensure_checkpoint_dir


def column(name: str) -> Column:
    """A column by its whole name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of ``df`` but those of these names, in either case."""
    low = {n.lower() for n in names}
    return [column(c) for c in df.columns if c.lower() not in low]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def plainly_named(df: DataFrame, *used: str) -> DataFrame:
    """``df`` with all columns but the used ones named by position: ``mapInArrow`` does not take names with dots. ``toDF`` undoes it."""
    return df.toDF(*[c.lower() if c.lower() in used else f"c{i}" for i, c in enumerate(df.columns)])


def identified(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` with a made ``doc_id`` (long) for each row that has none, and the condition that tells made ids.

    Made ids lie above all real ones (below them if there is no room above). They follow from a hash of all columns, so
    the order of different rows is the same in every run; only equal rows are told apart by where they lie, and what is
    told apart is checkpointed. Without such rows ``docs`` come back as they are.
    """
    most, least, missing = docs.agg(F.max("doc_id").cast("long"), F.min("doc_id").cast("long"), F.count_if(F.col("doc_id").isNull())).first()
    typed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    if not missing:
        return typed, F.lit(False)
    room = 1 << 62
    up, down = max(-1 if most is None else most, -1) + 1, min(0 if least is None else least, 0) - 1
    if up > room and down < -room:
        raise ValueError("the ids leave no room for others")
    place = F.shiftrightunsigned(F.xxhash64(*[column(c) for c in docs.columns]), 26) * (1 << 24) + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 24))
    made = F.lit(up) + place if up <= room else F.lit(down) - place
    ensure_checkpoint_dir(docs.sparkSession)
    return typed.withColumn("doc_id", F.coalesce("doc_id", made)).checkpoint(), F.col("doc_id") >= up if up <= room else F.col("doc_id") <= down


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Arrow hand texts to Python in batches of at most so many rows, unless the session asks for fewer.

    The default of 10,000 rows is made for numbers; of texts it takes tens of megabytes on both sides of each task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
