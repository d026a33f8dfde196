"""Latest rows, ranks, sessions and other windows over keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in this order; give a tie-break last, or the row is not determined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def is_latest(keys: Sequence[str], *order: Column) -> Column:
    """Is this the first row of its key."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1


def position(keys: Sequence[str], *order: Column) -> Column:
    """Place within the key, from 0."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def seconds_to_next(keys: Sequence[str], ts: str, *tie: Column) -> Column:
    """Whole seconds until the key's next row; null at the last."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts), *tie)
    return F.unix_timestamp(F.lead(ts).over(w).cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))


def first_known(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """Per key the first non-null value of each column in this order (W8); one aggregate, no window."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(c) for c in columns])


def newest(df: DataFrame, keys: Sequence[str], value: str, at: str, arrival: str) -> DataFrame:
    """Per key the value seen last; of equal times the later arrival counts."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(at, arrival)).alias(value))


def with_session(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, *tie: Column) -> DataFrame:
    """Adds ``session``, from 1 within the key: a new one only where the gap to the row before is longer.

    Rows without a time come last and belong to the key's last session; a key of which no row has a time has one.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_last(), *tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.coalesce((micros - F.lag(micros).over(w)) > gap_seconds * 1_000_000, F.lit(False))
    return df.withColumn("__new", fresh.cast("int")).withColumn("session", 1 + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def session_key(*candidates: str) -> Column:
    """The first key that is there; rows without any share one."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in candidates], F.lit("(none)"))


def relative_spread(scores: Column) -> Column:
    """(first - last) / first of descending scores; null where the first is not positive."""
    first = F.array_max(scores)
    return F.when(first > 0, (first - F.array_min(scores)) / first)
