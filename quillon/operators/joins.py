"""Joins with semantics of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key the right side lacks; nulls on the right hide nothing."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def held_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key the right side has."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def requested(keys: DataFrame, held: DataFrame, key: str, count: str) -> DataFrame:
    """Every requested key and every held one, with a count of zero where nothing is held."""
    return keys.select(key).distinct().join(held.select(key, count), key, "full_outer").withColumn(count, F.coalesce(count, F.lit(0))).withColumn("held", F.col(count) > 0)


def either_key(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], row_id: str) -> DataFrame:
    """Rows that match on any of several key pairs, once each: a union of equi-joins instead of a join on OR."""
    names = [f"r_{c}" for c in right.columns]
    renamed = right.toDF(*names)
    parts = [left.join(renamed, left[a] == renamed[f"r_{b}"]) for a, b in zip(left_keys, right_keys, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([row_id, *names])


def with_dimension(fact: DataFrame, dim: DataFrame, key: str, code: str, unknown: str = "unknown") -> DataFrame:
    """A left join to a dimension; what it lacks is the unknown member (J8). Spark broadcasts the dimension if it is small."""
    return fact.join(dim, key, "left").withColumn(code, F.coalesce(code, F.lit(unknown)))


def repaired(edges: DataFrame, targets: DataFrame, key: str, column: str) -> DataFrame:
    """Fills what was null when written from what is known now."""
    return edges.join(targets.select(key, F.col(column).alias("__now")), key, "left").withColumn(column, F.coalesce(column, "__now")).drop("__now")


def matches(edges: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """A row for each edge and each different target of its key, ``target`` null where there is none.

    Rows, not arrays: a key that very many targets share is split by the join, never held by one task.
    """
    return edges.join(targets.select(key, target).where(F.col(key).isNotNull()).distinct(), key, "left")


def as_of(versions: DataFrame, keys: Sequence[str], version: str, start: str, end: str, at: Column) -> DataFrame:
    """One version of each key as of a date.

    The newest that began by then, in force if it has not ended; if all begin later, the earliest, not in force; if none
    has a date, the greatest version, which is taken to be in force. One aggregate: nothing is joined to itself.
    """
    begun, v = F.col(start) <= at, F.struct(version, start, end)
    picked = versions.groupBy(*keys).agg(
        F.max_by(F.when(begun, v), F.when(begun, F.struct(start, version))).alias("past"),
        F.min_by(F.when(F.col(start) > at, v), F.when(F.col(start) > at, F.struct(start, version))).alias("future"),
        F.max_by(v, version).alias("undated"),
    )
    chosen = F.coalesce("past", "future", "undated")
    force = F.when(F.col("past").isNotNull(), F.coalesce(F.col(f"past.{end}") >= at, F.lit(True))).otherwise(F.col("future").isNull())
    return picked.select(*keys, chosen[version].alias(version), chosen[start].alias(start), force.alias("in_force"))


def split_missing(queries: DataFrame, gold: DataFrame, predictions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Complete triples, and an error row for each query that lacks its answer or prediction."""
    g, p = gold.select(key).distinct().withColumn("__g", F.lit(True)), predictions.select(key).distinct().withColumn("__p", F.lit(True))
    marked = queries.join(g, key, "left").join(p, key, "left")
    errors = marked.where("__g IS NULL OR __p IS NULL").select(key, F.concat_ws(",", F.when(F.col("__g").isNull(), F.lit("missing gold")), F.when(F.col("__p").isNull(), F.lit("missing prediction"))).alias("error"))
    return queries.join(gold, key).join(predictions, key), errors


def optional(patterns: DataFrame, triples: DataFrame, subject: str, predicate: str, name: str) -> DataFrame:
    """An optional triple pattern: a left join to the subject's values of a predicate."""
    return patterns.join(triples.where(F.col("predicate") == predicate).select(F.col("subject").alias(subject), F.col("object").alias(name)), subject, "left")
