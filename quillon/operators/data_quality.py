"""Data-quality rules: each gives the number of rows that break it (Q1 to Q9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, failures) of conditions on single rows, all in one scan; a condition that is null counts as broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in rules]), F.array(*[F.col(f"`{n}`") for n in rules]))).alias("rule", "failures"))


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def accepted(column: str, values: Sequence[str]) -> Column:
    """In the set, or null."""
    return F.col(column).isNull() | F.col(column).isin(*values)


def between(column: str, low: object, high: object, where: Column | None = None) -> Column:
    """Within bounds, where the condition holds; null passes."""
    ok = F.col(column).isNull() | F.col(column).between(low, high)
    return ok if where is None else ~F.coalesce(where, F.lit(False)) | ok


def matches(column: str, pattern: str) -> Column:
    return F.col(column).isNull() | F.col(column).rlike(pattern)


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has (Q2)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unrelated(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose value the parent lacks (Q4)."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def column_contract(df: DataFrame, declared: Sequence[str]) -> tuple[set[str], set[str]]:
    """Columns that are missing and columns that are not declared (Q6)."""
    return set(declared) - set(df.columns), set(df.columns) - set(declared)


def sparse_index(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Rows whose index is not their place, from 0 (Q7)."""
    w = Window.partitionBy(*keys).orderBy(index)
    return df.withColumn("expected", F.row_number().over(w) - 1).where(F.col(index) != F.col("expected"))


def several_current(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys with other than one current row (Q7, A10)."""
    return df.groupBy(key).agg(F.count_if(flag).alias("n")).where("n <> 1")


def disordered(df: DataFrame, keys: Sequence[str], ordinal: str, arrival: str) -> DataFrame:
    """Rows whose ordinal does not exceed the one before (Q8)."""
    w = Window.partitionBy(*keys).orderBy(arrival)
    return df.withColumn("before", F.lag(ordinal).over(w)).where(F.col(ordinal) <= F.col("before"))


def run(rules: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, failures) of rules that each give their failing rows."""
    parts = [d.agg(F.count("*").alias("failures")).select(F.lit(n).alias("rule"), "failures") for n, d in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_rules() -> dict[str, Column]:
    """What a published document must hold (Q9)."""
    return {
        "document_id_shape": F.col("document_id").rlike(r"^doc_[0-9a-hjkmnp-z]{26}$"),
        "revision_positive": F.col("document_revision") >= 1,
        "title_given": F.length(F.trim("title")) > 0,
        "text_given": F.length(F.trim("body_text")) > 0,
        "lifecycle_known": F.col("lifecycle_status").isin("active", "withdrawn", "superseded", "draft"),
    }


def section_rules() -> dict[str, Column]:
    """What a published section must hold."""
    return {"parent_given": F.col("document_id").isNotNull(), "ordinal_from_zero": F.col("ordinal") >= 0, "depth_from_zero": F.col("depth") >= 0, "content_given": F.length(F.trim("content")) > 0}


def insight_rules() -> dict[str, Column]:
    """What a commentary insight must hold."""
    return {"confidence_is_a_share": F.col("confidence").between(0, 1), "claim_given": F.length(F.trim("claim")) > 0, "supported": F.size("support") > 0}
