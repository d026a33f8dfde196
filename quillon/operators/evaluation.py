"""Scores of answers against gold answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the overall score and the least averages that pass.
WEIGHTS = {"correctness": 0.30, "citation_precision": 0.20, "citation_recall": 0.10, "temporal_accuracy": 0.15, "source_type_correct": 0.10, "hallucination": 0.10, "completeness": 0.05}
GATES = {"citation_precision": 0.95, "source_type_correct": 0.98, "temporal_accuracy": 0.95, "hallucination": 0.98}


def pipe_list(c: Column) -> Column:
    """The distinct entries between pipes."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != ""))


def overlap(gold: Column, answer: Column) -> Column:
    """The share of the gold answer's words of over three letters that the answer holds; of none, whether there is an answer."""
    words = F.array_distinct(F.filter(F.split(F.trim(F.lower(F.coalesce(gold, F.lit("")))), r"\s+"), lambda w: F.length(w) > 3))
    text = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(text, w))) / F.size(words)).otherwise((text != "").cast("double"))


def score(df: DataFrame) -> DataFrame:
    """Scores of rows that join query, gold answer and prediction, rounded to three places."""
    required, used, forbidden = pipe_list(F.col("required_doc_ids")), pipe_list(F.col("used_doc_ids")), pipe_list(F.col("forbidden_doc_ids"))
    right = F.size(F.array_intersect(used, required))
    precision = F.when(F.size(used) > 0, right / F.size(used)).otherwise(0.0)
    precision = F.when(F.size(F.array_intersect(used, forbidden)) > 0, F.greatest(F.lit(0.0), precision - 0.5)).otherwise(precision)
    flags = F.coalesce("model_flags", F.lit(""))
    temporal = F.when(F.col("task_type") != "temporal_version", 1.0).when(F.contains(flags, F.lit("temporal_ok=true")), 1.0).when(F.contains(flags, F.lit("temporal_ok=false")), 0.0).otherwise(0.5)
    out = (
        df.withColumn("correctness", overlap(F.col("gold_short_answer"), F.col("answer_text")))
        .withColumn("citation_precision", precision)
        .withColumn("citation_recall", F.when(F.size(required) > 0, right / F.size(required)).otherwise(1.0))
        .withColumn("source_type_correct", F.col("source_class_claimed").eqNullSafe(F.col("expected_source_class")).cast("double"))
        .withColumn("temporal_accuracy", temporal)
        .withColumn("hallucination", F.when(F.lower(F.coalesce("must_flag_non_binding", F.lit("false"))) == "true", F.contains(flags, F.lit("non_binding_flagged=true")).cast("double")).otherwise(1.0))
        .withColumn("completeness", F.least(F.lit(1.0), F.col("correctness") * 0.7 + F.col("citation_recall") * 0.3))
    )
    overall = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("overall_score", overall).select("query_id", *[F.round(c, 3).alias(c) for c in (*WEIGHTS, "overall_score")])


def summary(scores: DataFrame) -> DataFrame:
    """Averages, and whether each gate and all pass."""
    means = scores.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in (*WEIGHTS, "overall_score")])
    out = means.select("*", *[F.coalesce(F.col(k) >= v, F.lit(False)).alias(f"{k}_ok") for k, v in GATES.items()])
    return out.withColumn("passed", F.expr(" AND ".join(f"{k}_ok" for k in GATES)))


def read_csvs(spark, queries: str, gold: str, predictions: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of an evaluation, all columns as text."""
    return tuple(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p) for p in (queries, gold, predictions))


def write_scores(scores: DataFrame, folder: str) -> None:
    """Scores as CSV and their summary as JSON."""
    scores.write.mode("overwrite").option("header", True).csv(f"{folder}/scores")
    summary(scores).write.mode("overwrite").json(f"{folder}/summary")
