"""Read models over the control plane's tables: the acquisition ledger, run listings, previews and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import coverage
from quillon.operators.aggregates import first_ids
from quillon.operators.predicates import is_pdf, page_kind

#: Sources whose retention is broadcast.
BROADCAST_SOURCES = 500_000


def acquisition_ledger(jurisdictions: DataFrame, sources: DataFrame, runs: DataFrame, captured: DataFrame, lifecycle: DataFrame, statuses: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """Per jurisdiction: expected, acquired, processed, withdrawn, refused and quarantined counts with both gaps (V1, V2).

    Each count is one aggregate by jurisdiction; the denominator is the latest attributed reconciliation, and only a
    published one that is no sample gives gaps.
    """
    owner = sources.select("source_id", "jurisdiction_id")
    by_run = runs.select("run_id", "source_id", "status", "run_metadata").join(owner, "source_id")
    acquired = captured.join(owner, "source_id").groupBy("jurisdiction_id").agg(F.count("*").alias("n"), F.count_distinct("final_url").alias("urls"))
    events = lifecycle.join(by_run.select("run_id", "jurisdiction_id"), "run_id").groupBy("jurisdiction_id").agg(
        F.count_distinct(F.when(F.col("event_type") == "document.processed", F.col("document_id"))).alias("processed"),
        F.count_distinct(F.when(F.col("event_type") == "document.withdrawn", F.col("document_id"))).alias("withdrawn"),
    )
    refused = by_run.where((F.col("status") == "failed") & F.coalesce(F.get_json_object("run_metadata", "$.refused").try_cast("boolean"), F.lit(False))).groupBy("jurisdiction_id").agg(F.count("*").alias("n"))
    held = statuses.where("status = 'quarantined'").join(by_run.select("run_id", "jurisdiction_id"), "run_id").groupBy("jurisdiction_id").agg(F.count_distinct("document_id").alias("n"))
    attributed = reconciliations.where("attribution_status = 'ATTRIBUTED' AND jurisdiction_id IS NOT NULL")
    latest = attributed.groupBy("jurisdiction_id").agg(F.max_by(F.struct("expected", "denominator_tier", "truncated"), F.struct("as_of", "run_id")).alias("r"), F.count("*").alias("reconciliations"))
    stages = {"acquired": acquired, "acquired_urls": acquired.select("jurisdiction_id", F.col("urls").alias("n")), "processed": events.select("jurisdiction_id", F.col("processed").alias("n")), "withdrawn": events.select("jurisdiction_id", F.col("withdrawn").alias("n")), "refused": refused, "quarantined": held}
    out = coverage.funnel(jurisdictions.select("jurisdiction_id", "name", "level"), "jurisdiction_id", stages).join(latest, "jurisdiction_id", "left")
    out = out.select("*", F.col("r.expected").alias("expected"), F.coalesce("r.denominator_tier", F.lit("NONE")).alias("denominator_tier"), F.coalesce("r.truncated", F.lit(False)).alias("truncated")).drop("r")
    return out.withColumn("acquired_gap", coverage.gap("expected", "acquired_urls", "denominator_tier", "truncated")).withColumn("processed_gap", coverage.gap("expected", "processed", "denominator_tier", "truncated"))


def acquisition_queue(ledger: DataFrame, sources: DataFrame, templated: DataFrame) -> DataFrame:
    """The jurisdictions that need work, with every reason (V3)."""
    marked = ledger.join(sources.select("jurisdiction_id").distinct().withColumn("has_source", F.lit(True)), "jurisdiction_id", "left").join(templated.select("jurisdiction_id").distinct().withColumn("has_template", F.lit(True)), "jurisdiction_id", "left")
    ready = marked.fillna({"has_source": False, "has_template": False}).withColumn("acquired", F.col("acquired_urls"))
    return coverage.work_queue(ready, coverage.work_reasons("acquired_gap", "processed_gap"), "name")


def run_listing(runs: DataFrame, sources: DataFrame, versions: DataFrame) -> DataFrame:
    """Runs with the names of source and version, newest first."""
    named = runs.join(sources.select("source_id", F.col("name").alias("source_name"), "jurisdiction_id"), "source_id").join(versions.select("source_version_id", "version_label"), "source_version_id")
    return named.orderBy(F.desc_nulls_last("started_at"), "run_id")


def run_preview(captured: DataFrame, sample: int = 10) -> DataFrame:
    """Per run: resources, distinct and duplicate checksums, PDFs, decisions, boilerplate, and the first pages."""
    shared = captured.where("checksum IS NOT NULL").groupBy("run_id", "checksum").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count("*").alias("checksums"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("duplicates"))
    kind = page_kind("title", "final_url", "source_url")
    counts = captured.groupBy("run_id").agg(
        F.count("*").alias("resources"),
        F.count_if(is_pdf("content_type", "final_url")).alias("pdfs"),
        F.count_if(kind == "decision").alias("decisions"),
        F.count_if(kind == "boilerplate").alias("boilerplate"),
    )
    counts = counts.join(first_ids(captured, ["run_id"], "final_url", sample), "run_id", "left")
    return counts.join(shared, "run_id", "left").fillna({"checksums": 0, "duplicates": 0})


def expired_artifacts(captured: DataFrame, sources: DataFrame, jurisdictions: DataFrame, policies: DataFrame, now) -> DataFrame:
    """Artifacts older than their jurisdiction's policy keeps them.

    What each source keeps is found first, so artifacts are joined once and by source: never by a jurisdiction or a
    policy, of which there are few.
    """
    policy = policies.select(F.col("policy_id").alias("compliance_policy_id"), "retention_days")
    held = jurisdictions.select("jurisdiction_id", "compliance_policy_id").join(policy, "compliance_policy_id")
    days = sources.select("source_id", "jurisdiction_id").join(held, "jurisdiction_id").select("source_id", "retention_days")
    joined = captured.join(F.broadcast(days) if days.count() <= BROADCAST_SOURCES else days, "source_id")
    return joined.where(F.col("fetched_at") < now - F.make_dt_interval("retention_days")).select(*captured.columns)
