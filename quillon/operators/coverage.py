"""Coverage, reconciliation and status analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.aggregates import first_ids
from quillon.operators.cron import previous_fire

DONE = ("completed", "succeeded")


def control_status(events: DataFrame, key: str, ts: str, kind: str, tie: str, most_attempts: int = 3, done: Sequence[str] = DONE, attempt: str | None = None) -> DataFrame:
    """The latest event of each key with its attempt counts, and what that makes the key's status (V13: W1, A2, J1, P8).

    One aggregate finds both: ``max_by`` needs no sort, and its partial result is one row per key and task.
    """
    order = F.struct(*[F.col(c) for c in (ts, *([attempt] if attempt else []), tie)])
    per = events.groupBy(key).agg(
        F.max_by(F.struct(F.col(kind).alias("k"), F.col(ts).alias("t")), order).alias("last"),
        F.count("*").alias("total_events"),
        F.count_if(F.col(kind) == "failed").alias("failed_attempts"),
    )
    last = F.col("last.k")
    status = F.when(last.isin(*done), "done").when(last == "dead_letter", "dead_letter").when((last == "failed") & (F.col("failed_attempts") >= most_attempts), "dead_letter").when(last == "failed", "retryable").when(last == "started", "in_progress").otherwise("processing")
    return per.select(key, last.alias("latest_event_type"), F.col("last.t").alias("latest_event_ts"), "total_events", "failed_attempts", status.alias("control_status"))


def funnel(places: DataFrame, key: str, stages: Mapping[str, DataFrame]) -> DataFrame:
    """Places with the count of each stage, 0 where there is none; each stage comes aggregated by key with a column ``n`` (V1)."""
    out = places
    for name, counts in stages.items():
        out = out.join(counts.select(key, F.col("n").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def gap(expected: str, have: str, tier: str, truncated: str) -> Column:
    """What is missing, known only against a published count that is no sample (V2); below zero where more is held than published."""
    return F.when((F.col(tier) == "PUBLISHED") & ~F.coalesce(F.col(truncated), F.lit(False)), F.col(expected) - F.col(have))


def work_reasons(acquired_gap: str, processed_gap: str) -> list[tuple[str, Column]]:
    """The rules of the acquisition queue in order (V3), over ``has_source``, ``has_template``, ``expected``, ``acquired`` and ``refused``.

    A place without a source has that one reason only.
    """
    source, a, p = F.col("has_source"), F.col(acquired_gap), F.col(processed_gap)
    return [
        ("NO_SOURCE", ~source & ~F.col("has_template")),
        ("NO_SOURCE_TEMPLATE_AVAILABLE", ~source & F.col("has_template")),
        ("NO_DENOMINATOR", source & F.col("expected").isNull()),
        ("NEVER_ACQUIRED", source & (F.col("acquired") == 0)),
        ("ACQUISITION_GAP", source & (a > 0)),
        ("PROCESSING_GAP", source & (p > 0)),
        ("HOLDINGS_EXCEED_DENOMINATOR", source & (F.coalesce(a < 0, F.lit(False)) | F.coalesce(p < 0, F.lit(False)))),
        ("REFUSALS_OUTSTANDING", source & (F.col("refused") > 0)),
    ]


def work_queue(df: DataFrame, reasons: Sequence[tuple[str, Column]], name: str) -> DataFrame:
    """Rows with at least one reason: ``reasons`` in order, most urgent rank first, then by name."""
    ranked = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("rank"), F.lit(n).alias("reason"))) for i, (n, c) in enumerate(reasons)]))
    out = df.withColumn("__r", ranked).where(F.size("__r") > 0)
    return out.withColumn("reasons", F.transform("__r", lambda x: x["reason"])).withColumn("first_rank", F.array_min(F.transform("__r", lambda x: x["rank"]))).drop("__r").orderBy("first_rank", name)


def unattributable(df: DataFrame, owners: DataFrame, key: str, counted: str) -> DataFrame:
    """How many things have no owner."""
    return df.join(owners.select(key).distinct(), key, "left_anti").agg(F.count_distinct(counted).alias("n"), F.count("*").alias("rows"))


def coverage_payload(payload: Column) -> Column:
    """Exactly one entity attributes a published count; none or several are ambiguous, their observed counts add up (V5).

    ``payload`` is an array of (expected, observed); without one there is no row of coverage, so all fields are null.
    """
    one = F.size(payload) == 1
    observed = F.aggregate(payload, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["observed"], F.lit(0)).cast("long"))
    return F.struct(F.when(payload.isNull(), F.lit(None)).when(one, "ATTRIBUTED").otherwise("AMBIGUOUS").alias("attribution"), F.when(one, F.when(F.get(payload, 0)["expected"] > 0, F.get(payload, 0)["expected"])).alias("expected"), observed.alias("observed"))


def reconcile_units(events: DataFrame, key: str, ts: str, status: str, arrival: str, terminal: Sequence[str], now: Column, deadline_hours: int = 24) -> DataFrame:
    """Per unit: latest status, is any status terminal, first and last seen, and, without an end, last seen before the deadline."""
    per = events.groupBy(key).agg(
        F.max_by(status, F.struct(ts, arrival)).alias("latest_status"),
        F.bool_or(F.col(status).isin(*terminal)).alias("terminated"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.array_sort(F.collect_set(status)).alias("statuses"),
    )
    late = ~F.col("terminated") & (F.col("last_seen") <= now - F.make_dt_interval(hours=F.lit(deadline_hours)))
    return per.withColumn("past_deadline", late)


def reconcile_verdict(units: DataFrame) -> DataFrame:
    """NOTHING_OBSERVED, UNTERMINATED or RECONCILED over all units, with the counts (V6)."""
    counts = units.agg(F.count("*").alias("units"), F.count_if("terminated").alias("terminated"), F.count_if("past_deadline").alias("past_deadline"))
    return counts.withColumn("verdict", F.when(F.col("units") == 0, "NOTHING_OBSERVED").when(F.col("terminated") < F.col("units"), "UNTERMINATED").otherwise("RECONCILED"))


def stranded(units: DataFrame, cutoff: Column) -> DataFrame:
    """Units that have not ended and were last seen by the cutoff (V7)."""
    return units.where(~F.col("terminated") & (F.col("last_seen") <= cutoff))


def rollup(stages: Column, run_status: Column, completed_at: Column, now: Column, grace_hours: int = 24) -> Column:
    """A pipeline's status from an array of stage statuses (V9): failed, blocked, stalled, in_progress or ok.

    Unfinished stages are stalled once a completed run has ended so long ago; an unknown end is not an old one.
    """
    stalled = (run_status == "completed") & (completed_at <= now - F.make_dt_interval(hours=F.lit(grace_hours)))
    open_ = F.arrays_overlap(stages, F.array(F.lit("pending"), F.lit("in_progress")))
    return F.when(F.array_contains(stages, "failed"), "failed").when(F.array_contains(stages, "blocked"), "blocked").when(open_ & F.coalesce(stalled, F.lit(False)), "stalled").when(open_, "in_progress").otherwise("ok")


def drained(tasks: DataFrame, runs: DataFrame, key: str, done: Column) -> DataFrame:
    """Is every task of each run done; a run without tasks is."""
    per = tasks.groupBy(key).agg(F.bool_and(done).alias("complete"))
    return runs.select(key).join(per, key, "left").withColumn("complete", F.coalesce("complete", F.lit(True)))


def index_coverage(documents: DataFrame, ids: str, wanted: DataFrame | None, updated: str, sample: int = 25) -> DataFrame:
    """Per id: documents, the newest update, how many lack one and the first sample ids; requested ids that lack any are added."""
    rows = documents.select("document_id", updated, F.explode(F.array_distinct(ids)).alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("documents"), F.max(updated).alias("newest"), F.count_if(F.col(updated).isNull()).alias("missing"))
    held = held.join(first_ids(rows, ["key"], "document_id", sample), "key", "left")
    if wanted is not None:
        held = held.join(wanted.select("key").distinct(), "key", "full_outer").withColumn("documents", F.coalesce("documents", F.lit(0)))
    return held.withColumn("held", F.col("documents") > 0).orderBy(F.desc("documents"), "key")


def processing_stage(latest: Column, run_status: Column, unterminated: Column, past_deadline: Column) -> Column:
    """The processing stage from its latest status (V17); what has not ended keeps it from being ok, and past the deadline blocks it."""
    base = F.when(latest.isNull(), F.when(run_status.isin("failed", "cancelled"), "blocked").otherwise("pending")).when(latest == "failed", "failed").when(latest == "quarantined", "blocked").when(latest.isin("accepted", "processing"), "in_progress").otherwise("ok")
    late = F.coalesce(past_deadline, F.lit(0)) > 0
    return F.when(late & (base != "failed"), "blocked").when((F.coalesce(unterminated, F.lit(0)) > 0) & (base == "ok"), "in_progress").otherwise(base)


def projection_stage(latest: Column, lifecycle: Column) -> Column:
    """The projection stage: ok with any lifecycle event, else what processing lets it be."""
    return F.when(lifecycle.isNotNull(), "ok").when(latest.isNull(), "pending").when(latest.isin("failed", "quarantined"), "blocked").otherwise("in_progress")


def search_stage(lifecycle: Column) -> Column:
    return F.when(lifecycle.isNotNull(), "ok").otherwise("pending")


def reachable(stages: Column, run_status: Column) -> Column:
    """Pending stages of a run that failed or was cancelled do not apply."""
    return F.when(run_status.isin("failed", "cancelled"), F.transform(stages, lambda s: F.when(s == "pending", "not_applicable").otherwise(s))).otherwise(stages)


def stall_cause(refused: Column, run_status: Column, processing_events: Column, lifecycle_events: Column, processing: Column, projection: Column, search: Column) -> Column:
    """Why a run has not got where it should, the first cause that holds (V18); the run's own status is asked before its stages."""
    waiting = ("pending", "in_progress")
    return (
        F.when(F.coalesce(refused, F.lit(False)), "run_refused_by_lock")
        .when(run_status == "pending", "no_dispatch_worker")
        .when(run_status == "failed", "run_failed")
        .when((run_status == "completed") & (processing_events == 0), "publish_path_disabled")
        .when(run_status.isin("running", "in_progress"), "too_early_to_diagnose")
        .when(processing.isin(*waiting) & (processing_events > 0), "di_consumer_silent")
        .when((processing_events > 0) & (lifecycle_events == 0) & projection.isin(*waiting), "projection_stalled")
        .when((lifecycle_events > 0) & (search == "pending"), "search_projection_pending")
        .otherwise("unknown")
    )


def launch_class(df: DataFrame, readiness: str, enabled: str, provenance: str) -> DataFrame:
    """Adds ``blocker``, ``modes``, ``lock_state`` and ``launchable`` from the two keys of a template."""
    known = F.lower(F.trim(F.coalesce(readiness, F.lit(""))))
    code = F.when(known.isin("scaffold", "awaiting_evidence", "live"), known).otherwise("scaffold")
    key = F.when(F.coalesce(enabled, F.lit(False)), "open").when(F.lower(F.trim(F.coalesce(provenance, F.lit("default")))) == "override", "closed_by_operator").otherwise("never_turned")
    blocker = F.when(code == "scaffold", "provider_scaffold").when(key == "closed_by_operator", "template_disabled_by_operator").when(code == "awaiting_evidence", "provider_awaiting_evidence").when(key == "never_turned", "template_never_enabled")
    none, one, all_ = F.array().cast("array<string>"), F.array(F.lit("acceptance")), F.array(F.lit("acceptance"), F.lit("preview"), F.lit("production"))
    modes = F.when((code == "scaffold") | (key == "closed_by_operator"), none).when((code == "awaiting_evidence") | (key == "never_turned"), one).otherwise(all_)
    return df.withColumns({"code_key": code, "config_key": key, "blocker": blocker, "modes": modes}).withColumns({"lock_state": F.when(F.size("modes") == 0, "closed").when(F.col("blocker").isNull(), "open").otherwise("acceptance_only"), "launchable": F.col("blocker").isNull()})


def launch_summary(classified: DataFrame) -> DataFrame:
    """How many templates could be launched, or could gather evidence."""
    return classified.agg(F.count("*").alias("total"), F.count_if("launchable").alias("launchable"), F.count_if(F.array_contains("modes", "acceptance")).alias("acceptance_ready"), F.count_if(F.col("blocker") == "provider_scaffold").alias("needs_engineering"))


def gate_verdict(outcomes: Column) -> Column:
    """From an array of (gate, outcome): no bundle (null) refuses nothing, an empty one is unknown coverage, a gate not evaluated refuses."""
    missing = F.filter(outcomes, lambda o: o["outcome"] == "not_evaluated")
    excluded = F.filter(outcomes, lambda o: o["outcome"] == "excluded")
    codes = F.array_compact(F.array(F.when(F.size(outcomes) == 0, "gate_coverage_unknown"), F.when(F.size(missing) > 0, "gate_not_evaluated")))
    return F.struct((F.coalesce(F.size(outcomes), F.lit(0)) > 0).alias("reported"), F.when(outcomes.isNull(), F.lit(True)).otherwise(F.size(codes) == 0).alias("is_evidence"), F.when(outcomes.isNull(), F.array().cast("array<string>")).otherwise(codes).alias("refusals"), F.transform(excluded, lambda o: o["gate"]).alias("excluded"))


def freshness(df: DataFrame, loaded: str, now: Column, warn_hours: int = 2, error_hours: int = 6) -> DataFrame:
    """Age of the newest row: pass, warn or error; an empty table is an error."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600
    return df.agg(F.max(loaded).alias("newest")).withColumn("status", F.when(F.col("newest").isNull() | (hours > error_hours), "error").when(hours > warn_hours, "warn").otherwise("pass"))


def schedules_due(schedules: DataFrame, now: Column) -> DataFrame:
    """Enabled schedules whose previous fire time lies after their last run, or that never ran.

    The previous fire follows from ``cron`` where there is such a column, else it is read from ``previous_fire``; a schedule
    that never fired, or whose text is malformed, is not due.
    """
    rows = previous_fire(schedules, "cron", now) if "cron" in schedules.columns else schedules
    fired = F.col("previous_fire")
    return rows.where(F.col("enabled") & (fired <= now) & (F.col("last_run").isNull() | (fired > F.col("last_run"))))
