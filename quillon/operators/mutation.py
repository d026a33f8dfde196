"""Incremental writes, history and guarded deletes over Parquet tables (M1 to M23). Tables are values: every step returns a new one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.ids import hash_id


class Refused(ValueError):
    """A guardrail stopped a destructive step."""


def _same(columns: Sequence[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))


def deduped(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, or a merge of them would not be determined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows replace the target's rows of their keys (M1, M2, S22); missing columns become null. ``rows`` has unique keys."""
    return target.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_new(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose key is new; of repeated new keys one is kept."""
    return target.unionByName(rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti"))


def update_where_null(target: DataFrame, rows: DataFrame, key: str, marker: str) -> DataFrame:
    """Rows overwrite the target only where its marker is still null; new keys are added."""
    t, r = target.alias("t"), rows.alias("r")
    columns = [F.when(F.col(f"t.{key}").isNull() | (F.col(f"r.{key}").isNotNull() & F.col(f"t.{marker}").isNull()), F.col(f"r.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns]
    return t.join(r, F.col(f"t.{key}") == F.col(f"r.{key}"), "full_outer").select(*columns)


def patch(target: DataFrame, rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New values where given, old ones elsewhere."""
    renamed = rows.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return target.join(renamed, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The target without the rows of these keys."""
    return target.join(keys.select(key).distinct(), key, "left_anti")


def next_revision(incoming: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Revisions go on from the greatest known one, in order."""
    known = existing.groupBy(key).agg(F.max("revision").alias("__max"))
    w = Window.partitionBy(key).orderBy(order)
    return incoming.join(known, key, "left").withColumn("revision", F.coalesce("__max", F.lit(0)) + F.row_number().over(w)).drop("__max")


def new_version_flag(rows: DataFrame, prior: DataFrame, keys: Sequence[str], full_refresh: bool = False) -> DataFrame:
    """Is a key unknown to the prior state; everything is new on a full refresh."""
    if full_refresh:
        return rows.withColumn("is_new_version", F.lit(True))
    seen = prior.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return rows.join(seen, list(keys), "left").withColumn("is_new_version", F.col("__seen").isNull()).drop("__seen")


def scd2_apply(history: DataFrame, incoming: DataFrame, key: str, tracked: Sequence[str], at: Column) -> DataFrame:
    """History after one snapshot (M3): changed and vanished rows are closed, changed and new ones opened.

    ``history`` has the key, the tracked columns, ``valid_from`` and ``valid_to`` (null: current).
    """
    closed = history.where("valid_to IS NOT NULL")
    h, i = history.where("valid_to IS NULL").alias("h"), incoming.select(key, *tracked).alias("i")
    both = h.join(i, F.col(f"h.{key}") == F.col(f"i.{key}"), "full_outer").withColumn("same", F.col(f"h.{key}").isNotNull() & F.col(f"i.{key}").isNotNull() & _same(tracked, "h", "i"))
    ended = both.where(F.col(f"h.{key}").isNotNull()).select(*[F.col(f"h.{c}") for c in (key, *tracked, "valid_from")], F.when(~F.col("same"), at).alias("valid_to"))
    opened = both.where(F.col(f"i.{key}").isNotNull() & ~F.col("same")).select(*[F.col(f"i.{c}") for c in (key, *tracked)], at.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    return closed.select(*ended.columns).unionByName(ended).unionByName(opened)


def scd2_from_log(log: DataFrame, key: str, tracked: Sequence[str], ts: str, *tie: str) -> DataFrame:
    """The same history at once from a log of states: a row for each run of equal states (M3, M4)."""
    w = Window.partitionBy(key).orderBy(ts, *tie)
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in tracked], F.row_number().over(w) == 1)
    starts = log.withColumn("__changed", changed).where("__changed").drop("__changed")
    return starts.select(key, *tracked, F.col(ts).alias("valid_from"), F.lead(ts).over(w).alias("valid_to")).withColumn("is_current", F.col("valid_to").isNull())


def dimension(history: DataFrame, key: str) -> DataFrame:
    """A dimension with a surrogate key over natural key and start (M4)."""
    return history.withColumn("surrogate_key", hash_id(key, "valid_from")).withColumn("is_current", F.col("valid_to").isNull())


# Why a document may be retracted; the first needs the id of the document that stays.
REASONS = ("duplicate_identity", "erroneous_publication", "takedown")


@dataclass(frozen=True)
class Retraction:
    """What a retraction would do: the ledger row is written first, then sections go, then documents."""

    ledger: DataFrame
    sections: DataFrame
    documents: DataFrame
    matched: int


def retract(documents: DataFrame, sections: DataFrame, ids: Sequence[str], reason_code: str, reason: str, operator: str, superseded_by: str | None, at: Column, most: float = 0.10) -> Retraction:
    """Plans a retraction, or raises (M8, M9); ids that are not there are no error and change nothing."""
    if reason_code not in REASONS:
        raise Refused(f"unknown reason code {reason_code}")
    if not reason.strip() or not operator.strip():
        raise Refused("a reason and an operator are required")
    if reason_code == "duplicate_identity" and superseded_by is None:
        raise Refused("a duplicate needs the document that supersedes it")
    if superseded_by is not None:
        if superseded_by in ids:
            raise Refused("a document cannot supersede itself")
        if documents.where(F.col("document_id") == superseded_by).limit(1).count() == 0:
            raise Refused("the superseding document is not there")
    target = F.col("document_id").isin(*ids) if ids else F.lit(False)
    n = documents.agg(F.count_distinct("document_id").alias("n"), F.count_distinct(F.when(target, F.col("document_id"))).alias("hit")).first()
    if n.n and n.hit / n.n > most:
        raise Refused(f"{n.hit} of {n.n} documents are more than the share of {most}")
    ledger = documents.where(target).groupBy("document_id").agg(F.array_sort(F.collect_set("document_revision")).alias("retracted_revisions")).select(hash_id("document_id", F.lit(reason_code), at).alias("retraction_id"), "document_id", "retracted_revisions", F.lit(reason_code).alias("reason_code"), F.lit(reason).alias("reason"), F.lit(superseded_by).cast("string").alias("superseded_by_document_id"), F.lit(operator).alias("retracted_by"), at.alias("retracted_at"))
    return Retraction(ledger, sections.where(~target), documents.where(~target), n.hit)


def orphans(index: DataFrame, canonical: DataFrame, key: str, most: float = 0.25) -> DataFrame:
    """Index keys that the canonical table lacks; refuses where that looks like a failed read."""
    lost = index.select(key).distinct().join(canonical.select(key).distinct(), key, "left_anti")
    n_canonical, n_index, n_lost = canonical.select(key).limit(1).count(), index.select(key).distinct().count(), lost.count()
    if not n_canonical:
        raise Refused("the canonical table is empty")
    if n_index and n_lost / n_index > most:
        raise Refused(f"{n_lost} of {n_index} keys are orphans, more than the share of {most}")
    return lost


def sweep(df: DataFrame, doomed: Column, dry_run: bool = True) -> tuple[DataFrame, int]:
    """What stays and how many rows go; in a dry run all stay."""
    n = df.where(doomed).count()
    return (df if dry_run else df.where(~F.coalesce(doomed, F.lit(False)))), n


def changed_keys(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """Keys with ``change``: added, removed, changed or same, by the compared columns alone."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*compared)), 256).alias("d"))
    o, n = digest(old).withColumnRenamed("d", "o"), digest(new).withColumnRenamed("d", "n")
    return o.join(n, key, "full_outer").select(key, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").otherwise("same").alias("change"))


def metadata_audit(df: DataFrame, keys: Sequence[str], emitted: str, stored: str) -> DataFrame:
    """Per key: PRESENT, DROPPED, NEVER_EMITTED or INDETERMINATE, from maps of what was emitted and stored."""
    witnesses = [F.count_if(F.map_contains_key(m, F.lit(k))).alias(f"{m}_{k}") for k in keys for m in (emitted, stored)]
    counts = df.agg(F.count("*").alias("n"), *witnesses)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"{emitted}_{k}").alias("n_emitted"), F.col(f"{stored}_{k}").alias("n_stored")) for k in keys])).alias("r")
    verdict = F.when(F.col("n") == 0, "INDETERMINATE").when(F.col("n_stored") > 0, "PRESENT").when(F.col("n_emitted") > 0, "DROPPED").otherwise("NEVER_EMITTED")
    return counts.select("n", rows).select("n", "r.*").withColumn("verdict", verdict).drop("n")


def repair_plan(audit: DataFrame) -> DataFrame:
    """What to do about each audited key."""
    return audit.select("key", F.when(F.col("verdict") == "DROPPED", "widen schema and replay").when(F.col("verdict") == "INDETERMINATE", "collect a witness").otherwise("none").alias("action"))


def clustered(df: DataFrame, *columns: str, partitions: int | None = None) -> DataFrame:
    """Ranges of the columns close together, so that Parquet statistics prune."""
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns)


# Where a correction may go from each status.
TRANSITIONS = {"pending": ("applied", "rejected"), "applied": ("superseded",), "rejected": (), "superseded": ()}


def may_move(current: Column, wanted: Column) -> Column:
    """Does the state machine of corrections allow the step."""
    return F.coalesce(reduce(lambda a, b: a | b, [(current == c) & wanted.isin(*w) for c, w in TRANSITIONS.items() if w]), F.lit(False))


def overlaid(base: Column, overlay: Column) -> Column:
    """Maps merged key by key, the overlay's values first."""
    return F.map_filter(F.map_zip_with(base, overlay, lambda _, a, b: F.coalesce(b, a)), lambda _, v: v.isNotNull())


def keyed_merge(target: DataFrame, rows: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their outcome (had, updated, unchanged), and the keys that match nothing."""
    joined = target.join(rows.select(key, F.col(column).alias("__new")), key, "left")
    outcome = F.when(F.col("__new").isNull(), "unchanged").when(F.col(column).eqNullSafe(F.col("__new")), "had").otherwise("updated")
    return joined.withColumn("outcome", outcome).withColumn(column, F.coalesce("__new", column)).drop("__new"), rows.select(key).join(target.select(key), key, "left_anti")
