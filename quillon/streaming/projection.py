"""Event application: duplicates, stale revisions, outcome routing, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def outcomes(events: DataFrame, event_id: str, key: str, revision: str, arrival: str) -> DataFrame:
    """Adds ``outcome``: ignored_duplicate for an id seen before, stale below the greatest revision applied, else applied.

    An equal revision is applied. Duplicates do not raise the greatest revision.
    """
    seen = Window.partitionBy(event_id).orderBy(arrival)
    marked = events.withColumn("__copy", F.row_number().over(seen) > 1)
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.when(~F.col("__copy"), F.col(revision))).over(before)
    outcome = F.when(F.col("__copy"), "ignored_duplicate").when(F.col(revision) < top, "stale").otherwise("applied")
    return marked.withColumn("outcome", outcome).drop("__copy")


def route(status: Column, transient: Column, delivered: Column, most: int) -> Column:
    """processed, quarantined, rejected_permanent, transient_retry or dead_lettered."""
    return F.when(status == "ok", "processed").when(status == "quarantined", "quarantined").when(~transient, "rejected_permanent").when(delivered >= most, "dead_lettered").otherwise("transient_retry")


def status_sequence(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Per unit the statuses in order, and whether they are a whole sequence: accepted, processing, then an end."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k")))), lambda x: x["k"])
    out = events.groupBy(key).agg(listed.alias("statuses"))
    good = F.array_join("statuses", ">").rlike("^accepted>processing>(canonical_ready|quarantined|failed)$")
    return out.withColumn("complete", good)


def read_drop(spark: SparkSession, schema: StructType, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON files with the file each row came from."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.json(folder).withColumn("_source_file", F.col("_metadata.file_path")).withColumn("ingested_at", F.current_timestamp())


def deduplicated(stream: DataFrame, event_id: str, ts: str | None = None, lateness: str | None = None) -> DataFrame:
    """Each event once (E3); without a bound on lateness the state never expires."""
    if lateness:
        return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([event_id])
    return stream.dropDuplicates([event_id])


def guarded(stream: DataFrame, key: str, revision: str) -> DataFrame:
    """The stale guard as a stateful operator (E4): (key, revision, outcome); the state is the greatest revision and never expires."""
    kind = stream.schema[key].dataType.simpleString()

    def f(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        for frame in frames:
            mine = frame[revision].to_numpy()
            if not len(mine):
                continue
            before = np.maximum.accumulate(np.concatenate([[mine[0] if top is None else top], mine]))
            yield pd.DataFrame({key: [keys[0]] * len(mine), revision: mine, "outcome": np.where(mine < before[:-1], "stale", "applied")})
            top = int(before[-1])
        if top is not None:
            state.update((top,))

    return stream.groupBy(key).applyInPandasWithState(f, f"{key} {kind}, {revision} long, outcome string", "top long", "append", "NoTimeout")


def apply_batches(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Runs ``apply`` on each micro-batch until the source is drained; a batch may come again after a failure, so it is to be idempotent."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(old: DataFrame | None, batch: DataFrame, key: str, revision: str) -> DataFrame:
    """The table after a batch: the row of the greatest revision of each key; equal revisions take the new row.

    A withdrawal is a row like any other here, a tombstone: an older event that comes later does not revive its key.
    """
    newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(revision, "event_id")).alias("r")).select("r.*")
    if old is None:
        return newest
    kept = old.join(newest.select(key, F.col(revision).alias("__r")), key, "left").where(F.col("__r").isNull() | (F.col("__r") < F.col(revision))).drop("__r")
    fresh = newest.join(old.select(key, F.col(revision).alias("__o")), key, "left").where(F.col("__o").isNull() | (F.col("__o") <= F.col(revision))).drop("__o")
    return kept.unionByName(fresh)


def live(table: DataFrame, kind: str = "kind", withdrawn: str = "withdrawn") -> DataFrame:
    """The rows that readers see: all but tombstones (E5)."""
    return table.where(~F.col(kind).eqNullSafe(withdrawn))


def without_withdrawn(parts: DataFrame, table: DataFrame, key: str, kind: str = "kind", withdrawn: str = "withdrawn") -> DataFrame:
    """Sections or citations without those of withdrawn documents (E5)."""
    gone = table.where(F.col(kind).eqNullSafe(withdrawn)).select(key).distinct()
    return parts.join(gone, key, "left_anti")


def apply_to_table(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str, revision: str) -> Callable[[DataFrame, int], None]:
    """A batch function that puts ``merged`` in place of the table; ``live`` is what readers see of it.

    A row whose ``kind`` is withdrawn removes its key for readers. ``write`` gets the whole new table and is to swap it in at once.
    """

    def apply(batch: DataFrame, _: int) -> None:
        write(merged(read(), batch, key, revision))

    return apply


def with_history(history: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, counts by outcome) after a batch that ``outcomes`` has marked: duplicates are counted but not appended."""
    appended = history.unionByName(marked.where("outcome <> 'ignored_duplicate'").select(*history.columns))
    return appended, marked.groupBy("outcome").agg(F.count("*").alias("n"))
