"""Stateful stream operators whose state ends: duplicates and stale revisions within a time to live, and deadlines by timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import AtomicType, BinaryType, LongType, NumericType, StringType, StructField, StructType

#: The state store that timers and times to live need. Checksum files are off: their writers wait for each other where there are fewer threads than partitions.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}
#: Buckets that units are dealt into, each with one state; the bucket of rows without a unit; last sighting of a unit whose rows have no time.
BUCKETS, NO_UNIT, NEVER = 1_024, -1, -(2**62)


def timed_session(spark: SparkSession, idle_batches: bool = True, most_stores: int | None = None) -> SparkSession:
    """A session of the same context whose streams keep state where timers work; the caller's settings stay as they are.

    Without ``idle_batches`` batches run only on new data. State with a time to live needs that where a stream is to end
    once its source is read: it may expire at any time, so there would always be another batch to run.

    Each partition of a stream's state is a store, which takes 4 MB of disk beforehand and a Python process of its own in each
    batch; with ``most_stores`` there are no more. A stream that has begun keeps its partitions.
    """
    own = spark.newSession()
    if most_stores:
        own.conf.set("spark.sql.shuffle.partitions", str(min(most_stores, int(own.conf.get("spark.sql.shuffle.partitions")))))
    for name, value in (STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}).items():
        own.conf.set(name, value)
    return own


class _Guard(StatefulProcessor):
    """The greatest revision of a key and its event ids; each is forgotten ``ttl_ms`` after it was last written.

    Every call of the state is a message to another process, so a key's ids are read as one list and appended as one.
    """

    def __init__(self, key: str, revision: str, event_id: str, arrival: str, ttl_ms: int):
        self.key, self.revision, self.event_id, self.arrival, self.ttl_ms = key, revision, event_id, arrival, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", StructType([StructField("value", LongType())]), self.ttl_ms)
        self.seen = handle.getListState("seen", StructType([StructField("id", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mine, out = sorted(rows, key=lambda r: r[self.arrival]), Row(self.key, self.event_id, self.revision, "outcome")
        held = self.top.get()
        top = held[0] if held else None
        # ``top`` is written last and with every id, so without it no id is left either.
        seen, fresh = {i for (i,) in self.seen.get()} if held else set(), []
        for r in mine:
            event, revision = r[self.event_id], r[self.revision]
            if event in seen:
                yield out(key[0], event, revision, "ignored_duplicate")
                continue
            seen.add(event)
            fresh.append((event,))
            yield out(key[0], event, revision, "stale" if top is not None and revision < top else "applied")
            top = revision if top is None else max(top, revision)
        if fresh:
            self.seen.appendList(fresh)
        if top is not None:
            self.top.update((top,))

    def close(self) -> None:
        pass


def guarded_with_end(stream: DataFrame, key: str, revision: str, event_id: str, arrival: str, ttl_ms: int) -> DataFrame:
    """(key, event id, revision, outcome) as ``projection.outcomes`` says: ignored_duplicate, stale or applied.

    Unlike ``projection.guarded`` the state ends: an event id, and a key's greatest revision, are forgotten once they were
    not written for ``ttl_ms`` of processing time. Within that time results equal the batch operator's; a duplicate
    that comes later counts as new. Event ids are judged within their key. The frame's session is to keep state in
    STORE (``timed_session``).
    """
    schema = StructType([stream.schema[key], stream.schema[event_id], stream.schema[revision], StructField("outcome", StringType())])
    guard = _Guard(key, revision, event_id, arrival, ttl_ms)
    return stream.select(*dict.fromkeys((key, event_id, revision, arrival))).groupBy(key).transformWithState(guard, schema, "Append", "ProcessingTime")


class _Deadlines(StatefulProcessor):
    """When a unit was last seen; a timer reports it if no end comes before its deadline."""

    def __init__(self, unit: str, ends: str, deadline_ms: int):
        self.unit, self.ends, self.deadline_ms = unit, ends, deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ms", LongType()), StructField("ended", LongType()), StructField("timer", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()  # every call of the state is a message to another process
        last, ended, timer = held or (NEVER, 0, None)
        now = False
        for r in rows:
            last, now = max(last, r["seen_ms"]), now or bool(r[self.ends])
        due = max(last + self.deadline_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.last.update((last, int(ended or now), due))
        if now:
            yield self._row(key[0], last, "ended")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, ended, _ = self.last.get()
        self.last.clear()  # the state ends with the deadline, whether the unit ended or not
        if not ended and last != NEVER:
            yield self._row(key[0], last, "overdue")

    def _row(self, key, last: int, verdict: str) -> Row:
        return Row(self.unit, "last_seen", "verdict")(key, None if last == NEVER else last, verdict)

    def close(self) -> None:
        pass


def _by_unit(rows: pd.DataFrame) -> pd.DataFrame:
    """The greatest value of each column for each unit."""
    of, units = pd.factorize(rows["unit"], use_na_sentinel=False)
    out = {"unit": units}
    for name in rows.columns.drop("unit"):
        out[name] = np.full(len(units), NEVER)
        np.maximum.at(out[name], of, rows[name].to_numpy())
    return pd.DataFrame(out)


class _DealtDeadlines(StatefulProcessor):
    """``_Deadlines`` of a bucket of units: its state is one table, with one timer for the first of its deadlines.

    Messages to the state's process are as many as the buckets that a batch meets, however many units they hold.
    """

    def __init__(self, unit: str, deadline_ms: int):
        self.unit, self.deadline_ms = unit, deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("units", BinaryType()), StructField("timer", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        units = _by_unit(pd.concat([_by_unit(f[["unit", "last", "now"]]) for f in rows], ignore_index=True))
        units = units.assign(ended=units["now"], due=NEVER, met=1)
        held, timer = self._read()
        if held is not None:
            units = _by_unit(pd.concat([units, held.assign(now=0, met=0)], ignore_index=True))
        due = np.maximum(units["last"] + self.deadline_ms, timerValues.getCurrentWatermarkInMs() + 1)
        units["due"] = np.where(units["met"] == 1, due, units["due"])
        self._keep(units, timer)
        if (units["now"] == 1).any():
            yield self._rows(key, units[units["now"] == 1], "ended")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        units, _ = self._read()
        past = units["due"] <= timerValues.getCurrentWatermarkInMs()
        self._keep(units[~past], None)  # Spark deletes the timer that fired
        overdue = past & (units["ended"] == 0) & (units["last"] != NEVER)
        if overdue.any():
            yield self._rows(key, units[overdue], "overdue")

    def _read(self) -> tuple[pd.DataFrame | None, int | None]:
        held = self.held.get()
        return (pa.ipc.open_stream(held[0]).read_pandas(), held[1]) if held else (None, None)

    def _keep(self, units: pd.DataFrame, timer: int | None) -> None:
        if units.empty:
            self.held.clear()
            return
        first = int(units["due"].min())
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        table, sink = pa.Table.from_pandas(units[["unit", "last", "ended", "due"]], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(), first))

    def _rows(self, key, units: pd.DataFrame, verdict: str) -> pd.DataFrame:
        unit = units["unit"].to_numpy() if key[0] != NO_UNIT else [None] * len(units)
        last = units["last"].astype("Int64").mask(units["last"] == NEVER)
        return pd.DataFrame({self.unit: unit, "last_seen": last.array, "verdict": verdict})

    def close(self) -> None:
        pass


def deadlines(stream: DataFrame, unit: str, ts: str, ends: str, deadline_ms: int, lateness: str, buckets: int | None = BUCKETS) -> DataFrame:
    """(unit, last_seen, verdict): ``ended`` when an end arrives, ``overdue`` when event time passes a unit's deadline without one.

    The deadline counts from the unit's last sighting and is an event-time timer, so a unit that is never heard of again
    is reported too. A unit's state goes with its deadline. ``ends`` is a boolean column, ``ts`` a timestamp; ``last_seen`` is
    in milliseconds since 1970, and null where no row of a unit has a time, which only its end reports.

    Units are dealt into ``buckets``, and a batch reads and writes the whole state of each bucket that it meets. With None, or
    where units are structs, every unit has a state of its own, for streams of small batches over many units. Results are the same.
    """
    kind = stream.schema[unit].dataType
    schema = StructType([stream.schema[unit], StructField("last_seen", LongType()), StructField("verdict", StringType())])
    seen = F.coalesce(F.unix_millis(ts), F.lit(NEVER))
    if buckets is None or not isinstance(kind, AtomicType):
        timed = stream.select(unit, ts, ends, seen.alias("seen_ms")).withWatermark(ts, lateness)
        return timed.groupBy(unit).transformWithState(_Deadlines(unit, ends, deadline_ms), schema, "Append", "EventTime")
    bucket = F.when(F.col(unit).isNull(), NO_UNIT).otherwise(F.pmod(F.xxhash64(unit), F.lit(buckets)).cast("int"))
    whole = F.coalesce(unit, F.lit(0).cast(kind)) if isinstance(kind, NumericType) else F.col(unit)  # numbers beside a null would be floats in pandas
    dealt = stream.select(bucket.alias("bucket"), whole.alias("unit"), F.col(ts).alias("at"), seen.alias("last"), F.coalesce(F.col(ends), F.lit(False)).cast("long").alias("now"))
    return dealt.withWatermark("at", lateness).groupBy("bucket").transformWithStateInPandas(_DealtDeadlines(unit, deadline_ms), schema, "Append", "EventTime")
