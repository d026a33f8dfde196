"""A table that is merged when it is read: data files, bitmaps of deleted rows, and a log that names what counts.

A batch appends its new rows and, for the rows that they replace, bitmaps over the row numbers of the files that hold
them; no data file is ever written again. A commit is one new file in the log, which exists either whole or not at
all; files that no commit names are not read. Compaction writes the live rows anew as one more commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that rows are dealt into by a hash of the key; a batch looks for its keys only in theirs.
BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer made the commit of this number."""


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _is_set(bitmap: Column, position: Column) -> Column:
    """Is the bit at ``position`` set; a bitmap's first bit is the lowest of its first byte."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftrightunsigned", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


class MergeTable:
    """Rows with one key and a revision; the greatest revision of a key counts, of equal ones the later row."""

    def __init__(self, spark: SparkSession, path: str, key: str, revision: str, order: str = "event_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.revision, self.order, self.buckets = spark, path, key, revision, order, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._fs(f"{self.path}/log")
        return sorted(int(n[:-5]) for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()) if fs.exists(p) else []

    def state(self) -> dict:
        """What the newest commit names: its ``number``, ``data`` and ``deletes`` folders, and the last batch applied."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "data": [], "deletes": [], "batch": None}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/log/{numbers[-1]:012d}.json").collect()))

    def _commit(self, state: dict) -> None:
        """Puts the log's next file in place at once; it exists already if another writer was faster."""
        jvm = self.spark._jvm
        made, fs = self._fs(f"{self.path}/log/{uuid.uuid4().hex}.part")
        out = fs.create(made)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target, _ = self._fs(f"{self.path}/log/{state['number']:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, target, options)  # without overwriting
        except Exception as x:
            if "FileAlreadyExists" in str(x):
                raise Conflict(f"commit {state['number']} is there") from x
            raise

    def _rows(self, state: dict, only: Sequence[int] | None = None) -> DataFrame | None:
        """The live rows with ``__file`` (with its folder: a task's files have one name in all of them) and ``__row``; of ``only`` these buckets where they are given."""
        if not state["data"]:
            return None
        data = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{d}" for d in state["data"]])
        if only is not None:
            data = data.where(F.col("__bucket").isin(*only))
        data = data.select("*", F.substring_index("_metadata.file_path", "/", -2).alias("__file"), F.col("_metadata.row_index").alias("__row")).drop("commit", "__bucket")
        if not state["deletes"]:
            return data
        gone = self.spark.read.parquet(*[f"{self.path}/deletes/{d}" for d in state["deletes"]]).groupBy("file", "part").agg(F.bitmap_or_agg("rows").alias("__gone"))
        part, place = F.bitmap_bucket_number("__row"), F.bitmap_bit_position("__row")
        joined = data.join(gone, (F.col("__file") == F.col("file")) & (part == F.col("part")), "left")
        return joined.where(F.col("__gone").isNull() | ~_is_set(F.col("__gone"), place)).drop("file", "part", "__gone")

    def read(self) -> DataFrame | None:
        """The live rows, withdrawals among them; nothing before the first commit."""
        rows = self._rows(self.state())
        return None if rows is None else rows.drop("__file", "__row")

    def _write(self, state: dict, fresh: DataFrame, replaced: DataFrame | None, batch: int | None) -> None:
        name = f"commit={state['number'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        fresh.withColumn("__bucket", _bucket(self.key, self.buckets)).repartition(self.buckets, "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        new = {"number": state["number"] + 1, "data": [*state["data"], name], "deletes": list(state["deletes"]), "batch": state["batch"] if batch is None else batch}
        if replaced is not None:
            marked = replaced.groupBy(F.col("__file").alias("file"), F.bitmap_bucket_number("__row").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__row")).alias("rows"))
            marked.write.parquet(f"{self.path}/deletes/{name}")
            new["deletes"].append(name)
        self._commit(new)

    def _held(self, state: dict, keys: DataFrame) -> DataFrame | None:
        """The live rows of these keys, from the keys' folders alone."""
        folders = [r[0] for r in keys.select(_bucket(self.key, self.buckets)).distinct().collect()]  # at most BUCKETS
        rows = self._rows(state, folders) if folders else None
        return None if rows is None else rows.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def upsert(self, batch: DataFrame, number: int | None = None) -> bool:
        """Applies a batch: its row of the greatest revision of each key, unless the table's is greater.

        What is written grows with the batch, not with the table. A batch whose ``number`` was applied before, as after
        a failure, changes nothing; returns whether it was applied.
        """
        state = self.state()
        if number is not None and state["batch"] is not None and number <= state["batch"]:
            return False
        newest = batch.groupBy(self.key).agg(F.max_by(F.struct(*batch.columns), F.struct(self.revision, self.order)).alias("r")).select("r.*")
        held = self._held(state, newest)
        if held is None:
            self._write(state, newest, None, number)
            return True
        old = held.select(self.key, F.col(self.revision).alias("__old"), "__file", "__row")
        both = newest.select(self.key, F.col(self.revision).alias("__new")).join(old, self.key)
        fresh = newest.join(old.groupBy(self.key).agg(F.max("__old").alias("__old")), self.key, "left").where(F.col("__old").isNull() | (F.col("__old") <= F.col(self.revision))).drop("__old")
        self._write(state, fresh, both.where(F.col("__old") <= F.col("__new")), number)
        return True

    def patch(self, rows: DataFrame, columns: Sequence[str]) -> None:
        """New values of some columns, where given, in the rows of these keys (S25); keys that the table lacks are passed over."""
        state = self.state()
        held = self._held(state, rows)
        if held is None:
            return
        new = rows.select(self.key, *[F.col(c).alias(f"__{c}") for c in columns])
        changed = held.join(new, self.key)
        fresh = changed.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in held.columns if c not in ("__file", "__row")])
        self._write(state, fresh, changed.select("__file", "__row"), None)

    def delete(self, keys: DataFrame) -> None:
        """The rows of these keys are gone."""
        state = self.state()
        held = self._held(state, keys)
        if held is not None:
            self._write(state, held.drop("__file", "__row").limit(0), held.select("__file", "__row"), None)

    def compact(self) -> None:
        """Writes the live rows anew, without deletions; readers see no change. Old files stay until ``vacuum``."""
        state = self.state()
        rows = self._rows(state)
        if rows is not None:
            self._write(state | {"data": [], "deletes": []}, rows.drop("__file", "__row"), None, None)

    def vacuum(self) -> None:
        """Removes the folders that the newest commit does not name; no reader of an older commit and no writer may be at work."""
        state = self.state()
        for kind in ("data", "deletes"):
            p, fs = self._fs(f"{self.path}/{kind}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in state[kind]:
                    fs.delete(s.getPath(), True)
