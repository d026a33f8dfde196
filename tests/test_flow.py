"""Operators whose odd cases no registered query reaches."""

import json
import os

import pytest

from quillon.functions import text as X
from quillon.operators import aggregates, citations, coverage, hierarchy
from quillon.sources import stores
from quillon.streaming import projection


def test_a_withdrawal_removes_a_key_and_an_older_event_does_not_revive_it(spark, tmp_path):
    table = stores.VersionedTable(spark, str(tmp_path / "t"))
    apply = projection.apply_to_table(table.read, table.write, "k", "revision")
    batch = lambda *rows: spark.createDataFrame(rows, "k string, revision long, event_id string, kind string")
    apply(batch(("a", 1, "e1", "upsert"), ("b", 1, "e2", "upsert")), 0)
    apply(batch(("a", 2, "e3", "withdrawn"), ("b", 0, "e4", "withdrawn")), 1)
    apply(batch(("a", 1, "e5", "upsert")), 2)
    assert [r.k for r in projection.live(table.read()).collect()] == ["b"]
    apply(batch(("a", 3, "e6", "upsert")), 3)
    assert sorted(r.k for r in projection.live(table.read()).collect()) == ["a", "b"]
    assert projection.live(projection.merged(None, batch(("c", 1, "e7", "withdrawn")), "k", "revision")).count() == 0


def test_two_writers_do_not_share_a_version(spark, tmp_path):
    table = stores.VersionedTable(spark, str(tmp_path / "t"))
    os.makedirs(tmp_path / "t" / "v=000000001")  # another writer's, unfinished
    assert table.write(spark.range(1).toDF("x")) == 2 and table.read().count() == 1


def test_ancestors_have_no_depth_limit_and_cycles_end(spark):
    tree = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(70)] + [("x", "y"), ("y", "x")], "id string, parent_id string")
    got = {(r.id, r.ancestor): r.distance for r in hierarchy.ancestors(tree).collect()}
    assert got["69", "0"] == 69 and got["x", "y"] == 1 and ("69", "x") not in got
    assert max(r.distance for r in hierarchy.ancestors(tree, 2).collect()) <= 4


def test_edges_stay_as_they_are_where_targets_cannot_be_read(spark):
    edges = spark.createDataFrame([("sr:1", "old")], "citation_key string, target_document_id string")
    assert citations.resolve_on_write(edges, lambda: spark.read.parquet("/nowhere/at/all")) is edges
    targets = spark.createDataFrame([("sr:1", "d", None)], "target_key string, document_id string, section_id string")
    assert citations.resolve_on_write(edges, lambda: targets).first().target_document_id == "d"


def test_the_document_changed_last_counts(spark, tmp_path):
    for i, (name, at) in enumerate([("a", 100), ("b", 300), ("c", 200)]):
        (tmp_path / f"{name}.json").write_text(json.dumps({"document_id": "d", "title": f"t{i}"}))
        os.utime(tmp_path / f"{name}.json", (at, at))
    assert [tuple(r) for r in stores.json_documents(spark, str(tmp_path), "document_id string, title string").collect()] == [("d", "t1")]


def test_percentiles_of_ties_singles_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 7.0), ("c", None)], "k string, v double")
    assert {r.k: (r.p50, r.p90) for r in aggregates.percentiles(df, ["k"], "v", [0.5, 0.9]).collect()} == {"a": (1.0, pytest.approx(3.4)), "b": (7.0, 7.0)}


def test_numbers_of_any_length_and_lists(spark):
    df = spark.createDataFrame([("0",), ("12345678901234",), (" 7 ",), ("-3",), ("x",), (None,), ("1.5",)], "s string").select(X.positive_int("s").alias("n"), X.csv_list("s").alias("l"))
    assert [r.n for r in df.collect()] == [None, 12345678901234, 7, None, None, None, None]
    assert df.where("n IS NULL").collect()[3].l == []


def test_schedules_that_never_fired_are_not_due(spark):
    s = spark.createDataFrame([("a", True, "2024-01-02", None), ("b", True, "2024-01-02", "2024-01-03"), ("c", False, "2024-01-02", None), ("d", True, None, None), ("e", True, "2025-01-01", None)], "id string, enabled boolean, previous_fire string, last_run string")
    from pyspark.sql import functions as F

    assert [r.id for r in coverage.schedules_due(s, F.lit("2024-06-01")).collect()] == ["a"]
