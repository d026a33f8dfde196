"""Set operations, generators and the smaller aggregates."""

from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import aggregates, data_quality, hierarchy, sets


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_unions_and_first_rows(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "z"), (2, "y")], "k int, v string")
    assert values(sets.union_by_id([a, b], "k", "v"), "k", "v") == [(1, "a"), (2, "y")]
    assert values(sets.first_occurrences(b, ["k"], "v"), "k", "v") == [(1, "b"), (2, "y")]


def test_preferred_falls_back_to_all(spark):
    df = spark.createDataFrame([("d1", "fr", 1), ("d1", "de", 2), ("d1", "de", 3), ("d1", "en", 4), ("d2", "en", 5), ("d2", "it", 6)], "d string, l string, i int")
    assert values(sets.preferred(df, ["d"], "l", ["de", "fr"], 2, "i"), "d", "i", "place") == [("d1", 1, 2), ("d1", 2, 1), ("d2", 5, 1), ("d2", 6, 2)]


def test_names_and_json(spark):
    df = spark.createDataFrame([("Bühl (BE)/Buhl", '{"a": 1, "b": [{"a": 2, "c": "x"}], "d": "y"}'), (None, "junk")], "n string, j string")
    forms = df.select(sets.name_forms(F.col("n")).alias("f")).first().f
    assert {"Bühl", "Buhl", "buehl", "buhl"} <= set(forms)
    assert sorted((r.x for r in df.select(sets.without_keys(F.col("j"), ["a"]).alias("x")).collect()), key=repr) == ['{"b":[{"c":"x"}],"d":"y"}', None]
    assert values(sets.plain_text(df, "j"), "plain_text") == [("x\ny",), (None,)]


def test_flattened_records(spark):
    df = spark.createDataFrame([("d", ["r"], [(["s", "t"],), (["u"],)])], "k string, own array<string>, parts array<struct<refs:array<string>>>")
    assert values(sets.flattened(df, "k", "own", "parts", "refs"), "part", "record") == [(0, "s"), (0, "t"), (1, "u"), (None, "r")]


def test_shards_modes_and_observation(spark):
    df = spark.createDataFrame([("r", {"a": (1, 2), "b": (3, 0)}), ("q", {})], "k string, m map<string,struct<done:int,failed:int>>")
    assert values(aggregates.shard_totals(df, "k", "m"), "k", "done", "failed") == [("q", 0, 0), ("r", 4, 2)]
    v = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None)], "k string, v string")
    assert values(aggregates.modal(v, ["k"], "v"), "v", "n") == [("a", 1)]
    watched, seen = aggregates.observed(v, "stage")
    watched.collect()
    assert seen.get == {"rows": 3}


def test_types_places_and_scopes(spark):
    df = spark.createDataFrame([(" Urteil ", None, "ZH"), (None, "Merkblatt", "jur_ch_be")], "e string, h string, p string")
    assert values(df.select(text.document_type("e", "h").alias("t"), text.jurisdiction({"zh": "jur_ch_zh"}, "p").alias("j")), "t", "j") == [("decision", "jur_ch_zh"), ("merkblatt", "jur_ch_be")]
    tree = spark.createDataFrame([("ch", None, "federal"), ("zh", "ch", "cantonal")], "id string, parent_id string, level string")
    named = spark.createDataFrame([("q", "zh")], "query_id string, place string")
    assert values(hierarchy.preferred_scopes(named, hierarchy.governing_scopes(tree)), "scope") == [("ch",), ("zh",)]


def test_document_rules(spark):
    df = spark.createDataFrame([("doc_" + "0" * 26, 1, "t", "b", "active"), ("x", 0, " ", None, "gone")], "document_id string, document_revision int, title string, body_text string, lifecycle_status string")
    assert {r.failures for r in data_quality.row_rules(df, data_quality.document_rules()).collect()} == {1}
