"""Work that has to grow no faster than its input: shapes of plans, and counts of what is read and made."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_schedule_is_read_once_per_row(spark):
    from quillon.operators.cron import previous_fire

    plan = plan_of(previous_fire(spark.range(3).select(F.lit("0 4 * * 7").alias("cron"), F.timestamp_seconds("id").alias("t"), "id"), "cron", F.col("t")).where("previous_fire IS NOT NULL"))
    assert len(plan) < 100_000


@pytest.mark.parametrize("order", ["ascending", "shuffled"])
def test_pages_read_a_table_about_once(tmp_path, monkeypatch, order):
    import pyarrow.dataset as ds

    from quillon.sources import enumeration

    keys = np.arange(20_000) * 3
    keys = np.random.default_rng(1).permutation(keys) if order == "shuffled" else keys
    pq.write_table(pa.table({"k": keys, "v": keys + 1}), tmp_path / "t.parquet", row_group_size=1_000)
    reads, opened = [], ds.dataset

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            if name in ("to_table", "get_fragments"):
                reads.append(name)
            return getattr(self.inner, name)

    monkeypatch.setattr(ds, "dataset", lambda path: Counted(opened(path)))

    def pages(upto):
        pager, cursor, out = enumeration.parquet_pager(str(tmp_path / "t.parquet"), "k", ["v"]), -1, []
        while page := pager(cursor, upto, 100):
            out += page
            cursor = page[-1][0]
        return out

    assert pages(None) == [(k, k + 1) for k in range(0, 60_000, 3)]
    assert pages(30_001) == [(k, k + 1) for k in range(0, 30_001, 3)]
    assert len(reads) <= 4  # 300 pages


def test_looking_ahead_by_less_than_the_table(tmp_path):
    from quillon.sources import enumeration

    keys = np.random.default_rng(2).permutation(5_000)
    pq.write_table(pa.table({"k": keys, "v": keys * 2}), tmp_path / "t.parquet", row_group_size=300)
    pager, cursor, out = enumeration.parquet_pager(str(tmp_path / "t.parquet"), "k", ["v"], ahead=700), -1, []
    while page := pager(cursor, None, 130):
        out += page
        cursor = page[-1][0]
    assert out == [(k, 2 * k) for k in range(5_000)]
    assert pager(10, None, 3) == [(11, 22), (12, 24), (13, 26)]


def test_a_long_range_is_walked_in_pieces(spark):
    from quillon.sources import enumeration

    def pager(after, upto, size):
        return [(k, "v") for k in range(after + 1, 101 if upto is None else upto + 1)][:size]

    schema = spark.createDataFrame([], "k long, v string").schema
    enumeration.register(spark, "pieces_a", pager, schema, [0, 40], size=7, cuts=[-5, 20, 40, 60, 80])
    walked = spark.read.format("pieces_a").load()
    assert walked.rdd.getNumPartitions() == 5
    assert [tuple(r) for r in enumeration.walks_of(walked).orderBy("walk").collect()] == [(0, 40, "40", True), (1, 60, "100", True)]
    enumeration.register(spark, "pieces_b", pager, schema, [0], size=7, most_pages=2, cuts=[10])
    assert [tuple(r) for r in enumeration.walks_of(spark.read.format("pieces_b").load()).collect()] == [(0, 24, "24", False)]
    assert enumeration.cuts_of(spark.range(1_000).withColumnRenamed("id", "k"), "k", 300) == pytest.approx([299, 599, 899], abs=20)


def test_blocks_of_markdown_are_made_once_per_line(spark):
    from quillon.operators import normalise

    plan = plan_of(spark.range(1).select(normalise.markdown_blocks(F.concat(F.lit("# t"), F.col("id"))).alias("b")))
    assert plan.count("split(") == 1


def test_sections_of_markdown_with_levels_in_any_order(spark):
    from quillon.operators import normalise

    text = "before\n# T\nintro\n### c\n\n## b\nx\n#### d\ny\n- z\n# e\n## f\nw"
    made = normalise.sections(spark.createDataFrame([(1, text), (2, "only\ntext"), (3, ""), (4, None)], "k int, md string").select("k", normalise.markdown_blocks(F.col("md")).alias("blocks")), "k")
    got = [tuple(r) for r in made.select("k", "ordinal", "title", "depth", "content", F.array_join("ancestors", "/")).orderBy("k", "ordinal").collect()]
    assert got == [(1, 0, "c", 2, "before\n\nintro", ""), (1, 1, "b", 1, "x", ""), (1, 2, "d", 3, "y\n\nz", "b"), (1, 3, "f", 1, "w", "e"), (2, 0, "Body", 0, "only\n\ntext", "")]
    assert "posexplode" not in plan_of(made)  # no row for each block


@pytest.mark.parametrize("features, weights", [(6, [0.5, 1.0]), (5_000, [0.5, 1.0]), (6, [0.5, -0.5, float("inf")])])
def test_products_in_blocks_equal_a_join_and_make_no_pair_in_a_shuffle(spark, monkeypatch, features, weights):
    from quillon.operators import sparse

    monkeypatch.setattr(sparse, "DOC_ENTRIES", 300)
    monkeypatch.setattr(sparse, "QUERY_ENTRIES", 100)
    rng = np.random.default_rng(3)

    def side(n, name):
        made = [(i, f"t{f}", float(rng.choice(weights))) for i in range(n) for f in rng.integers(0, features, 5)]  # a feature may come twice
        return spark.createDataFrame(made, f"{name} long, feature string, weight double")

    q, d = side(40, "query_id"), side(200, "doc_id")
    joined = q.join(d.withColumnRenamed("weight", "w"), "feature").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("score"))
    want = sorted((tuple(r) for r in joined.collect()), key=str)
    plain = [str(r) for r in want]  # NaN equals itself so
    assert sorted(str(tuple(r)) for r in sparse.dot(q, d).withColumn("score", F.round("score", 6)).collect()) == plain
    assert "Join" not in plan_of(sparse.dot(q, d))
    if min(weights) > 0:
        kept = sparse.products(q, d, 3).groupBy("query_id").agg(F.sum("scored").alias("n"), F.max("score").alias("top"))
        by = {}
        for i, _, x in want:
            by.setdefault(i, []).append(x)
        assert {r.query_id: (r.n, r.top) for r in kept.collect()} == {i: (len(x), max(x)) for i, x in by.items()}


@pytest.mark.parametrize("values", [10, 2_000, 10**6])
def test_scores_in_ranges_are_those_of_a_join(spark, monkeypatch, values):
    from quillon.operators import sparse

    monkeypatch.setattr(sparse, "DOC_ENTRIES", 400)
    monkeypatch.setattr(sparse, "CELLS", 500)
    monkeypatch.setattr(sparse, "VALUES", values)
    rng = np.random.default_rng(5)

    def side(n, name):
        made = [(i, f"t{f}", float(rng.choice([0.5, 1.0]))) for i in range(n) for f in rng.integers(0, 8, 5)]
        return spark.createDataFrame(made, f"{name} long, feature string, weight double")

    q, d = side(40, "query_id"), side(200, "doc_id")
    want = q.join(d.withColumnRenamed("weight", "w"), "feature").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("w")), 3).alias("score"))
    made = sparse.dot(q, d, 3)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    assert made.rdd.getNumPartitions() == 3  # a block each, of 1,000 entries
    table, all_of = np.arange(10_001.0).reshape(1, -1) / 1_000, np.ones((1, 10_001), dtype=bool)
    assert [len(c) if (c := sparse._cuts(table, x, 3)) is not None else None for x in (all_of, ~all_of)] == [{10: None, 2_000: 4, 10**6: 0}[values], None]
    assert sparse._cuts(np.array([[np.nan, 1.0]]), np.ones((1, 2), dtype=bool), 3) is None


def test_all_scores_take_little_room_in_files(spark, tmp_path):
    from quillon.operators import sparse

    rng = np.random.default_rng(7)

    def side(n, name):
        e = 0.1 + 0.05 * rng.random((n, 8))
        return spark.createDataFrame(pa.table({name: np.repeat(np.arange(n), 8), "feature": [f"t{f}" for f in range(8)] * n, "weight": e.ravel()}).to_pandas())

    q, d = side(500, "query_id"), side(2_000, "doc_id")
    sparse.dot(q, d, 6).write.parquet(str(tmp_path / "s"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "s").glob("*.parquet")]
    groups = [f.row_group(g) for f in files for g in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 1_000_000
    assert all(any("DICT" in e for e in g.column(2).encodings) for g in groups if g.num_rows)
    assert sum(g.column(j).total_compressed_size for g in groups for j in range(3)) < 6_000_000  # a score that is written plainly takes eight bytes alone


def test_links_to_many_leasts_become_links_to_one_and_connect_the_same(spark):
    from quillon.llm import confirm
    from quillon.llm.components import components

    rng = np.random.default_rng(6)
    star = [(a, b) for a in range(10) for b in range(20, 320)]  # near copies under ten keys of different tasks
    loose = [tuple(sorted(x)) for x in rng.integers(1_000, 1_400, (200, 2)).tolist() if x[0] != x[1]]
    links = spark.createDataFrame(star + loose, "a long, b long")
    fewer = confirm._to_least(links)
    assert fewer.where("a < 1000").count() <= 310
    assert fewer.where("a >= b").count() == 0
    assert sorted(components(fewer).collect()) == sorted(components(links).collect())


def test_tokens_are_counted_within_their_row(spark):
    from collections import Counter

    from quillon.operators import search_index as si

    made = [(0, []), (1, ["b"]), (2, ["b", "a", "b", "", "ä", "a", "b"]), (3, None), (4, ["x"] * 5)]
    df = spark.createDataFrame(made, "i int, t array<string>").select("i", si.counted(F.col("t")).alias("c"))
    assert {r.i: r.c and {x.token: x.tf for x in r.c} for r in df.collect()} == {i: t and dict(Counter(t)) for i, t in made} | {0: []}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_word_has_three_keys_and_meets_all_within_two_edits(spark, tmp_path):
    import random

    from quillon.operators import search_index as si

    rng = random.Random(4)
    words = sorted({"ab" + "".join(rng.choice("abé") for _ in range(rng.randint(0, 12))) for _ in range(150)} | {"a", "ab"})
    w = spark.createDataFrame([(x,) for x in words], "w string")
    stored, asked = w.select("w", F.explode(si.word_keys(F.col("w"))).alias("k")), w.select(F.col("w").alias("q"), F.explode(si.lookup_keys(F.col("w"))).alias("k"))
    assert stored.groupBy("w").count().agg(F.max("count")).first()[0] <= 3  # the deletions of a word of twelve letters are fifty-six
    met = {(r.w, r.q) for r in stored.join(asked, "k").select("w", "q").distinct().collect()}
    near = {(r.w, r.q) for r in w.crossJoin(w.withColumnRenamed("w", "q")).where((F.substring("w", 1, 2) == F.substring("q", 1, 2)) & (F.levenshtein("w", "q") <= 2)).collect()}
    assert len(near) > 500 and near <= met


def test_an_index_is_whole_without_what_it_was_cut_from(spark, tmp_path):
    from quillon.operators.search_index import SearchIndex

    docs = spark.createDataFrame([(i, "gesetz und recht " * (1 + i % 3), None if i % 2 else "recht") for i in range(40)], "id long, t string, u string")
    index = SearchIndex.build(docs, "id", ["t", "u"], str(tmp_path / "i"), tile_rows=4, buckets=4)
    p = index.blocks.select("field", "token", F.explode("postings").alias("p")).groupBy("field", "token").agg(F.count("*").alias("n"), F.sum("p.tf").alias("tf"), F.count_distinct("p.doc").alias("docs"))
    assert sorted(tuple(r) for r in p.collect()) == [("t", w, 40, 79, 40) for w in ("gesetz", "recht", "und")] + [("u", "recht", 20, 20, 20)]
    assert sorted(x.name for x in (tmp_path / "i").iterdir()) == ["blocks", "meta", "near"]


def test_mentions_shuffle_no_token_and_equal_those_of_many_places(spark, monkeypatch):
    from quillon.operators import search

    texts = spark.createDataFrame([(1, "Kanton Zug und das Kanton von Zug am See"), (2, "zug zg ZG Basel Land Kanton"), (3, None), (4, "zug")], "id long, t string")
    places = spark.createDataFrame([("a", ["zug"], "ZG"), ("b", ["basel", "land"], None), ("c", [], "see"), ("d", None, "zug"), ("e", ["zug", "am"], "none")], "place string, label array<string>, code string")
    made = search.mentioned(texts, "id", "t", places, ("kanton",))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    got = sorted(tuple(r) for r in made.collect())
    assert got == [(1, "a", 1, "label"), (1, "a", 6, "label"), (1, "c", 8, "code"), (1, "d", 1, "code"), (1, "d", 6, "code"), (1, "e", 6, "label"),
                   (2, "a", 1, "code"), (2, "a", 2, "code"), (2, "b", 3, "label"), (2, "d", 0, "code"), (4, "d", 0, "code")]
    monkeypatch.setattr(search, "VOCABULARY_ROWS", 1)
    assert sorted(tuple(r) for r in search.mentioned(texts, "id", "t", places, ("kanton",)).collect()) == got


def test_artifacts_are_joined_by_source_alone(spark, monkeypatch):
    from quillon.plans import control_plane

    captured = spark.createDataFrame([(i, i % 7, f"1998-0{1 + i % 9}-01") for i in range(60)], "artifact long, source_id long, d string").select("artifact", "source_id", F.to_timestamp("d").alias("fetched_at"))
    sources = spark.createDataFrame([(0, "x"), (1, "x"), (1, "y"), (2, "z"), (3, None), (4, "y")], "source_id long, jurisdiction_id string")
    places = spark.createDataFrame([("x", "short"), ("y", "long"), ("z", None)], "jurisdiction_id string, compliance_policy_id string")
    policies = spark.createDataFrame([("short", 200), ("long", 300)], "policy_id string, retention_days int")
    now = F.lit("1999-01-01").cast("timestamp")
    joined = captured.join(sources, "source_id").join(places, "jurisdiction_id").join(policies, F.col("compliance_policy_id") == F.col("policy_id"))
    want = sorted(tuple(r) for r in joined.where(F.col("fetched_at") < now - F.make_dt_interval("retention_days")).select("artifact", "source_id").collect())
    for most in (500_000, 1):
        monkeypatch.setattr(control_plane, "BROADCAST_SOURCES", most)
        made = control_plane.expired_artifacts(captured, sources, places, policies, now)
        assert sorted(tuple(r) for r in made.select("artifact", "source_id").collect()) == want and want
        top = next(x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
        assert "source_id" in top and "policy_id" not in top and "jurisdiction_id" not in top


@pytest.mark.parametrize("seed", [0, 1])
def test_citations_are_counted_by_key_before_they_meet_documents(spark, seed):
    from quillon.operators import citations

    rng = np.random.default_rng(seed)
    pick = lambda n, top: [None if x == 0 else int(x) for x in rng.integers(0, top, n)]
    edges = spark.createDataFrame(list(zip(pick(300, 30), pick(300, 8), strict=True)), "source_document_id long, k long").select("source_document_id", F.concat(F.lit("k"), "k").alias("citation_key"))
    made = list(zip(pick(30, 8), pick(30, 30), strict=True)) if seed else [(1 + i % 7, 1 + i) for i in range(28)]  # some documents of several keys, or none
    targets = spark.createDataFrame(made + made[:3], "k long, document_id long").select(F.concat(F.lit("k"), "k").alias("target_key"), "document_id")
    named = edges.join(targets.distinct().withColumnRenamed("target_key", "citation_key"), "citation_key").where(~F.col("source_document_id").eqNullSafe(F.col("document_id")))
    want = named.groupBy("document_id").agg(F.count("*").alias("n"), F.count_distinct("source_document_id").alias("s"))
    got = citations.cited_by(edges, targets)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    if not seed:  # documents of one key meet sums alone
        plan = plan_of(got)
        assert "Expand" not in plan and "document_id" not in "".join(x for x in plan.splitlines() if "count(distinct" in x)


class _Handle:
    """A state handle that counts its calls; each is a message to another process."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def _state(self, name, *_):
        outer = self

        class State:
            def get(self):
                outer.calls += 1
                return iter(outer.held.get(name, [])) if name == "seen" else outer.held.get(name)

            def update(self, value):
                outer.calls += 1
                outer.held[name] = value

            def appendList(self, values):
                outer.calls += 1
                outer.held.setdefault(name, []).extend(values)

            def clear(self):
                outer.calls += 1
                outer.held.pop(name, None)

        return State()

    getValueState = getListState = _state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_a_key_takes_few_calls_of_the_state_however_many_events_it_has():
    from pyspark.sql import Row

    from quillon.streaming import timed

    handle, guard = _Handle(), timed._Guard("k", "r", "e", "e", 1_000)
    guard.init(handle)
    event = Row("k", "e", "r")
    first = list(guard.handleInputRows((1,), iter([event(1, i, i % 10) for i in range(500)]), None))
    assert [x.outcome for x in first[:12]] == ["applied"] * 10 + ["stale"] * 2 and handle.calls == 3
    again = list(guard.handleInputRows((1,), iter([event(1, 7, 9), event(1, 900, 8), event(1, 901, 9)]), None))
    assert [x.outcome for x in again] == ["ignored_duplicate", "stale", "applied"] and handle.calls == 7


def test_a_unit_takes_three_calls_of_the_state_and_keeps_one_timer():
    from types import SimpleNamespace

    from pyspark.sql import Row

    from quillon.streaming import timed

    handle, unit, seen = _Handle(), timed._Deadlines("u", "x", 100), Row("u", "seen_ms", "x")
    unit.init(handle)
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    assert list(unit.handleInputRows((1,), iter([seen(1, 30, False), seen(1, 20, None)]), at)) == []
    assert handle.calls == 3 and handle.timers == {130}
    assert [tuple(r) for r in unit.handleInputRows((1,), iter([seen(1, 50, True)]), at)] == [(1, 50, "ended")] and handle.timers == {150}
    assert list(unit.handleInputRows((1,), iter([seen(1, 40, False)]), at)) == [] and handle.timers == {150}
    assert list(unit.handleExpiredTimer((1,), at, None)) == [] and "last" not in handle.held


def test_a_bucket_of_units_takes_few_calls_of_the_state_however_many_it_has():
    from types import SimpleNamespace

    import pandas as pd

    from quillon.streaming import timed

    handle, bucket = _Handle(), timed._DealtDeadlines("u", 100)
    bucket.init(handle)
    at = lambda w: SimpleNamespace(getCurrentWatermarkInMs=lambda: w)
    rows = lambda units, last, now: pd.DataFrame({"bucket": 0, "unit": units, "at": pd.NaT, "last": last, "now": now})
    assert list(bucket.handleInputRows((0,), iter([rows(range(700), range(700), 0), rows(range(500, 900), range(500, 900), 0)]), at(0))) == []
    assert handle.calls == 3 and handle.timers == {100}
    (ended,) = bucket.handleInputRows((0,), iter([rows([0, 5, 0], [40, 3, 30], [0, 1, 1])]), at(0))
    assert sorted(ended.itertuples(index=False, name=None)) == [(0, 40, "ended"), (5, 5, "ended")] and handle.calls == 7 and handle.timers == {101}
    (overdue,) = bucket.handleExpiredTimer((0,), at(199), None)
    assert sorted(overdue.itertuples(index=False, name=None)) == [(i, i, "overdue") for i in range(1, 100) if i != 5] and 200 in handle.timers
    (overdue,) = bucket.handleExpiredTimer((0,), at(5_000), None)
    assert len(overdue) == 800 and "held" not in handle.held


def test_a_stream_has_no_more_stores_than_asked_for(spark):
    from quillon.streaming import timed

    partitions = lambda most: timed.timed_session(spark, True, most).conf.get("spark.sql.shuffle.partitions")
    assert [partitions(m) for m in (2, 100, None)] == ["2", "4", "4"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_units_in_buckets_give_what_a_state_for_each_gives(spark, tmp_path, kind):
    import json
    import os
    from datetime import datetime, timedelta

    from quillon.streaming import timed

    own, rng = timed.timed_session(spark), np.random.default_rng(8)
    (tmp_path / "in").mkdir()
    for b in range(5):  # whole hours, so that deadlines meet watermarks; rows that come late, without a unit or without an end
        hours, units, ends = 10 * b + rng.integers(-6, 10, 60), rng.integers(0, 40, 60), rng.integers(0, 12, 60)
        made = [{"u": None if u == 0 else 2**60 + int(u), "ts": (datetime(2024, 1, 1) + timedelta(hours=int(h))).isoformat(), "e": None if e == 1 else bool(e == 0)} for u, h, e in zip(units, hours, ends, strict=True)]
        f = tmp_path / "in" / f"{b}.json"
        f.write_text("".join(json.dumps(x) + "\n" for x in made))
        os.utime(f, (1_700_000_000 + b, 1_700_000_000 + b))
    got = []
    for buckets in (None, 3):
        stream = own.readStream.schema(f"u {kind}, ts timestamp, e boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = timed.deadlines(stream, "u", "ts", "e", 7 * 3_600_000, "1 hour", buckets)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / f"out{buckets}")).option("checkpointLocation", str(tmp_path / f"ck{buckets}")).trigger(availableNow=True).start()
        q.awaitTermination()
        got.append(sorted(map(str, map(tuple, spark.read.parquet(str(tmp_path / f"out{buckets}")).collect()))))
    assert got[0] == got[1] and sum("overdue" in x for x in got[0]) > 10 and sum("ended" in x for x in got[0]) > 5 and any("None" in x for x in got[0])
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 4 * 3  # a state and a timer, which is indexed, for each bucket


def test_files_of_a_merged_table_are_named_without_a_regular_expression(spark, tmp_path):
    from quillon.sources.merge_table import MergeTable

    held = MergeTable(spark, str(tmp_path / "t"), "k", "r", "k", buckets=2)
    held.upsert(spark.range(20).select(F.col("id").alias("k"), F.lit(1).alias("r")))
    rows = held._rows(held.state())
    assert "regexp" not in plan_of(rows)  # one that goes back over a path's letters took some 50 microseconds a row
    assert {f.count("/") for (f,) in rows.select("__file").distinct().collect()} == {1}
