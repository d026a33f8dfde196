"""Stored index, merge on read, timed state, closure, sparse retrieval, mentions, cron, enumeration, ledger and point reads."""

import itertools
import json
import math
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import citations, coverage, hierarchy, joins, search, sparse
from quillon.operators import search_index as si
from quillon.operators.cron import previous_fire
from quillon.operators.ledger import StageLedger
from quillon.operators.search_index import SearchIndex
from quillon.plans.state_queries import _sparse
from quillon.sources import enumeration, stores
from quillon.sources.merge_table import Conflict, MergeTable
from quillon.streaming import projection, timed
from tests.conftest import MEDIUM, SMALL


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def made_texts(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["gesetz", "gesetze", "recht", "rechte", "tierschutz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 40, 300]))) if i % 17 else None, rng.choice(words)) for i in range(n)]


def scored_plainly(texts, tokens, weights):
    """Every posting scored: the best weighted field's BM25 of each document."""
    best = {}
    for f, weight in weights.items():
        cut = {i: (t[f] or "").split() for i, t in texts.items()}
        n, average = len(cut), sum(map(len, cut.values())) / len(cut)
        df = {t: sum(t in ws for ws in cut.values()) for t in set(tokens)}
        for i, ws in cut.items():
            parts = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / average)) for t in set(tokens) if t in ws]
            if parts:
                best[i] = max(best.get(i, 0), weight * sum(parts))
    return best


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "x")
    made = made_texts(3000)
    docs = spark.createDataFrame(made, "id long, body string, title string")
    return SearchIndex.build(docs, "id", ["body", "title"], path, tile_rows=16, buckets=8), {i: {"body": b, "title": t} for i, b, t in made}


@pytest.mark.parametrize("tokens,k", [(["w0"], 5), (["w3", "w40"], 10), (["gesetz", "w1", "w50"], 20), (["none"], 5), (["tierschutz", "none", "tierschutz"], 3)])
def test_top_k_equals_scoring_every_posting(index, tokens, k):
    idx, texts = index
    weights = {"body": 1.0, "title": 3.0}
    plain = scored_plainly(texts, tokens, weights)
    want = sorted(((round(-s, 9), i) for i, s in plain.items()))[:k]
    got = [(round(-r.score, 9), r.doc) for r in idx.top(tokens, k, weights).collect()]
    assert got == want


def test_top_k_reads_only_files_of_its_tokens_and_skips_tiles(index):
    idx, _ = index
    hits = idx.of(["w3", "w40"])
    folders = {os.path.basename(os.path.dirname(f)) for f in hits.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert folders <= {f"bucket={si.bucket_of(t, 8)}" for t in ("w3", "w40")}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(token" in plan or "In(token" in plan
    bounds = hits.groupBy("field", "tile").count()
    top = idx.top(["w3", "w40"], 3, {"body": 1.0, "title": 3.0})
    read = top._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < read.count(",") and bounds.count() > 20  # the scan names the few tiles that may reach the best


def test_near_words_equal_levenshtein_over_the_vocabulary(spark, index):
    idx, _ = index
    vocabulary = idx.blocks.select("token").distinct()
    asked = ["gesets", "gesetz", "w1", "rect", "rechtt", "tierschuts", "ierschutz", "w", "", "xx"]
    got = rows(idx.near_words(asked), "token", "query")
    assert got == rows(search.fuzzy_tokens(vocabulary, [t for t in asked if t]), "token", "query")
    assert ("gesetze", "gesets") in got


def test_near_words_of_long_and_short_ones(spark, tmp_path):
    rng = random.Random(1)
    words = ["a", "ab", "abc", "ab" + "x" * 22, "ab" + "x" * 23, "ab" + "x" * 24, "ab" + "x" * 25, "ab" + "x" * 26, "ab" + "x" * 27, "ab" + "x" * 40]
    words += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(150)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, t string")
    idx = SearchIndex.build(docs, "id", ["t"], str(tmp_path / "i"), buckets=4)
    assert rows(idx.near_words(words), "token", "query") == rows(search.fuzzy_tokens(idx.blocks.select("token").distinct(), sorted(set(words))), "token", "query")


def test_index_is_kept_until_its_files_change(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "ein gesetz"), (2, "kein recht")], "id long, t string").write.parquet(path)
    read = lambda: spark.read.parquet(path)
    first = SearchIndex.current(read(), "id", ["t"], "x")
    assert SearchIndex.current(read(), "id", ["t"], "x").path == first.path
    spark.createDataFrame([(3, "gesetz")], "id long, t string").write.mode("append").parquet(path)
    second = SearchIndex.current(read(), "id", ["t"], "x")
    assert second.path != first.path and second.documents == 3
    # An index that was cut off has no marker and is made anew.
    os.remove(os.path.join(second.path.removeprefix("file:"), "meta", "_SUCCESS"))
    assert SearchIndex.current(read(), "id", ["t"], "x").documents == 3
    assert [r.doc for r in SearchIndex.current(read(), "id", ["t"], "x").top(["gesetz"], 5, {"t": 1.0}).collect()] == [3, 1]


def test_ranked_from_the_index_by_shape(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Tierschutz Gesetz", "the law"), (2, "Hundegesetz", "Gesetz über Hunde Gesetz"), (3, "Anderes", None)], "id long, title string, content string")
    idx = SearchIndex.build(docs, "id", ["title", "content"], str(tmp_path / "i"))
    ask = lambda q, **kw: {r.doc for r in search.ranked(idx, docs, "id", q, {"title": 4.0, "content": 1.0}, **kw).collect()}
    assert ask("*") == {1, 2, 3}
    assert ask("Gesetz Tierschutz") == {1}
    assert ask("Was sagt das Gesets zu den Hunden", phrase_fields=["title"]) == {1, 2}


# --- merge on read ---


def batches(seed, n=8):
    rng = random.Random(seed)
    out, event = [], 0
    for _ in range(n):
        b = []
        for _ in range(rng.randint(1, 12)):
            event += 1
            b.append((rng.randint(0, 15), rng.randint(0, 6), event, rng.choice(["upsert", "upsert", "withdrawn"])))
        out.append(b)
    return out


KIND = "k long, r long, event_id long, kind string"


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_on_read_equals_rewriting(spark, tmp_path, seed):
    held, plain = MergeTable(spark, str(tmp_path / "t"), "k", "r", buckets=4), None
    assert held.read() is None
    for i, b in enumerate(batches(seed)):
        batch = spark.createDataFrame(b, KIND)
        assert held.upsert(batch, i)
        assert not held.upsert(batch, i)  # the same batch once more, as after a failure
        plain = spark.createDataFrame(projection.merged(plain, batch, "k", "r").collect(), KIND)
        assert rows(held.read(), "k", "r", "event_id", "kind") == rows(plain, "k", "r", "event_id", "kind")
        if i == 4:
            held.compact()
            assert held.state()["deletes"] == [] and len(held.state()["data"]) == 1
    held.vacuum()
    assert rows(held.read(), "k", "r", "event_id", "kind") == rows(plain, "k", "r", "event_id", "kind")


def test_a_batch_writes_no_more_than_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    held = MergeTable(spark, path, "k", "r")
    big = spark.range(200_000).selectExpr("id AS k", "0L AS r", "id AS event_id", "'upsert' AS kind")
    held.upsert(big)
    before, names = size_of(path), set(held.state()["data"])
    held.upsert(spark.createDataFrame([(5, 1, 1, "upsert"), (7, 1, 2, "withdrawn"), (300_000, 1, 3, "upsert")], KIND))
    assert size_of(path) - before < 0.05 * before
    assert names < set(held.state()["data"])
    assert held.read().count() == 200_001 and rows(held.read().where("k IN (5, 7)"), "k", "r") == [(5, 1), (7, 1)]


def test_a_crash_between_files_changes_nothing(spark, tmp_path, monkeypatch):
    held = MergeTable(spark, str(tmp_path / "t"), "k", "r")
    held.upsert(spark.createDataFrame([(1, 0, 1, "upsert")], KIND), 0)
    monkeypatch.setattr(MergeTable, "_commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        held.upsert(spark.createDataFrame([(1, 5, 2, "upsert"), (2, 0, 3, "upsert")], KIND), 1)
    monkeypatch.undo()
    assert rows(held.read(), "k", "r") == [(1, 0)]
    assert held.upsert(spark.createDataFrame([(1, 5, 2, "upsert"), (2, 0, 3, "upsert")], KIND), 1)
    held.vacuum()
    assert rows(held.read(), "k", "r") == [(1, 5), (2, 0)]


def test_two_writers_cannot_make_one_commit(spark, tmp_path):
    held = MergeTable(spark, str(tmp_path / "t"), "k", "r")
    held.upsert(spark.createDataFrame([(1, 0, 1, "upsert")], KIND))
    state = held.state()
    held.delete(spark.createDataFrame([(1,)], "k long"))
    with pytest.raises(Conflict):
        held._commit(state | {"number": state["number"] + 1})
    assert held.read().count() == 0


# --- timed state ---


def test_guard_over_many_batches_has_bounded_state_and_equals_the_batch_operator(spark, tmp_path):
    rng = random.Random(5)
    own = timed.timed_session(spark, False)
    schema = "k long, r long, event_id long"
    sent, event = [], 0
    (tmp_path / "in").mkdir()
    for b in range(12):
        part = []
        for _ in range(6):
            if sent and rng.random() < 0.2:
                part.append(rng.choice(sent))
            else:
                event += 1
                part.append((rng.randint(0, 3), rng.randint(0, 9), event))
        part = sorted({p[2]: p for p in part}.values(), key=lambda p: p[2])
        sent += part
        f = tmp_path / "in" / f"{b:03d}.json"
        f.write_text("".join(json.dumps(dict(zip(("k", "r", "event_id"), p, strict=True))) + "\n" for p in part))
        os.utime(f, (1_700_000_000 + b, 1_700_000_000 + b))
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = timed.guarded_with_end(stream, "k", "r", "event_id", "event_id", 3_600_000)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    numbered = spark.createDataFrame([(i, *s) for i, s in enumerate(sent)], "at long, k long, r long, event_id long")
    want = projection.outcomes(numbered, "event_id", "k", "r", "at")
    assert rows(spark.read.parquet(str(tmp_path / "out")), "k", "r", "event_id", "outcome") == rows(want, "k", "r", "event_id", "outcome")
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 12


def test_state_ends_with_its_time_to_live(spark, tmp_path):
    """Over many batches the state holds only what was written within the time to live."""
    own = timed.timed_session(spark, False)
    (tmp_path / "in").mkdir()
    stream = own.readStream.schema("k long, r long, event_id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = timed.guarded_with_end(stream, "k", "r", "event_id", "event_id", 1)
    totals = []
    for b in range(5):
        (tmp_path / "in" / f"{b:03d}.json").write_text("".join(json.dumps({"k": b * 10 + i, "r": 1, "event_id": b * 10 + i}) + "\n" for i in range(10)))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        totals.append(max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]))
        time.sleep(0.05)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    assert max(totals) < 3 * totals[0]  # not five times as much


def test_deadlines_are_reported_by_timers(spark, tmp_path):
    own = timed.timed_session(spark)
    (tmp_path / "in").mkdir()
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    files = [[("a", at(0), False), ("b", at(1), False), ("c", at(1), False)], [("b", at(2), True), ("c", at(20), False)], [("d", at(40), False)], [("e", at(80), False)]]
    for i, part in enumerate(files):
        f = tmp_path / "in" / f"{i}.json"
        f.write_text("".join(json.dumps({"u": u, "ts": t.isoformat(), "e": e}) + "\n" for u, t, e in part))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = own.readStream.schema("u string, ts timestamp, e boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = timed.deadlines(stream, "u", "ts", "e", 24 * 3_600_000, "1 hour")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    hours = lambda h: int((at(h) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "u", "last_seen", "verdict") == [("a", hours(0), "overdue"), ("b", hours(2), "ended"), ("c", hours(20), "overdue"), ("d", hours(40), "overdue")]


# --- closure ---


def closure_plainly(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set())
        if b is not None:
            up[a].add(b)
    out = set()
    for a in up:
        seen, level, d = {a}, {a}, 0
        while level:
            out |= {(a, b, d) for b in level}
            level = {p for x in level for p in up.get(x, ())} - seen
            seen |= level
            d += 1
    return out


@pytest.mark.parametrize("edges", [
    [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "zz")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")],
    [("x", "x"), ("y", "x")], [("m", "p"), ("m", "q"), ("p", "r"), ("q", "s"), ("s", "r"), ("r", None)], [],
])
def test_closure_of_forests_cycles_and_several_parents(spark, edges):
    tree = spark.createDataFrame(edges, "id string, parent_id string")
    assert {tuple(r) for r in hierarchy.ancestors(tree).collect()} == closure_plainly(edges)
    assert {tuple(r) for r in hierarchy.ancestors(tree, 1).collect()} == {x for x in closure_plainly(edges) if x[2] <= 1}


def test_closure_of_a_long_chain_has_a_plan_of_one_size(spark):
    chain = lambda n: spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    short, long = hierarchy.ancestors(chain(20)), hierarchy.ancestors(chain(1500))
    assert long.count() == 1500 * 1501 // 2 and long.where("distance <> id - ancestor").count() == 0
    assert size(long) <= 1.2 * size(short)


def test_closure_of_a_star(spark):
    star = spark.range(1_000_000).selectExpr("id", "CASE WHEN id > 0 THEN 0L END AS parent_id")
    assert hierarchy.ancestors(star).count() == 1_999_999


def test_totals_below_of_a_chain_of_ten_thousand_a_star_and_a_cycle(spark):
    tree = spark.range(10_000).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    amounts = spark.range(10_000).selectExpr("id", "1 AS q")
    out = hierarchy.rolled_up(tree, amounts, "q")
    assert out.where("total <> 10000 - id OR depth <> id").count() == 0 and out.count() == 10_000
    mixed = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None), (5, 4), (6, 99)], "id long, parent_id long")
    got = rows(hierarchy.rolled_up(mixed, mixed.selectExpr("id", "10 * id AS q").where("id <> 5"), "q"), "id", "depth", "own", "total")
    assert got == [(1, None, 10, None), (2, None, 20, None), (3, None, 30, None), (4, 0, 40, 40), (5, 1, 0, 0), (6, 0, 60, 60)]


# --- retrieval, mentions, cron ---


def test_sparse_top_equals_brute_force_with_fewer_pairs(spark):
    rng = random.Random(2)
    heavy = lambda: [(f"t{f}", rng.choice([0.02, 0.05, 0.1, 3.0])) for f in rng.sample(range(400), 30)]
    docs = [(i, f, w) for i in range(600) for f, w in heavy()]
    queries = [(q, f, w) for q in range(12) for f, w in heavy()]
    d, q = spark.createDataFrame(docs, "doc_id long, feature string, weight double"), spark.createDataFrame(queries, "query_id long, feature string, weight double")
    best, candidates = sparse.top_scored(q, d, 10, head=40)
    dots = {}
    by = {}
    for i, f, w in docs:
        by.setdefault(f, []).append((i, w))
    for n, f, w in queries:
        for i, x in by.get(f, ()):
            dots[n, i] = dots.get((n, i), 0) + w * x
    want = [(n, i, r + 1) for n in range(12) for r, (_, i) in enumerate(sorted((-round(s, 9), i) for (m, i), s in dots.items() if m == n)[:10])]
    assert [x for x in rows(best, "query_id", "doc_id", "rank")] == sorted(want, key=str)
    assert candidates.count() < 0.6 * len(dots)


def test_sparse_top_with_few_documents_or_none(spark):
    q = spark.createDataFrame([(1, "t1", 1.0), (2, "t9", 1.0)], "query_id long, feature string, weight double")
    d = spark.createDataFrame([(5, "t1", 0.5), (6, "t1", 0.5)], "doc_id long, feature string, weight double")
    assert rows(sparse.top_scored(q, d)[0], "query_id", "doc_id", "rank", "score") == [(1, 5, 1, 0.5), (1, 6, 2, 0.5)]
    assert sparse.top_scored(q, d.limit(0))[0].count() == 0


def test_mentions_over_texts_are_those_of_one_query(spark):
    rng = random.Random(7)
    vocabulary = [("ch-zh", ["zurich"], "ch-zh"), ("ch-be", ["bern"], "be"), ("ch-bs", ["basel", "stadt"], None), ("ch-xx", ["basel", "land", "ost"], "xx")]
    words = ["kanton", "stadt", "von", "de", "zurich", "bern", "basel", "land", "ost", "be", "xx", "a"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(300)] + [(900, None), (901, "")]
    got = search.mentioned(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame(vocabulary, "place string, label array<string>, code string"), ["kanton", "stadt"])
    found = {(r.id, r.place) for r in got.collect()}
    # The single query's form knows no codes of null; it is given one that no text holds.
    want = {(i, p) for i, t in texts for p in search.mentions(search.query_tokens(t or ""), [(p, label, c or "none") for p, label, c in vocabulary], ["kanton", "stadt"])}
    assert found == want and len(found) > 100


def fires_plainly(text, at):
    names = {n: i + 1 for i, n in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
    days = {n: i for i, n in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))}

    def values(field, low, high, names=()):
        out = set()
        for p in field.lower().split(","):
            for n in names:
                p = p.replace(n, str(names[n]))
            span, _, step = p.partition("/")
            a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1])) if "-" in span or not step else (int(span), high)
            out |= set(range(a, b + 1, int(step or 1)))
        return out

    m, h, dom, mon, dow = text.split()
    sets = values(m, 0, 59), values(h, 0, 23), values(dom, 1, 31), values(mon, 1, 12, names), {v % 7 for v in values(dow, 0, 7, days)}
    t = at.replace(second=0, microsecond=0)
    end = t - timedelta(days=366 * 9)
    while t > end:
        in_dom, in_dow = t.day in sets[2], (t.weekday() + 1) % 7 in sets[4]
        day = in_dom or in_dow if not dom.startswith("*") and not dow.startswith("*") else in_dom and in_dow
        if t.month not in sets[3] or not day:
            t = t.replace(hour=0, minute=0) - timedelta(minutes=1)
        elif t.hour not in sets[1]:
            t = t.replace(minute=0) - timedelta(minutes=1)
        elif t.minute not in sets[0]:
            t -= timedelta(minutes=1)
        else:
            return t
    return None


CRONS = ["* * * * *", "0 0 * * *", "*/15 * * * *", "5,35 8-18/2 * * 1-5", "0 12 29 2 *", "30 6 1 1 *", "0 0 31 * *", "17 3 13 * fri", "0 22 * jun-aug Sun", "59 23 28-31 * *", "0 0 30 2 *", "10-20/5 */6 1-7 * MON", "0 4 * * 7", "3 3 */10 * 2"]


def test_previous_fire_equals_a_search_minute_by_minute(spark):
    rng = random.Random(4)
    times = [datetime(2023, 1, 1) + timedelta(seconds=rng.randrange(2 * 366 * 86400)) for _ in range(25)] + [datetime(2024, 2, 29, 12, 0), datetime(2024, 2, 29, 11, 59, 59), datetime(2024, 1, 1), datetime(2104, 2, 28)]
    cases = list(itertools.product(CRONS, times))
    df = spark.createDataFrame([(i, c, t.isoformat(sep=" ")) for i, (c, t) in enumerate(cases)], "i int, cron string, s string").withColumn("t", F.col("s").cast("timestamp"))
    got = {r.i: r.f for r in previous_fire(df, "cron", F.col("t")).select("i", F.date_format("previous_fire", "yyyy-MM-dd HH:mm:ss").alias("f")).collect()}
    for i, (c, t) in enumerate(cases):
        want = fires_plainly(c, t)
        assert got[i] == (want and want.isoformat(sep=" ")), (c, t)


def test_malformed_schedules_have_no_fire_and_are_not_due(spark):
    texts = [None, "", "* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "*/0 * * * *", "5-1 * * * *", "a * * * *", "1,, * * * *", "@daily", "@HOURLY"]
    df = spark.createDataFrame([(i, c, True, None) for i, c in enumerate(texts)], "i int, cron string, enabled boolean, last_run timestamp")
    due = coverage.schedules_due(df, F.lit("2024-05-05 10:30:00").cast("timestamp"))
    assert rows(due.withColumn("f", F.date_format("previous_fire", "yyyy-MM-dd HH:mm")), "i", "f") == [(10, "2024-05-05 00:00"), (11, "2024-05-05 10:00")]


# --- sources, ledger, lookups ---


def test_enumeration_in_ranges_truncated_repeated_and_stuck(spark):
    pages = lambda keys: lambda after, upto, size: [(k, f"v{k}") for k in keys if k > after and (upto is None or k <= upto)][:size]
    schema = spark.createDataFrame([], "k long, v string").schema
    keys = list(range(1, 100, 3))
    enumeration.register(spark, "walk_a", pages(keys), schema, [0, 40, 80], size=4)
    walked = spark.read.format("walk_a").load()
    assert rows(enumeration.rows_of(walked, "k"), "k", "v") == sorted(((k, f"v{k}") for k in keys), key=str)
    assert enumeration.complete(walked) and rows(enumeration.walks_of(walked), "walk", "rows") == [(0, 14), (1, 13), (2, 6)]
    enumeration.register(spark, "walk_b", pages(keys), schema, [0, 90], size=4, most_pages=3)
    cut = spark.read.format("walk_b").load()
    assert not enumeration.complete(cut) and rows(enumeration.walks_of(cut), "walk", "rows", "exhausted") == [(0, 12, False), (1, 3, True)]
    enumeration.register(spark, "walk_c", lambda after, upto, size: [(1, "v")] * size, schema, [0], size=4)
    with pytest.raises(Exception, match="CursorStuck"):
        spark.read.format("walk_c").load().collect()


def test_enumeration_as_a_stream(spark, tmp_path):
    table = f"{SMALL}/orders.parquet"
    schema = spark.read.parquet(table).select("o_orderkey", "o_custkey").schema
    enumeration.register(spark, "walk_s", enumeration.parquet_pager(table, "o_orderkey", ["o_custkey"]), schema, [-1], size=400)
    q = spark.readStream.format("walk_s").load().writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        want = spark.read.parquet(table).count()
        for _ in range(120):
            q.processAllAvailable()
            if os.path.isdir(tmp_path / "o" / "_spark_metadata") and spark.read.schema(schema).parquet(str(tmp_path / "o")).count() >= want:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    assert rows(spark.read.parquet(str(tmp_path / "o")), "o_orderkey", "o_custkey") == rows(spark.read.parquet(table), "o_orderkey", "o_custkey")


def test_a_point_read_touches_one_row_group(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(400_000).selectExpr("pmod(id * 7919, 400000) AS k", "repeat(sha2(cast(id AS string), 256), 2) AS v").createOrReplaceTempView("t")
    stores.write_keyed(spark.table("t"), path, "k", 4, row_group_bytes=1 << 20)
    one = spark.read.parquet(path).where("k = 123456")
    assert one.count() == 1

    def metric(df, name):
        df.collect()
        plan, found = df._jdf.queryExecution().executedPlan(), []

        def walk(p):
            m = p.metrics()
            if p.nodeName().startswith("Scan parquet"):
                found.append(m.apply(name).value())
            kids = p.children() if not p.nodeName().startswith("AdaptiveSparkPlan") else p.children()
            for i in range(kids.size()):
                walk(kids.apply(i))

        walk(plan)
        return sum(found)

    assert 0 < metric(one.select("v"), "numOutputRows") <= 20_000  # of 400,000 rows


def test_surfaces_keep_their_contract_and_insights_their_schema(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("document_id string, document_revision long, processing_manifest_id string, processed_at timestamp, title string")
    good = spark.createDataFrame([("d", 1, "m", None, "t")], schema)
    good.write.parquet(str(tmp_path / "published_documents"))
    assert stores.published(spark, str(tmp_path), "published_documents", schema).first().title == "t"
    good.drop("processed_at").write.parquet(str(tmp_path / "other" / "published_documents"))
    with pytest.raises(stores.KeyLoss):
        stores.published(spark, str(tmp_path / "other"), "published_documents", schema)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stores.published(spark, str(tmp_path / "none"), "published_documents", schema)
    made = spark.createDataFrame([("i", "d", "p", ["k"], 0.9)], "insight_id string, document_id string, passage string, citation_keys array<string>, confidence double")
    assert stores.write_insights(made, str(tmp_path / "insights")) == 1
    assert stores.write_insights(made.limit(0), str(tmp_path / "nothing")) == 0 and not (tmp_path / "nothing").exists()
    with pytest.raises(ValueError):
        stores.write_insights(made, None)


def test_ledger_counts_a_retried_stage_once(spark, tmp_path):
    ledger = StageLedger(spark, str(tmp_path / "ledger"), "r1")
    assert ledger.attempts().count() == 0
    with pytest.raises(Exception, match="lost"):
        ledger.record("a", spark.range(10), lambda df: df.where(F.raise_error(F.lit("lost")).isNull()), str(tmp_path / "a"))
    out = ledger.record("a", spark.range(10), lambda df: df.where("id > 3"), str(tmp_path / "a"))
    assert ledger.record("b", out, lambda df: df.limit(0), str(tmp_path / "b")).count() == 0
    assert ledger.attempts().count() == 3
    got = ledger.stages()
    assert rows(got, "run", "stage", "attempt", "rows_in", "rows_out", "outcome", "error") == [("r1", "a", 2, 10, 6, "done", None), ("r1", "b", 1, 6, 0, "done", None)]
    assert got.where("seconds <= 0 OR started_at IS NULL").count() == 0


def test_a_lookup_that_fails_while_it_runs_leaves_edges_as_they_are(spark):
    edges = spark.createDataFrame([("c", "d", "sr:1")], "citation_id string, source_document_id string, citation_key string")
    lost = lambda: spark.createDataFrame([("sr:1", "x", None)], "target_key string, document_id string, section_id string").where(F.raise_error(F.lit("lost")).isNull())
    out = citations.resolve_on_write(edges, lost)
    assert out is edges and out.count() == 1


def test_matches_are_rows(spark):
    edges, targets = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "e int, k string"), spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), (None, "z")], "k string, t string")
    assert rows(joins.matches(edges, targets, "k", "t"), "e", "t") == [(1, "x"), (1, "y"), (2, None), (3, None)]


def test_sparse_pairs_of_the_tables_are_fewer_than_all(spark):
    q, d = _sparse(spark, MEDIUM)
    _, candidates = sparse.top_scored(q, d)
    assert candidates.count() <= sparse.dot(q, d).count()
