"""Registered queries for tables and streams that hold state, closures, schedules, enumerations and point reads. Stand-in columns are named in each query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import hierarchy, joins, search, sparse
from quillon.operators.cron import previous_fire
from quillon.operators.ledger import StageLedger
from quillon.plans.flow_queries import _APPLIED, _WORDS
from quillon.plans.queries import _SPARSE, _TREE, _sparse, _tree
from quillon.plans.registry import query
from quillon.sources import enumeration, stores
from quillon.sources.merge_table import MergeTable
from quillon.sources.shared import shared_folder
from quillon.sources.tables import spread, table
from quillon.streaming import projection, timed


def _fresh(spark: SparkSession, name: str) -> str:
    """A folder of this run's own that all machines share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _changes(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), (i % 9).alias("r"), F.when(F.col("event_type") == "error", "withdrawn").otherwise("upsert").alias("kind"))


@query(_APPLIED + "SELECT k, event_id, r FROM n WHERE kind <> 'withdrawn'")
def merged_on_read(spark, sf_dir):
    """Three batches written as data files and bitmaps of replaced rows, merged by the reader."""
    held, e = MergeTable(spark, _fresh(spark, "merged"), "k", "r"), _changes(spark, sf_dir)
    for b in range(3):
        held.upsert(e.where(F.col("event_id") % 3 == b), b)
    return projection.live(held.read()).select("k", "event_id", "r")


@query("""
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS r, CASE WHEN o_orderkey % 5 = 0 THEN 'patched' ELSE o_orderstatus END AS status, o_custkey AS customer
    FROM orders WHERE o_orderkey % 11 <> 0""")
def patched_rows(spark, sf_dir):
    """An upsert, a partial update, a deletion and a compaction of orders; readers see their sum."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("r"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    held = MergeTable(spark, _fresh(spark, "patched"), "k", "r", "k")
    held.upsert(o)
    held.upsert(o.where("k % 7 = 0").withColumn("r", F.lit(2)))
    held.patch(o.where("k % 5 = 0").select("k", F.lit("patched").alias("status")), ["status"])
    held.delete(o.where("k % 11 = 0").select("k"))
    held.compact()
    return held.read().select("k", "r", "status", "customer")


def _streamed(spark: SparkSession, sf_dir: str, name: str, make, idle_batches: bool, most_stores: int | None = None) -> DataFrame:
    """What a stream over the events makes, run until the table is read."""
    own = timed.timed_session(spark, idle_batches, most_stores)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = own.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern, which may be a file or a folder
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = _fresh(spark, name)
    make(events).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("""
    WITH e AS (SELECT event_id, user_id, floor(value)::BIGINT AS revision, unnest(CASE WHEN event_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM events)
    SELECT event_id, user_id, revision, CASE WHEN copy = 1 THEN 'ignored_duplicate' WHEN revision < max(revision) OVER (PARTITION BY user_id, copy ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'stale' ELSE 'applied' END AS outcome FROM e""")
def guarded_stream(spark, sf_dir):
    """Events, every fifth sent twice, through a stream whose state of ids and revisions has a time to live."""
    twice = F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    make = lambda e: timed.guarded_with_end(e.select("event_id", "user_id", F.floor("value").alias("revision"), twice.alias("copy")), "user_id", "revision", "event_id", "event_id", 3_600_000)
    return _streamed(spark, sf_dir, "guarded", make, False).select("event_id", "user_id", "revision", "outcome")


@query("""
    WITH u AS (SELECT user_id * 1000 + dayofyear(ts) AS unit, epoch_us(max(ts)) // 1000 AS last_seen, bool_or(event_type = 'purchase') AS ended FROM events GROUP BY ALL)
    SELECT unit::BIGINT AS unit, last_seen, CASE WHEN ended THEN 'ended' ELSE 'overdue' END AS verdict FROM u
    WHERE ended OR last_seen + 86400000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 3600000""")
def deadline_stream(spark, sf_dir):
    """A user's day is a unit that a purchase ends; event-time timers report those that pass a day's deadline."""
    unit = (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("unit")
    make = lambda e: timed.deadlines(e.select(unit, "ts", (F.col("event_type") == "purchase").alias("ends")), "unit", "ts", "ends", 86_400_000, "1 hour")
    return _streamed(spark, sf_dir, "deadlines", make, True, 4 * spark.sparkContext.defaultParallelism).select("unit", "last_seen", "verdict")


@query(f"""
    WITH RECURSIVE t AS ({_TREE}), a AS (SELECT 's' || l_suppkey AS id, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
    c(id, top, d) AS (SELECT id, id, 0 FROM t UNION ALL SELECT c.id, t.parent_id, d + 1 FROM c JOIN t ON c.top = t.id WHERE t.parent_id IS NOT NULL),
    depth AS (SELECT id, max(d) AS depth FROM c GROUP BY id), total AS (SELECT top AS id, sum(q) AS total FROM c JOIN a USING (id) GROUP BY top)
    SELECT t.id, depth::BIGINT AS depth, round(coalesce(q, 0), 3)::DOUBLE AS own, round(coalesce(total, 0), 3)::DOUBLE AS total FROM t JOIN depth USING (id) LEFT JOIN a USING (id) LEFT JOIN total USING (id)""")
def subtree_totals(spark, sf_dir):
    """Quantities supplied, summed up the tree of suppliers, nations and regions without pairs of node and ancestor."""
    amounts = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("id"), F.col("l_quantity").cast("double").alias("q"))
    out = hierarchy.rolled_up(_tree(spark, sf_dir), amounts, "q")
    return out.select("id", "depth", F.round(F.col("own").cast("double"), 3).alias("own"), F.round(F.col("total").cast("double"), 3).alias("total"))


@query("SELECT p_partkey, l_suppkey FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey")
def key_matches(spark, sf_dir):
    """Every different supplier of each part, a row each."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return joins.matches(table(spark, sf_dir, "part").select("p_partkey"), t, "p_partkey", "l_suppkey")


@query(_SPARSE + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM k WHERE rank <= 10")
def sparse_top(spark, sf_dir):
    """The ten best documents of each query, from postings in order of impact."""
    best, _ = sparse.top_scored(*_sparse(spark, sf_dir))
    return best.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


#: Words that stand for tier words.
_TIERS = ("the", "of", "and", "le", "la", "de", "und", "der")


@query(rf"""
    WITH t AS (SELECT 'd' || doc_id AS id, doc_id, {_WORDS.format(c="text")} AS ws FROM documents UNION ALL SELECT 'c' || conv_id || ':' || turn, NULL, {_WORDS.format(c="text")} FROM conversations),
    v AS (SELECT n_nationkey AS place, ws[2:3] AS label, ws[6] AS code FROM nation JOIN t ON doc_id = n_nationkey * 7),
    p AS (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t),
    m AS (
        SELECT id, place, i - 1 AS pos, 'label' AS by_ FROM p JOIN v ON ws[i] = label[1] AND ws[i:i + len(label) - 1] = label
        WHERE len(label) > 0 AND (coalesce(ws[i + len(label)] IN {_TIERS}, false) OR coalesce(CASE WHEN i > 2 AND ws[i - 1] IN {search.FILLERS} THEN ws[i - 2] WHEN i > 1 THEN ws[i - 1] END IN {_TIERS}, false))
        UNION ALL SELECT id, place, i - 1, 'code' FROM p JOIN v ON ws[i] = code)
    SELECT id, place, by_, count(*) AS n, min(pos)::INTEGER AS first_pos FROM m GROUP BY ALL""")
def mentioned_places(spark, sf_dir):
    """Mentions in all documents and turns; the labels and codes of places are words of some documents."""
    d, c = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "conversations")
    named = table(spark, sf_dir, "nation").join(d.select((F.col("doc_id") / 7).alias("n_nationkey"), "text"), "n_nationkey")  # only their texts are cut
    vocabulary = named.select("n_nationkey", search.analyse("text").alias("w")).select(F.col("n_nationkey").cast("int").alias("place"), F.slice("w", 2, 2).alias("label"), F.try_element_at("w", F.lit(6)).alias("code"))
    texts = spread(d.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")).unionByName(c.select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("id"), "text"))
    found = search.mentioned(texts, "id", "text", vocabulary, _TIERS)
    return found.groupBy("id", "place", F.col("by").alias("by_")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query("""
    WITH o AS (SELECT o_orderkey AS k, o_orderdate + to_minutes((o_orderkey * 37) % 1440) AS t0, o_orderkey % 5 AS kind, o_orderkey % 60 AS mi, o_orderkey % 24 AS h, 1 + o_orderkey % 31 AS d, o_orderkey % 7 AS w FROM orders),
    c AS (SELECT *, date_trunc('day', t0)::TIMESTAMP - to_days(b::INTEGER) AS day FROM o, (SELECT unnest(range(0, 70)) AS b)),
    m AS (SELECT * FROM c WHERE CASE kind WHEN 2 THEN day(day) = d WHEN 3 THEN dayofweek(day) = w WHEN 4 THEN day(day) = d OR dayofweek(day) = w ELSE day >= t0 - INTERVAL 2 DAY END),
    f AS (SELECT k, t0, day + to_hours(hh::INTEGER) + to_minutes(mm::INTEGER) AS t FROM (
        SELECT *, mi AS mm FROM (SELECT *, unnest(CASE kind WHEN 1 THEN range(0, 24) WHEN 4 THEN [0, 6, 12, 18] ELSE [h] END) AS hh FROM m)))
    SELECT k, epoch_ms(max(t)) AS fired FROM f WHERE t <= t0 GROUP BY k""")
def previous_fires(spark, sf_dir):
    """the last fire of a schedule before an order's time: daily, hourly, by day of month, by day of week, or by either."""
    k = F.col("o_orderkey")
    minute, hour, day, week = (k % 60).cast("string"), (k % 24).cast("string"), (1 + k % 31).cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("SUN", "Mon", "tue", "3", "thu", "FRI", "6")]), (k % 7 + 1).cast("int"))
    text = F.when(k % 5 == 0, F.concat_ws(" ", minute, hour, F.lit("* * *"))).when(k % 5 == 1, F.concat_ws(" ", minute, F.lit("* * * *"))).when(k % 5 == 2, F.concat_ws(" ", minute, hour, day, F.lit("* *"))).when(k % 5 == 3, F.concat_ws(" ", minute, hour, F.lit("* *"), week)).otherwise(F.concat_ws(" ", minute, F.lit("*/6"), day, F.lit("*"), week))
    at = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (k * 37) % 1440 * 60)
    return previous_fire(table(spark, sf_dir, "orders").select(k.alias("k"), "o_orderdate", "o_orderkey", text.alias("cron")), "cron", at).select("k", F.unix_millis("previous_fire").alias("fired"))


_BOUNDS = (-1, 9_000, 30_000)


def _walked(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    enumeration.register(spark, "quillon_orders", enumeration.parquet_pager(f"{sf_dir}/orders.parquet", "o_orderkey", ["o_custkey"]), orders.schema, _BOUNDS, size=2_000, cuts=enumeration.cuts_of(orders, "o_orderkey"))
    return spark.read.format("quillon_orders").load()


@query("SELECT o_orderkey, o_custkey FROM orders")
def enumerated_orders(spark, sf_dir):
    """Orders read page by page through a source with key ranges and cursors; each key once."""
    return enumeration.rows_of(_walked(spark, sf_dir), "o_orderkey").select("o_orderkey", "o_custkey")


@query("""
    SELECT w AS walk, count(o_orderkey) AS rows, true AS exhausted FROM (SELECT unnest([0, 1, 2]) AS w)
    LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey <= 9000 THEN 0 WHEN o_orderkey <= 30000 THEN 1 ELSE 2 END AS w FROM orders) USING (w) GROUP BY w""")
def enumeration_walks(spark, sf_dir):
    """How each range's walk ended, and how many rows it gave."""
    return enumeration.walks_of(_walked(spark, sf_dir)).select("walk", "rows", "exhausted")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 100")
def point_read(spark, sf_dir):
    """The lines of one order, from a table written in order of its key with Bloom filters; one row group is read."""
    path = _fresh(spark, "keyed")
    stores.write_keyed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), path, "l_orderkey", 8)
    return spark.read.parquet(path).where("l_orderkey = 100")


@query("""
    SELECT 'dated' AS stage, 1 AS attempt, count(*) AS rows_in, count(*) FILTER (o_orderstatus = 'F') AS rows_out, 'done' AS outcome FROM orders
    UNION ALL SELECT 'customers', 2, count(*), count(DISTINCT o_custkey), 'done' FROM orders WHERE o_orderstatus = 'F'""")
def stage_ledger(spark, sf_dir):
    """Rows in and out of two stages, the second of which fails once."""
    root = _fresh(spark, "ledger")
    ledger = StageLedger(spark, f"{root}/attempts", "run")
    dated = ledger.record("dated", table(spark, sf_dir, "orders"), lambda o: o.where("o_orderstatus = 'F'"), f"{root}/dated")
    try:
        ledger.record("customers", dated, lambda o: o.where(F.raise_error(F.lit("lost")).isNull()), f"{root}/customers")
    except Exception:  # noted in the ledger
        ledger.record("customers", dated, lambda o: o.select("o_custkey").distinct(), f"{root}/customers")
    return ledger.stages().select("stage", "attempt", "rows_in", "rows_out", "outcome")


@query("SELECT 'i' || doc_id AS insight_id, 'd' || doc_id AS document_id, substr(text, 1, 40) AS passage, 0.78::DOUBLE AS confidence FROM documents WHERE text IS NOT NULL")
def written_insights(spark, sf_dir):
    """Insights appended with their declared columns and read back."""
    path = _fresh(spark, "insights")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    stores.write_insights(d.select(F.concat(F.lit("i"), "doc_id").alias("insight_id"), F.concat(F.lit("d"), "doc_id").alias("document_id"), F.substring("text", 1, 40).alias("passage"), F.array().cast("array<string>").alias("citation_keys"), F.lit(0.78).alias("confidence"), F.lit(None).cast("timestamp").alias("created_at")), path)
    return spark.read.parquet(path).select("insight_id", "document_id", "passage", "confidence")
