"""Registered queries on the driver's tables, each with the SQL it must equal. Stand-in columns are named in each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ids, text
from quillon.operators import aggregates as A
from quillon.operators import chunking, citations, coverage, data_quality, evaluation, gates, hierarchy, joins, mutation, predicates, search, sparse, windows
from quillon.operators.search_index import SearchIndex
from quillon.plans.registry import query
from quillon.sources.shared import shared_folder
from quillon.sources.tables import spread, table


def _kind() -> F.Column:
    return F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("started")


@query("""
    WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'started' END AS kind FROM events),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM e),
    c AS (SELECT user_id, count(*) AS total_events, count(*) FILTER (kind = 'failed') AS failed_attempts FROM e GROUP BY user_id)
    SELECT user_id, kind AS latest_event_type, epoch_us(ts) AS latest_event_us, total_events, failed_attempts,
        CASE WHEN kind = 'completed' THEN 'done' WHEN kind = 'failed' AND failed_attempts >= 3 THEN 'dead_letter' WHEN kind = 'failed' THEN 'retryable' ELSE 'in_progress' END AS control_status
    FROM l JOIN c USING (user_id) WHERE rn = 1""")
def control_status(spark, sf_dir):
    """V13 on events: a user stands for a document version."""
    out = coverage.control_status(table(spark, sf_dir, "events").withColumn("kind", _kind()), "user_id", "ts", "kind", "event_id")
    return out.withColumn("latest_event_us", F.unix_micros("latest_event_ts")).drop("latest_event_ts")


@query("""
    WITH d AS (SELECT event_type, floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)
    SELECT event_type, count(s) AS n, round(avg(s), 4) AS avg_seconds, max(s) AS max_seconds FROM d GROUP BY event_type""")
def stage_latency(spark, sf_dir):
    """Seconds until a user's next event, by type; the window comes first, then the aggregate."""
    d = table(spark, sf_dir, "events").withColumn("s", windows.seconds_to_next(["user_id"], "ts", F.col("event_id")))
    return d.groupBy("event_type").agg(F.count("s").alias("n"), F.round(F.avg("s"), 4).alias("avg_seconds"), F.max("s").alias("max_seconds"))


@query("""
    SELECT doc_id, sha256(concat_ws('||', source, doc_id::VARCHAR, coalesce(lang, ''))) AS document_id,
        sha256(concat_ws('||', source, doc_id::VARCHAR, sha256(coalesce(text, '')))) AS document_version_id FROM documents""")
def document_identity(spark, sf_dir):
    """F1, section 1.3: hash ids; the text's digest stands for the checksum."""
    d = table(spark, sf_dir, "documents")
    uri = F.col("doc_id").cast("string")
    return d.select("doc_id", ids.hash_id("source", uri, F.coalesce("lang", F.lit(""))).alias("document_id"), ids.hash_id("source", uri, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("document_version_id"))


@query("""
    SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders""")
def current_version(spark, sf_dir):
    """W2 on orders: the newest of each customer."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", windows.is_latest(["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).alias("is_current"))


@query("""
    SELECT doc_id, NOT EXISTS (SELECT 1 FROM documents p WHERE p.source = d.source AND sha256(p.text) = sha256(d.text) AND p.doc_id % 2 = 0) AS is_new_version
    FROM documents d WHERE doc_id % 2 = 1""")
def new_version_flag(spark, sf_dir):
    """Even ids are the prior state, odd ones come in; a version is source and text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("checksum"))
    return mutation.new_version_flag(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), ["source", "checksum"]).select("doc_id", "is_new_version")


_CHUNK = """
    WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, unnest(range(0, greatest(0, ceil({last}))::BIGINT + 1)) AS chunk_idx, text FROM d)
    SELECT doc_id, chunk_idx::INTEGER AS chunk_idx, length(t)::INTEGER AS n_chars, sha256(t) AS chunk_sha
    FROM (SELECT doc_id, chunk_idx, substr(text, {start}, 2048) AS t FROM c) WHERE length(trim(t, ' ')) > 50"""


@query(_CHUNK.format(last="n / 2048.0 - 1", start="greatest(1, chunk_idx * 1792)"))
def chunks_compat(spark, sf_dir):
    """T12 as the reference has it, with its lost tails."""
    return _chunk_rows(chunking.chunks(table(spark, sf_dir, "documents"), "text", lossless=False))


@query(_CHUNK.format(last="(n - 2048) / 1792.0", start="chunk_idx * 1792 + 1"))
def chunks_lossless(spark, sf_dir):
    """T12 with windows that cover every character."""
    return _chunk_rows(chunking.chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text"))


def _chunk_rows(c: DataFrame) -> DataFrame:
    return c.select("doc_id", "chunk_idx", F.length("chunk_text").alias("n_chars"), F.sha2("chunk_text", 256).alias("chunk_sha"))


@query(r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
    l AS (SELECT doc_id, t, length(t) AS n, CASE WHEN length(t) <= 6000 THEN 0 ELSE (length(t) - 1) // 5600 END AS last FROM d WHERE t <> ''),
    k AS (SELECT doc_id, t, unnest(range(0, CASE WHEN last > 0 AND n - last * 5600 <= 400 THEN last ELSE last + 1 END)) AS i FROM l)
    SELECT doc_id, i::INTEGER AS window_idx, sha256(substr(t, i * 5600 + 1, 6000)) AS window_sha FROM k""")
def chunks_sparse_windows(spark, sf_dir):
    """Windows of 6000 characters with an overlap of 400."""
    return chunking.windows(table(spark, sf_dir, "documents"), "text").select("doc_id", "window_idx", F.sha2("window_text", 256).alias("window_sha"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
    h AS (SELECT *, regexp_matches(line, '^(The|Der|La|Los?) ') AS heading FROM l),
    s AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM h)
    SELECT doc_id, n::BIGINT AS section, count(*) FILTER (NOT heading)::BIGINT AS n_lines, coalesce(sum(length(line)) FILTER (NOT heading), 0)::BIGINT AS n_chars FROM s GROUP BY doc_id, n""")
def sections_markdown(spark, sf_dir):
    """Lines grouped under the heading above them; lines that begin with an article stand for headings."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("heading", F.col("line").rlike("^(The|Der|La|Los?) "))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return lines.withColumn("section", F.sum(F.col("heading").cast("int")).over(w)).groupBy("doc_id", "section").agg(F.count_if(~F.col("heading")).alias("n_lines"), F.coalesce(F.sum(F.when(~F.col("heading"), F.length("line"))), F.lit(0)).alias("n_chars"))


@query(r"""
    WITH h AS (SELECT page_id, regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h[1-6]>', 1) AS lv, regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h[1-6]>', 2) AS tx FROM pages)
    SELECT page_id, pos::INTEGER AS pos, level::INTEGER AS level, heading FROM (SELECT page_id, unnest(range(0, len(lv))) AS pos, unnest(lv) AS level, unnest(tx) AS heading FROM h)""")
def page_headings(spark, sf_dir):
    """T1 in part, N1: headings of pages with their place."""
    pattern = F.lit("<h([1-6])[^>]*>([^<]*)</h[1-6]>")
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("level"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("heading"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(pairs).alias("pos", "h")).select("page_id", "pos", F.col("h.level").cast("int").alias("level"), "h.heading")


@query("""
    SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END)::BIGINT AS large FROM events GROUP BY 1, 2""")
def ingestion_by_day(spark, sf_dir):
    """Events by type and day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(F.when(F.col("value") > 20, 1).otherwise(0)).alias("large"))


@query("""
    SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang
    UNION ALL SELECT * FROM (SELECT 'source' AS field, source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, value LIMIT 10)""")
def facets(spark, sf_dir):
    """Buckets of languages, and the ten largest of sources."""
    d = table(spark, sf_dir, "documents")
    return A.facet(d, "lang").select(F.lit("lang").alias("field"), "value", "n").unionByName(A.facet(d, "source", 10).select(F.lit("source").alias("field"), "value", "n"))


@query("""
    SELECT r_name, p_brand, coalesce(s_name, 'unknown') AS supplier, count(*) AS n, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS revenue
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY ALL""")
def star_fact(spark, sf_dir):
    """A fact with its dimensions; which are broadcast Spark decides by their size."""
    t = lambda n: table(spark, sf_dir, n)
    f = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    f = f.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    f = f.join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return f.groupBy("r_name", "p_brand", F.coalesce("s_name", F.lit("unknown")).alias("supplier")).agg(F.count("*").alias("n"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"))


@query("""
    WITH l AS (SELECT l_orderkey, count(*) AS n_lines, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
        array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, o_orderstatus, coalesce(n_lines, 0) AS n_lines, coalesce(parts, '') AS parts, coalesce(suppliers, 0) AS suppliers, coalesce(flags, '') AS flags, coalesce(discounted, 0) AS discounted
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def knowledge_base(spark, sf_dir):
    """Orders with their lines aggregated first; lists have an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), " ").alias("parts"),
        F.size(F.collect_set("l_suppkey")).alias("suppliers"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
    )
    out = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "o_orderstatus", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "suppliers", "discounted")], *[F.coalesce(c, F.lit("")).alias(c) for c in ("parts", "flags")])


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def orphans(spark, sf_dir):
    """Documents that no label names."""
    return joins.not_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("""
    SELECT (SELECT count(DISTINCT vec_id) FROM embeddings) AS indexed, (SELECT count(*) FROM (SELECT vec_id FROM embeddings ANTI JOIN documents ON vec_id = doc_id)) AS orphaned""")
def reconcile(spark, sf_dir):
    """Embeddings whose document is not there; a report, so any share is let through."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    lost = mutation.orphans(e, table(spark, sf_dir, "documents"), "doc_id", most=1.0)
    return e.agg(F.count_distinct("doc_id").alias("indexed")).withColumn("orphaned", lost.agg(F.count("*").alias("n")).scalar())


@query("SELECT count(DISTINCT c_custkey) AS n, count(*) AS rows FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def unattributable(spark, sf_dir):
    """Customers without an order."""
    return coverage.unattributable(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "c_custkey")


@query("SELECT sha256(text) AS checksum, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def dup_checksums(spark, sf_dir):
    """Texts that more than one document has."""
    return A.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("checksum")), "checksum")


@query("""
    SELECT 'documents_by_lang' AS metric_set, lang AS label, count(*)::DOUBLE AS value FROM documents GROUP BY lang
    UNION ALL SELECT 'events_by_type', event_type, count(*)::DOUBLE FROM events GROUP BY event_type
    UNION ALL SELECT 'orders_by_status', o_orderstatus, round(sum(o_totalprice), 2) FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'stage_seconds', event_type, round(avg(s), 4) FROM (
        SELECT event_type, floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events) GROUP BY event_type""")
def analytics_union(spark, sf_dir):
    """Four sets of metrics under one schema."""
    e = table(spark, sf_dir, "events")
    sets = {
        "documents_by_lang": table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").cast("double").alias("value")),
        "events_by_type": e.groupBy(F.col("event_type").alias("label")).agg(F.count("*").cast("double").alias("value")),
        "orders_by_status": table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.round(F.sum("o_totalprice"), 2).alias("value")),
        "stage_seconds": e.withColumn("s", windows.seconds_to_next(["user_id"], "ts", F.col("event_id"))).groupBy(F.col("event_type").alias("label")).agg(F.round(F.avg("s"), 4).alias("value")),
    }
    parts = [d.select(F.lit(n).alias("metric_set"), "label", "value") for n, d in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""
    WITH c AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    s AS (SELECT * FROM c WHERE before IS NULL OR before <> event_type)
    SELECT user_id, event_type, epoch_us(ts) AS from_us, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS to_us,
        lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS is_current FROM s""")
def scd2_history(spark, sf_dir):
    """M3, M4: runs of equal event types of a user."""
    h = mutation.scd2_from_log(table(spark, sf_dir, "events"), "user_id", ["event_type"], "ts", "event_id")
    return h.select("user_id", "event_type", F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"), "is_current")


@query("""
    WITH src AS (SELECT o_orderkey, o_custkey, 'U' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0),
    tgt AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
    SELECT * FROM tgt ANTI JOIN src USING (o_orderkey) UNION ALL SELECT * FROM src""")
def merge_upsert(spark, sf_dir):
    """M1, M2: every third order comes in, every second is there."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    src = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return mutation.upsert(o.where("o_orderkey % 2 = 0"), src, ["o_orderkey"])


@query("""
    WITH last AS (SELECT date_trunc('week', max(ts))::DATE AS w FROM events),
    grid AS (SELECT event_type, unnest(generate_series(w - INTERVAL 49 DAY, w, INTERVAL 7 DAY))::DATE AS week FROM (SELECT DISTINCT event_type FROM events), last),
    c AS (SELECT event_type, date_trunc('week', ts)::DATE AS week, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, strftime(week, '%Y-%m-%d') AS week, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (event_type, week)""")
def weekly_buckets(spark, sf_dir):
    """The last eight weeks of each type, with zeros."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").cast("string")).first()[0]  # one value
    return A.weekly_buckets(e, "event_type", "ts", last, 8).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("""
    SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS applied, count(*) FILTER (event_type = 'error') AS rejected
    FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20""")
def throughput_topn(spark, sf_dir):
    """The busiest users."""
    return A.throughput(table(spark, sf_dir, "events"), "user_id", "event_type", "purchase", "error", 20)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    """Exact, interpolated."""
    p = A.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.9])
    return p.select("event_type", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


_FUNNEL = """
    WITH f AS (SELECT n_nationkey, n_name, coalesce(a.n, 0) AS discovered, coalesce(b.n, 0) AS acquired, coalesce(c.n, 0) AS processed
        FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a ON n_nationkey = a.k
        LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) b ON n_nationkey = b.k
        LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1) c ON n_nationkey = c.k)"""


def _funnel(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    n = F.count("*").alias("n")
    return coverage.funnel(nation, "n_nationkey", {"discovered": customer.groupBy("n_nationkey").agg(n), "acquired": orders.groupBy("n_nationkey").agg(n), "processed": orders.where("o_orderstatus = 'F'").groupBy("n_nationkey").agg(n)})


@query(_FUNNEL + "SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN acquired - processed END AS gap FROM f")
def coverage_funnel(spark, sf_dir):
    """Nations; customers, orders and filled orders are the stages; even keys have a published count."""
    f = _funnel(spark, sf_dir).withColumn("tier", F.when(F.col("n_nationkey") % 2 == 0, "PUBLISHED").otherwise("ESTIMATED")).withColumn("truncated", F.lit(False))
    return f.withColumn("gap", coverage.gap("acquired", "processed", "tier", "truncated")).drop("tier", "truncated")


@query(_FUNNEL + """
    SELECT n_name, array_to_string(list_filter([CASE WHEN discovered = 0 THEN 'no_source' END, CASE WHEN processed * 3 < acquired THEN 'processing_gap' END, CASE WHEN discovered > 60 * (SELECT avg(discovered) / 60 FROM f) THEN 'large' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM f WHERE discovered = 0 OR processed * 3 < acquired OR discovered > (SELECT avg(discovered) FROM f)""")
def work_queue(spark, sf_dir):
    """Nations that need work, with every reason."""
    f = _funnel(spark, sf_dir)
    mean = f.agg(F.avg("discovered").alias("m")).scalar()
    rules = [("no_source", F.col("discovered") == 0), ("processing_gap", F.col("processed") * 3 < F.col("acquired")), ("large", F.col("discovered") > mean)]
    return coverage.work_queue(f, rules, "n_name").select("n_name", F.array_join("reasons", ",").alias("reasons"))


@query("""
    WITH u AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest_status, bool_or(event_type = 'purchase') AS terminated, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id)
    SELECT user_id, latest_status, terminated, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, NOT terminated AND last_seen <= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 24 HOUR AS past_deadline FROM u""")
def processing_recon(spark, sf_dir):
    """Users as units, purchases end them; now is fixed."""
    u = coverage.reconcile_units(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id", ["purchase"], F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return u.select("user_id", "latest_status", "terminated", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "past_deadline")


@query("""
    WITH w AS (SELECT o_orderkey, o_orderdate::DATE AS f, max(l_shipdate)::DATE AS u FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT o_orderkey, coalesce(u >= DATE '1998-01-01', true) AND coalesce(f <= DATE '1998-01-01', true) AS valid,
        CASE WHEN u < DATE '1998-01-01' THEN 'repealed' WHEN f > DATE '1998-01-01' THEN 'not_yet_in_force' WHEN f IS NULL AND u IS NULL THEN 'unknown' ELSE 'in_force' END AS state FROM w""")
def in_force(spark, sf_dir):
    """An order is in force from its date to its last shipment."""
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("until"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("from")).join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    at = F.lit("1998-01-01").cast("date")
    return o.select("o_orderkey", predicates.valid_at("from", "until", at).alias("valid"), predicates.in_force_state("from", "until", at).alias("state"))


@query("""
    SELECT c_nationkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3""")
def top_k_per_group(spark, sf_dir):
    """The three largest orders of each nation."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", "o_totalprice")
    return windows.top_k(o, ["c_nationkey"], 3, F.desc("o_totalprice"), F.col("o_orderkey")).select("c_nationkey", "o_orderkey", "rank")


_TREE = """
    SELECT 'r' || r_regionkey AS id, NULL AS parent_id, 'federal' AS level FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'cantonal' FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'municipal' FROM supplier"""


def _tree(spark, sf_dir) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("federal").alias("level"))
    n = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent_id"), F.lit("cantonal").alias("level"))
    s = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("id"), name("n", "s_nationkey").alias("parent_id"), F.lit("municipal").alias("level"))
    return r.unionByName(n).unionByName(s)


@query(f"""
    WITH RECURSIVE t AS ({_TREE}),
    c(id, ancestor, distance) AS (SELECT id, id, 0 FROM t UNION ALL SELECT c.id, t.parent_id, distance + 1 FROM c JOIN t ON c.ancestor = t.id WHERE t.parent_id IS NOT NULL)
    SELECT id, ancestor, distance FROM c""")
def hierarchy_closure(spark, sf_dir):
    """Ancestors of regions, nations and suppliers."""
    return hierarchy.ancestors(_tree(spark, sf_dir), 4)


@query(f"""
    WITH t AS ({_TREE})
    SELECT a.id, b.id AS scope FROM t a JOIN t b ON b.id = a.parent_id
    UNION ALL SELECT a.id, c.id FROM t a JOIN t b ON b.id = a.parent_id JOIN t c ON c.id = b.parent_id""")
def hierarchy_superiors(spark, sf_dir):
    """Scopes of higher authority."""
    return hierarchy.superiors(hierarchy.governing_scopes(_tree(spark, sf_dir), 4)).select("id", "scope")


_CITE = """concat('Nach SR ', 100 + doc_id % 900, '.', doc_id % 7, ' und Art. ', 1 + doc_id % 50, ' StGB sowie BGBl. I Nr. ', 1 + doc_id % 80, '/2010, CELEX 3', 2000 + doc_id % 20, 'R0', 100 + doc_id % 300)"""


def _cited(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    t = F.concat(F.lit("Nach SR "), 100 + i % 900, F.lit("."), i % 7, F.lit(" und Art. "), 1 + i % 50, F.lit(" StGB sowie BGBl. I Nr. "), 1 + i % 80, F.lit("/2010, CELEX 3"), 2000 + i % 20, F.lit("R0"), 100 + i % 300)
    return citations.extract(table(spark, sf_dir, "documents").select("doc_id", t.alias("t")), "t").select("doc_id", "citation_type", "citation_text", "citation_key")


_KEYS = f"""
    WITH t AS (SELECT doc_id, {_CITE} AS t FROM documents),
    c AS (
        SELECT doc_id, 'sr' AS citation_type, regexp_extract(t, 'SR \\d+\\.\\d+') AS citation_text, 'sr:' || regexp_extract(t, 'SR (\\d+\\.\\d+)', 1) AS citation_key FROM t
        UNION ALL SELECT doc_id, 'at_bgbl', regexp_extract(t, 'BGBl\\. I Nr\\. \\d+/\\d+'), 'at_bgbl:i:' || regexp_extract(t, 'Nr\\. (\\d+/\\d+)', 1) FROM t
        UNION ALL SELECT doc_id, 'eu_celex', regexp_extract(t, '3\\d{{4}}R\\d{{4}}'), 'celex:' || regexp_extract(t, '3\\d{{4}}R\\d{{4}}') FROM t
        UNION ALL SELECT doc_id, 'article', regexp_extract(t, 'Art\\. \\d+ StGB'), 'abbrev_art:StGB/' || regexp_extract(t, 'Art\\. (\\d+)', 1) FROM t)"""


@query(_KEYS + "SELECT * FROM c")
def citation_keys(spark, sf_dir):
    """C1 to C23, U3 on text made from ids: citations with their keys."""
    return _cited(spark, sf_dir)


_RESOLVED = _KEYS + """,
    g AS (SELECT 'd' || doc_id AS document_id, 'sr:' || (100 + doc_id % 900) || '.' || (doc_id % 7) AS k FROM documents WHERE doc_id % 3 = 0),
    p AS (SELECT k, count(DISTINCT document_id) AS n, min(document_id) AS d FROM g GROUP BY k),
    r AS (SELECT c.*, CASE WHEN citation_key IS NULL THEN 'not_normalizable' WHEN n IS NULL THEN 'no_target_in_corpus' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution_status, CASE WHEN n = 1 THEN d END AS target_document_id
        FROM c LEFT JOIN p ON citation_key = k)"""


def _resolved(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    targets = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("d"), i).alias("document_id"), F.lit(None).cast("string").alias("section_id"), F.concat(F.lit("sr:"), 100 + i % 900, F.lit("."), i % 7).alias("target_key"))
    return citations.resolve(_cited(spark, sf_dir), targets)


@query(_RESOLVED + "SELECT doc_id, citation_type, citation_text, citation_key, resolution_status, target_document_id FROM r")
def citation_resolve(spark, sf_dir):
    """Citations against every third document's register number."""
    return _resolved(spark, sf_dir).select("doc_id", "citation_type", "citation_text", "citation_key", "resolution_status", "target_document_id")


@query(_RESOLVED + "SELECT count(*) AS total, count(citation_key) AS with_key, count(*) FILTER (resolution_status = 'resolved') AS resolved, round(count(*) FILTER (resolution_status = 'resolved') / count(*), 4) AS rate FROM r")
def citation_stats(spark, sf_dir):
    """How many citations resolve."""
    return citations.resolution_stats(_resolved(spark, sf_dir))


_TOKENS = r"""
    WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(replace(replace(replace(translate(lower(coalesce(text, '')), 'äöü', 'aou'), 'ß', 'ss'), 'ae', 'a'), 'oe', 'o'), '(^|[^aeq])ue', '\1u', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),"""


@query(_TOKENS + r"""
    s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM t),
    p AS (SELECT doc_id, len(ws) AS dl, token, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS token FROM t) WHERE token IN ('the', 'license', 'version') GROUP BY ALL),
    f AS (SELECT token, count(*) AS df FROM p GROUP BY token)
    SELECT doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
    FROM p JOIN f USING (token), s GROUP BY doc_id ORDER BY sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) DESC, doc_id LIMIT 50""")
def bm25_top(spark, sf_dir):
    """The best documents for three words, from the stored index; blocks that cannot reach the best are not read."""
    index = SearchIndex.current(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", ["text"], "text")
    return index.top(search.query_tokens("the license version"), 50, {"text": 1.0}).select("doc", F.round("score", 6).alias("score"))


@query(_TOKENS + " p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS token FROM t) GROUP BY ALL) SELECT token, count(*) AS df, sum(tf)::BIGINT AS occurrences, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM p GROUP BY token")
def stored_postings(spark, sf_dir):
    """What the stored index holds of each token, read back from its blocks."""
    index = SearchIndex.current(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", ["text"], "text")
    tf = F.aggregate("postings", F.lit(0).cast("long"), lambda total, p: total + p["tf"])
    b = index.blocks.select("token", F.size("postings").cast("long").alias("df"), tf.alias("tf"), F.array_min("postings.doc").alias("first"), F.array_max("postings.doc").alias("last"))
    return b.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("occurrences"), F.min("first").alias("first_doc"), F.max("last").alias("last_doc"))


@query(_TOKENS + r"""
    v AS (SELECT DISTINCT unnest(ws) AS token FROM t),
    q AS (SELECT DISTINCT token AS query FROM v WHERE token IN (SELECT lower(split_part(p_type, ' ', 3)) FROM part UNION SELECT lower(n_name) FROM nation) UNION SELECT lower(split_part(p_type, ' ', 1)) FROM part UNION SELECT lower(o_orderpriority[3:]) FROM orders)
    SELECT token, query FROM v JOIN q ON left(token, 2) = left(query, 2) AND levenshtein(token, query) <= CASE WHEN length(query) <= 2 THEN 0 WHEN length(query) <= 5 THEN 1 ELSE 2 END""")
def near_words(spark, sf_dir):
    """The words of the corpus near those of other tables, by the stored neighbourhoods."""
    index = SearchIndex.current(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", ["text"], "text")
    part, nation, orders = (table(spark, sf_dir, t) for t in ("part", "nation", "orders"))
    there = part.select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(3))).alias("w")).unionByName(nation.select(F.lower("n_name").alias("w"))).distinct()
    held = there.join(index.blocks.select(F.col("token").alias("w")).distinct(), "w", "left_semi")
    asked = held.unionByName(part.select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("w"))).unionByName(orders.select(F.lower(F.substring("o_orderpriority", 3, 100)).alias("w"))).distinct()
    return index.near_words([r.w for r in asked.collect()])  # the words of a few types, nations and priorities


_SPARSE = """
    WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS f, unnest(embedding)::DOUBLE AS w FROM embeddings),
    d AS (SELECT vec_id AS doc_id, 't' || f AS feature, w FROM e WHERE w >= 0.01),
    q AS (SELECT doc_id AS query_id, feature, w FROM d WHERE doc_id % 50 = 0),
    s AS (SELECT query_id, doc_id, sum(q.w * d.w) AS score FROM q JOIN d USING (feature) GROUP BY ALL)"""


def _sparse(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("f", "w"))
    d = e.select("doc_id", F.concat(F.lit("t"), F.col("f")).alias("feature"), F.col("w").cast("double").alias("weight")).where(F.col("weight") >= sparse.LEAST_WEIGHT)
    q = d.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return q.withColumn("mass", F.sum("weight").over(Window.partitionBy("query_id"))), d


@query(_SPARSE + "SELECT query_id, doc_id, round(score, 6) AS score FROM s")
def sparse_dot(spark, sf_dir):
    """Positive embedding entries stand for sparse features; every fiftieth vector is a query."""
    q, d = _sparse(spark, sf_dir)
    return sparse.dot(q, d, 6)


@query(_SPARSE + """,
    m AS (SELECT query_id, sum(w) AS mass FROM q GROUP BY query_id),
    k AS (SELECT query_id, count(*) AS candidates, max(score) AS top_score FROM s GROUP BY query_id)
    SELECT query_id, round(mass, 6) AS mass, coalesce(candidates, 0) AS candidates, round(top_score / mass, 6) AS coverage,
        CASE WHEN candidates IS NULL THEN 'no_candidates' WHEN mass <= 0 THEN 'unscorable' WHEN top_score / mass < 0.08 THEN 'below_floor' ELSE 'admitted' END AS verdict
    FROM m LEFT JOIN k USING (query_id)""")
def gate_verdict(spark, sf_dir):
    """The abstention gate over the same scores."""
    q, d = _sparse(spark, sf_dir)
    shared_folder(spark)  # for the checkpoint
    g = sparse.gate(q, sparse.products(q, d, sparse.TOP).checkpoint())  # read twice, a few rows for each query and block
    return g.select("query_id", F.round("mass", 6).alias("mass"), "candidates", F.round("coverage", 6).alias("coverage"), "verdict")


@query("""
    SELECT 'status_accepted' AS rule, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS failures FROM orders
    UNION ALL SELECT 'price_between', count(*) FILTER (o_totalprice NOT BETWEEN 0 AND 450000) FROM orders
    UNION ALL SELECT 'priority_pattern', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-5]-')) FROM orders
    UNION ALL SELECT 'orderkey_unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'line_unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'order_exists', count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey""")
def quality_report(spark, sf_dir):
    """Q1 to Q5: rules on orders and their lines."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = data_quality.row_rules(o, {"status_accepted": data_quality.accepted("o_orderstatus", ["O", "F"]), "price_between": data_quality.between("o_totalprice", 0, 450000), "priority_pattern": data_quality.matches("o_orderpriority", "^[1-5]-")})
    sets = data_quality.run({"orderkey_unique": data_quality.not_unique(o, "o_orderkey"), "line_unique": data_quality.not_unique(li, "l_orderkey", "l_linenumber"), "order_exists": data_quality.unrelated(li, "l_orderkey", o, "o_orderkey")})
    return rows.unionByName(sets)


@query(r"""
    WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
    s AS (SELECT page_id, split_part(u, '?', 1) AS base, CASE WHEN contains(u, '?') THEN regexp_extract(u, '\?(.*)$', 1) ELSE '' END AS q FROM u),
    k AS (SELECT page_id, base, array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('ref', 'utm_source')), '&') AS kept FROM s)
    SELECT page_id, CASE WHEN kept = '' THEN b ELSE b || '?' || kept END AS url FROM (SELECT page_id, kept, CASE WHEN regexp_matches(base, '^\w+://[^/]+$') THEN base || '/' ELSE base END AS b FROM k)""")
def url_canonical(spark, sf_dir):
    """F16: page addresses without tracking parameters."""
    return table(spark, sf_dir, "pages").select("page_id", text.url_canonical("url", ("ref", "utm_source")).alias("url"))


@query(r"""
    WITH v AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM pages)
    SELECT page_id, length(t)::INTEGER AS visible_chars, coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>'), lambda x: length(x))), 0)::INTEGER AS script_chars,
        len(regexp_extract_all(t, '(?i)art\.|artikel|§|abs\.|ziff\.|\bcomma\b|\blett\.|\blit\.|\balinéa\b|cpv\.|\bcapoverso\b|\blet\.'))::INTEGER AS marker_count FROM v""")
def legal_density(spark, sf_dir):
    """Scripts and visible text of pages."""
    return gates.legal_density(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "html").select("page_id", "visible_chars", "script_chars", "marker_count")


@query(r"""
    WITH g AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(trim(lower(text), E' \n\t'), '\s+'), lambda w: length(w) > 3)) AS ws FROM benchmark),
    p AS (SELECT item_id, lower(d.text) AS answer, ws FROM g JOIN documents d ON d.doc_id = item_id)
    SELECT item_id, round(len(list_filter(ws, lambda w: contains(answer, w))) / len(ws), 3) AS correctness FROM p WHERE len(ws) > 0""")
def eval_scores(spark, sf_dir):
    """Q10: the document of the same id answers a benchmark item."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer")), "item_id")
    return b.select("item_id", F.round(evaluation.overlap(F.col("gold"), F.col("answer")), 3).alias("correctness"))


_SESSION = """
    WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    s AS (SELECT *, 1 + sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)"""


def _sessions(spark, sf_dir) -> DataFrame:
    return windows.with_session(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600, F.col("event_id"))


@query(_SESSION + "SELECT user_id, session::BIGINT AS session, count(*) AS n, epoch_us(min(ts)) AS from_us, epoch_us(max(ts)) AS to_us FROM s GROUP BY user_id, session")
def session_windows(spark, sf_dir):
    """Sessions of users with a gap of six hours."""
    return _sessions(spark, sf_dir).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("from_us"), F.unix_micros(F.max("ts")).alias("to_us"))


@query(_SESSION + """,
    f AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - epoch_us(ts) AS d FROM s)
    SELECT count(*) FILTER (event_type = 'click') AS searches, count(*) FILTER (event_type = 'click' AND d <= 21600000000) AS focused, round(count(*) FILTER (event_type = 'click' AND d <= 21600000000) / count(*) FILTER (event_type = 'click'), 6) AS focus_rate FROM f""")
def focus_funnel(spark, sf_dir):
    """Clicks that a purchase follows within six hours in the session."""
    s = _sessions(spark, sf_dir).withColumn("key", F.concat_ws("/", "user_id", "session"))
    return A.funnel(s, "key", "event_type", "ts", 6 * 3600, "click", "purchase").withColumn("focus_rate", F.round("focus_rate", 6))


@query("""
    WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS f FROM orders),
    p AS (SELECT o_custkey, arg_max(o_orderkey, (f, o_orderkey)) AS k, max(f) AS f FROM v WHERE f <= DATE '1996-06-30' GROUP BY 1),
    n AS (SELECT o_custkey, arg_min(o_orderkey, (f, o_orderkey)) AS k, min(f) AS f FROM v WHERE f > DATE '1996-06-30' GROUP BY 1)
    SELECT o_custkey, coalesce(p.k, n.k) AS o_orderkey, strftime(coalesce(p.f, n.f), '%Y-%m-%d') AS start, p.k IS NOT NULL AS in_force FROM p FULL JOIN n USING (o_custkey)""")
def asof_version(spark, sf_dir):
    """Each customer's order as of a date."""
    v = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("f"), F.lit(None).cast("date").alias("u"))
    out = joins.as_of(v, ["o_custkey"], "o_orderkey", "f", "u", F.lit("1996-06-30").cast("date"))
    return out.select("o_custkey", "o_orderkey", F.date_format("f", "yyyy-MM-dd").alias("start"), "in_force")


@query("""
    WITH r AS (SELECT event_id, user_id, floor(value)::BIGINT AS revision, max(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
    SELECT event_id, user_id, revision, CASE WHEN revision < before THEN 'stale' ELSE 'applied' END AS outcome FROM r""")
def event_dedupe_stale(spark, sf_dir):
    """Events as revisions of a user, in order of arrival."""
    from quillon.streaming.projection import outcomes

    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").alias("revision"))
    return outcomes(e, "event_id", "user_id", "revision", "event_id").select("event_id", "user_id", "revision", "outcome")


# --- further operators, each on stand-in columns ---


@query("""
    SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 2000 AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'license')""")
def refined_documents(spark, sf_dir):
    """Terms, range and text refinements together."""
    d = table(spark, sf_dir, "documents")
    wanted = predicates.parse_refinements([{"kind": "terms", "field": "lang", "values": ["EN", "DE"]}, {"kind": "range", "field": "n_chars", "min": 200, "max": 2000}, {"kind": "text", "field": "text", "value": "License"}])
    return predicates.refine(d, wanted).select("doc_id")


@query("""
    SELECT DISTINCT o_orderkey, c_custkey FROM (
        SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_orderkey = c_custkey)""")
def disjunctive_join(spark, sf_dir):
    """All orders with the customers that they name by either of two keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.either_key(o, table(spark, sf_dir, "customer").select("c_custkey"), ["o_custkey", "o_orderkey"], ["c_custkey", "c_custkey"], "o_orderkey").select("o_orderkey", F.col("r_c_custkey").alias("c_custkey"))


@query("""
    WITH want AS (SELECT DISTINCT n_name AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'ATLANTIS'),
    have AS (SELECT n_name AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT k, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS held FROM want FULL JOIN have USING (k)""")
def requested_keys(spark, sf_dir):
    """Requested nations, those of suppliers, and held ones, those of customers, with zeros."""
    n = table(spark, sf_dir, "nation")
    want = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("k")).distinct().unionByName(spark.createDataFrame([("ATLANTIS",)], "k string"))
    have = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("k")).agg(F.count("*").alias("n"))
    return joins.requested(want, have, "k", "n")


@query("""
    WITH o AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), p AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 10 <> 3 OR lang = 'en' GROUP BY lang)
    SELECT lang, o.n AS observed, p.n AS published, coalesce(o.n = p.n, false) AS complete FROM o FULL JOIN p USING (lang)""")
def observed_vs_published(spark, sf_dir):
    """Counts by language against a smaller publication."""
    d = table(spark, sf_dir, "documents")
    n = F.count("*").alias("n")
    return A.completeness(d.groupBy("lang").agg(n), d.where("doc_id % 10 <> 3 OR lang = 'en'").groupBy("lang").agg(n), "lang")


@query("""
    WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS f, unnest(embedding)::DOUBLE AS w FROM embeddings)
    SELECT label, 't' || f AS feature, max(w) AS weight FROM e WHERE w >= 0.01 GROUP BY ALL""")
def pooled_features(spark, sf_dir):
    """The greatest weight of each feature by label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("f", "w")).where("w >= 0.01")
    m = e.select("label", F.create_map(F.concat(F.lit("t"), F.col("f")), F.col("w").cast("double")).alias("m"))
    return A.pooled_max(m, "label", "m")


@query("""
    SELECT user_id, arg_min(CASE WHEN event_type <> 'view' THEN event_type END, event_id) AS first_type, (SELECT e2.value FROM events e2 WHERE e2.user_id = e.user_id AND e2.value > 40 ORDER BY e2.event_id LIMIT 1) AS first_large
    FROM events e GROUP BY user_id""")
def first_known_values(spark, sf_dir):
    """A user's first event that is no view, and first value over 40."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("first_type"), F.when(F.col("value") > 40, F.col("value")).alias("first_large"))
    return windows.first_known(e, ["user_id"], ["first_type", "first_large"], F.col("event_id"))


@query("""
    SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def first_occurrence(spark, sf_dir):
    """Of equal texts the first."""
    from quillon.operators import sets

    d = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    return sets.first_occurrences(d, ["h"], "doc_id").select("doc_id", "source")


@query("""
    WITH r AS (SELECT *, CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 END AS rank FROM documents),
    a AS (SELECT *, count(rank) OVER (PARTITION BY source) AS known FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM a WHERE rank IS NOT NULL OR known = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank NULLS LAST, lang, doc_id) AS place FROM o WHERE n = 1)
    SELECT source, lang, doc_id, place::INTEGER AS place FROM p WHERE place <= 2""")
def preferred_languages(spark, sf_dir):
    """U8: of each source a German and a French document, in this order."""
    from quillon.operators import sets

    return sets.preferred(table(spark, sf_dir, "documents"), ["source"], "lang", ["de", "fr"], 2, "doc_id").select("source", "lang", "doc_id", "place")


@query("""
    WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM c) WHERE rn = 1""")
def modal_priority(spark, sf_dir):
    """The most common priority of each customer."""
    return A.modal(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT lang, source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY ALL")
def shares(spark, sf_dir):
    """Counts and shares of the whole."""
    return A.share_of_total(table(spark, sf_dir, "documents"), ["lang", "source"]).withColumn("share", F.round("share", 6))


@query("""
    SELECT event_type, count(*) FILTER ((props->>'$.k')::INT < 10) AS n_low, count(*) FILTER ((props->>'$.k')::INT >= 10 OR props->>'$.k' IS NULL) AS n_other FROM events GROUP BY event_type""")
def json_outcomes(spark, sf_dir):
    """Counters from JSON; small keys stand for an outcome."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("payload", F.when(k < 10, F.lit('{"outcome": "low"}')).otherwise(F.lit("{}")))
    return A.json_counters(e, ["event_type"], "payload", ["low"])


@query("""
    SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase FROM events GROUP BY user_id""")
def status_histogram(spark, sf_dir):
    """A histogram of event types as columns."""
    return A.status_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "error", "purchase"])


@query("""
    SELECT source AS key, count(*) AS documents, max(doc_id) AS newest, count(*) FILTER (doc_id IS NULL) AS missing, array_to_string((list(DISTINCT 'd' || doc_id ORDER BY 'd' || doc_id))[1:5], ',') AS sample, true AS held
    FROM documents GROUP BY source UNION ALL SELECT 'nowhere', 0, NULL, NULL, NULL, false""")
def index_coverage(spark, sf_dir):
    """Documents by source, with one requested source that has none."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), F.col("doc_id").alias("updated"), F.array("source").alias("ids"))
    out = coverage.index_coverage(d, "ids", spark.createDataFrame([("nowhere",), ("src0",)], "key string"), "updated", 5)
    return out.withColumn("sample", F.array_join("sample", ","))


@query("""
    WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(replace(replace(replace(replace(translate(t, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss'), 'ae', 'a'), 'oe', 'o'), 'ue', 'u'), '[^a-z]+'), lambda x: x <> '')))[1:10], ' ') AS first_words FROM t""")
def folded_words(spark, sf_dir):
    """folded words of texts, the first ten in order of the alphabet."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.array_sort(F.array_distinct(text.letters(F.coalesce("text", F.lit(""))))), 1, 10), " ").alias("first_words"))


@query("""
    WITH k AS (SELECT p_partkey, p_name, 'Brand' AS cls, CASE WHEN p_type = 'ECONOMY' AND p_size > 25 THEN 'large_economy' WHEN p_type = 'ECONOMY' THEN 'economy' WHEN p_size > 25 THEN 'large' ELSE 'standard' END AS policy FROM part)
    SELECT p_partkey, policy FROM k""")
def policy_rules(spark, sf_dir):
    """The first rule that matches, with a default."""
    p = table(spark, sf_dir, "part").withColumn("big", F.when(F.col("p_size") > 25, "y").otherwise("n"))
    rule = predicates.first_rule([({"p_type": "ECONOMY", "big": "y"}, "large_economy"), ({"p_type": "ECONOMY"}, "economy"), ({"big": "y"}, "large")], "standard")
    return p.select("p_partkey", rule.alias("policy"))


@query("""
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50""")
def keyset_page(spark, sf_dir):
    """The page after a key."""
    rows, _ = A.keyset_page(table(spark, sf_dir, "orders"), "o_orderkey", 100, 50)
    return rows.select("o_orderkey", "o_custkey")


@query("""
    WITH prior AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0), cur AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
    SELECT coalesce(p.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN p.o_orderkey IS NULL THEN 'added' WHEN c.o_orderkey IS NULL THEN 'removed' WHEN p.o_orderstatus <> c.o_orderstatus THEN 'changed' ELSE 'same' END AS change
    FROM prior p FULL JOIN cur c ON p.o_orderkey = c.o_orderkey""")
def semantic_diff(spark, sf_dir):
    """What changed between two states, by the compared column alone."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return mutation.changed_keys(o.where("o_orderkey % 2 = 0"), new, "o_orderkey", ["o_orderstatus"])


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, before FROM (
        SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS before FROM lineitem) WHERE l_linenumber <= before""")
def disordered_lines(spark, sf_dir):
    """Q8: lines whose number does not exceed the one before in order of part."""
    li = table(spark, sf_dir, "lineitem").withColumn("arrival", F.struct("l_partkey", "l_linenumber"))
    return data_quality.disordered(li, ["l_orderkey"], "l_linenumber", "arrival").select("l_orderkey", "l_linenumber", "l_partkey", "before")


@query(r"""
    WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS p, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS flat FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, CASE WHEN len(p) = 1 AND length(p[1]) > 900 THEN list_filter(list_transform(string_split(regexp_replace(flat, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') ELSE p END AS p FROM t)
    SELECT doc_id, (i - 1)::INTEGER AS passage_idx, sha256(p[i]) AS passage_sha FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM c)""")
def passages(spark, sf_dir):
    """Passages of all texts; long single paragraphs are cut after sentences."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunking.passages(d, "text").select("doc_id", "passage_idx", F.sha2("passage", 256).alias("passage_sha"))


@query(r"""
    SELECT page_id, CASE WHEN regexp_matches(t, '(?i)\b(decision|judg(?:e)?ment|order|case|ruling)\b') THEN 'decision' WHEN regexp_matches(t, '(?i)\b(privacy|terms|impressum|contact|about|help|faq|cookie|sitemap)\b') THEN 'boilerplate' ELSE 'other' END AS kind,
        regexp_matches(lower(url), '\.pdf$') AS pdf FROM (SELECT page_id, url, url || ' ' || html AS t FROM pages)""")
def page_kinds(spark, sf_dir):
    """What pages look like by their words."""
    p = table(spark, sf_dir, "pages")
    return p.withColumn("page_type", F.lit(None).cast("string")).select("page_id", predicates.page_kind("url", "html").alias("kind"), predicates.is_pdf("page_type", "url").alias("pdf"))


@query(r"""
    WITH h AS (SELECT page_id, lower(regexp_replace(html, '^\s+', '')) AS h FROM pages), s AS (SELECT page_id, substr(h, 1, 500) AS h FROM h)
    SELECT page_id, CASE WHEN h LIKE '<!doctype html%' OR contains(h, '<html') OR contains(h, '<body') THEN 'html' WHEN h LIKE '<?xml%' THEN 'xml' END AS modality FROM s""")
def modalities(spark, sf_dir):
    """what kind of text pages are."""
    return table(spark, sf_dir, "pages").select("page_id", text.modality("html").alias("modality"))


@query()
def html_sections(spark, sf_dir):
    """Pages as sections; a stateful parser has no SQL."""
    from quillon.operators import normalise

    p = normalise.html_blocks(table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return normalise.sections(p, "page_id").select("page_id", "ordinal", "title", "depth", "section_type", F.length("content").alias("n_chars"))


@query("""
    WITH s AS (
        SELECT o_orderkey AS k, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 7 = 1 THEN 'X' ELSE o_orderstatus END END AS a1,
            CASE WHEN k % 3 > 0 THEN CASE WHEN k % 7 = 2 THEN 'X' ELSE o_orderstatus END END AS a2, CASE WHEN k % 5 > 0 THEN CASE WHEN k % 7 = 3 THEN 'X' ELSE o_orderstatus END END AS a3 FROM orders),
    r AS (
        SELECT k, a1 AS st, 1 AS f, CASE WHEN a2 IS NOT DISTINCT FROM a1 THEN CASE WHEN a3 IS NOT DISTINCT FROM a1 THEN NULL ELSE 3 END ELSE 2 END AS t FROM s WHERE a1 IS NOT NULL
        UNION ALL SELECT k, a2, 2, CASE WHEN a3 IS NOT DISTINCT FROM a2 THEN NULL ELSE 3 END FROM s WHERE a2 IS NOT NULL AND a1 IS DISTINCT FROM a2
        UNION ALL SELECT k, a3, 3, NULL FROM s WHERE a3 IS NOT NULL AND a2 IS DISTINCT FROM a3)
    SELECT k AS o_orderkey, st AS o_orderstatus, epoch_us(TIMESTAMP '2023-12-31' + to_days(f)) AS from_us, epoch_us(TIMESTAMP '2023-12-31' + to_days(t)) AS to_us FROM r""")
def scd2_steps(spark, sf_dir):
    """M3: history by snapshots, three loads of all orders' statuses."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    history = spark.createDataFrame([], "o_orderkey long, o_orderstatus string, valid_from timestamp, valid_to timestamp")
    for i, keep in enumerate(("o_orderkey % 2 = 0", "o_orderkey % 3 > 0", "o_orderkey % 5 > 0"), 1):
        state = o.where(keep).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == i, "X").otherwise(F.col("o_orderstatus")))
        history = mutation.scd2_apply(history, state, "o_orderkey", ["o_orderstatus"], F.lit(f"2024-01-0{i}").cast("timestamp"))
    return history.select("o_orderkey", "o_orderstatus", F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"))
