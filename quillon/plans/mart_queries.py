"""Registered queries that call the marts plan and the control plane's read models on frames built from the driver's tables.

Documents stand for captured envelopes, their lines for sections, orders for manifests and runs, events for processing events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans import control_plane, marts
from quillon.plans.registry import query
from quillon.sources.schemas import BRONZE, conform
from quillon.sources.tables import table

_SV = "sha256(concat_ws('||', source, uri, checksum))"
_ENV = f"""
    WITH e0 AS (SELECT doc_id, 'i' || doc_id AS ingestion_id, source, 'u' || doc_id % 50 AS uri, sha256(coalesce(text, '')) AS checksum, coalesce(lang, 'xx') AS language, text, n_chars,
        CASE WHEN doc_id % 4 > 0 THEN 'CH' ELSE 'UNKNOWN' END AS country, TIMESTAMP '2024-01-01' + to_hours((doc_id % 300)::INTEGER) AS retrieved_at, CASE WHEN doc_id % 3 > 0 THEN 's' || doc_id % 40 END AS sid
        FROM documents WHERE doc_id % 5 > 0 AND doc_id % 7 > 0),
    e1 AS (SELECT *, {_SV} AS version, CASE WHEN sid IS NOT NULL THEN sha256(concat_ws('||', source, sid, language)) ELSE sha256(concat_ws('||', source, uri)) END AS document FROM e0),
    ids AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY retrieved_at DESC, ingestion_id DESC) AS rn FROM e1) WHERE rn = 1)"""


def _staged(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=(i % 300).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("i"), i).alias("ingestion_id"), F.col("source").alias("source_system"), F.concat(F.lit("u"), i % 50).alias("source_uri"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"),
        F.coalesce("lang", F.lit("xx")).alias("language"), F.when(i % 4 > 0, "CH").alias("country"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("retrieved_at"), F.when(i % 3 > 0, F.concat(F.lit("s"), i % 40)).alias("source_document_id"),
        F.when(i % 5 > 0, "document_candidate").otherwise("image").alias("artifact_type"), F.when(i % 7 > 0, "200").otherwise("gone").alias("http_status"), F.concat(F.lit("Title "), i).alias("title"), F.lit("x").alias("discovery_depth"), F.lit("court").alias("authority_name"),
    )
    return marts.landing(conform(rows, BRONZE["landing_envelopes"]))


@query(_ENV + """
    SELECT ingestion_id, document AS document_id, version AS document_version_id, country, checksum AS content_hash, epoch_us(retrieved_at) AS at_us,
        NOT EXISTS (SELECT 1 FROM ids p WHERE p.document = ids.document AND p.checksum = ids.checksum AND p.doc_id % 2 = 0) AS is_new_version FROM ids""")
def mart_identity(spark, sf_dir):
    """Landed candidates, typed with defaults, their ids, and what is new beside every second one."""
    ids = marts.identity(_staged(spark, sf_dir))
    prior = ids.where(F.substring("ingestion_id", 2, 20).cast("long") % 2 == 0)
    return marts.identity(_staged(spark, sf_dir), prior).select("ingestion_id", "document_id", "document_version_id", "country", "content_hash", F.unix_micros("retrieved_at").alias("at_us"), "is_new_version")


_SECTIONS = _ENV + r""",
    ln AS (SELECT ids.*, string_split(text, chr(10)) AS ls FROM ids WHERE text IS NOT NULL),
    sec AS (SELECT *, ls[k] AS content, (k - 1)::INTEGER AS section_idx FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM ln) WHERE length(trim(ls[k], ' ')) > 0)"""


def _parsed(spark, sf_dir) -> DataFrame:
    """Bronze parser output of the staged documents: each line of a text is a section."""
    ids = marts.identity(_staged(spark, sf_dir)).select("ingestion_id", "document_version_id")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("i"), F.col("doc_id")).alias("ingestion_id"), "text", "lang")
    section = lambda x, k: F.struct(F.concat(F.lit("H"), k).alias("heading"), (k % 3 + 1).alias("level"), x.alias("content"), (k + F.lit(0)).alias("page_number"))
    body = F.to_json(F.struct(F.lit("Parsed").alias("title"), F.coalesce("lang", F.lit("none")).alias("document_type"), F.transform(F.split("text", "\n"), section).alias("sections")))
    raw = d.join(ids, "ingestion_id").select("document_version_id", F.col("ingestion_id").alias("file_id"), F.lit("2024-02-01 00:00:00").alias("processed_at"), body.alias("docling_json"))
    return marts.docling(conform(raw, BRONZE["raw_docling_output"]))


@query(_SECTIONS + """
    SELECT sha256(concat_ws('||', version, section_idx::VARCHAR)) AS section_id, section_idx, ingestion_id AS file_id, 'H' || section_idx AS section_heading, section_idx % 3 + 1 AS heading_level, sha256(content) AS content_sha, length(content)::INTEGER AS chars, section_idx AS page_number FROM sec""")
def mart_sections(spark, sf_dir):
    """Sections out of parsed JSON; those without content are dropped and keep no place."""
    return marts.sections(_parsed(spark, sf_dir)).select("section_id", "section_idx", "file_id", "section_heading", "heading_level", F.sha2("section_content", 256).alias("content_sha"), F.col("content_length_chars").alias("chars"), "page_number")


_NLP = _SECTIONS + """,
    ent AS (
        SELECT version, ingestion_id, section_idx, p AS pos, ['ORG', 'LAW', 'X'][p + 1] AS label, CASE WHEN p = 1 THEN 'Art. ' || section_idx ELSE 'E' || n_chars % 9 END AS t FROM sec, (SELECT unnest([0, 1, 2]) AS p)),
    kept AS (SELECT * FROM ent WHERE label <> 'X')"""


def _nlp(spark, sf_dir) -> DataFrame:
    """Bronze annotations: each section has an organisation, a law and a label that is not kept, and two relations."""
    n = table(spark, sf_dir, "documents").select(F.concat(F.lit("i"), F.col("doc_id")).alias("file_id"), "n_chars")
    s = marts.sections(_parsed(spark, sf_dir)).join(n, "file_id")
    entity = lambda t, label: F.struct(t.alias("text"), F.lit(label).alias("label"), F.lit(0).alias("start_char"))
    name = F.concat(F.lit("E"), F.col("n_chars") % 9)
    found = F.to_json(F.array(entity(name, "ORG"), entity(F.concat(F.lit("Art. "), F.col("section_idx")), "LAW"), entity(name, "X")))
    related = F.to_json(F.array(F.struct(F.lit("a").alias("head_text"), F.lit("nsubj").alias("relation")), F.struct(F.lit("b").alias("head_text"), F.lit("zzz").alias("relation"))))
    return conform(s.select("document_version_id", "file_id", F.col("section_idx").cast("string").alias("section_idx"), F.lit("m").alias("model_name"), found.alias("entities_json"), related.alias("relations_json")), BRONZE["raw_nlp_annotations"])


@query(_NLP + "SELECT sha256(concat_ws('||', version, section_idx::VARCHAR, pos::VARCHAR, label)) AS entity_id, ingestion_id AS file_id, t AS entity_text, label AS entity_label FROM kept")
def mart_entities(spark, sf_dir):
    """Entities out of JSON, of the labels that are kept."""
    return marts.entities(_nlp(spark, sf_dir)).select("entity_id", "file_id", "entity_text", "entity_label")


@query(_SECTIONS + "SELECT sha256(concat_ws('||', version, section_idx::VARCHAR, '0')) AS relation_id, 'nsubj' AS relation_type, 'a' AS head_text FROM sec")
def mart_relations(spark, sf_dir):
    """Relations out of JSON, of the kinds that are kept."""
    return marts.relations(_nlp(spark, sf_dir)).select("relation_id", "relation_type", "head_text")


_EVENTS = _ENV + """,
    ev AS (
        SELECT version, 'e' || event_id AS event_id, event_id % 4 + 1 AS attempt, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' ELSE 'noted' END AS kind, 'st' || event_id % 3 AS stage
        FROM events JOIN ids ON ids.doc_id = event_id % 200),
    ct AS (
        SELECT version, last(kind ORDER BY ts, attempt, event_id) AS k, last(stage ORDER BY ts, attempt, event_id) AS stage, count(*) AS n, count(*) FILTER (kind = 'failed') AS f FROM ev GROUP BY version),
    st AS (SELECT *, CASE WHEN k IN ('completed', 'succeeded') THEN 'done' WHEN k = 'failed' AND f >= 3 THEN 'dead_letter' WHEN k = 'failed' THEN 'retryable' WHEN k = 'started' THEN 'in_progress' ELSE 'processing' END AS status FROM ct)"""


def _processing(spark, sf_dir) -> DataFrame:
    """Bronze processing events of the staged versions."""
    ids = marts.identity(_staged(spark, sf_dir)).select(F.substring("ingestion_id", 2, 20).cast("long").alias("doc_id"), "document_version_id")
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % 200).join(ids, "doc_id")
    raw = rows.select(F.concat(F.lit("e"), F.col("event_id")).alias("event_id"), "document_version_id", F.concat(F.lit("st"), F.col("event_id") % 3).alias("stage"), (F.col("event_id") % 4 + 1).alias("attempt_number"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_timestamp"),
        F.when(kind == "purchase", "completed").when(kind == "signup", "succeeded").when(kind == "error", "failed").when(kind == "view", "started").otherwise("noted").alias("event_type"))
    return marts.events(conform(raw, BRONZE["document_processing_events"]))


@query(_EVENTS + "SELECT version AS document_version_id, k AS latest_event_type, stage AS current_stage, n AS total_events, f AS failed_attempts, status FROM st")
def mart_control(spark, sf_dir):
    """The status of each version from all its events."""
    return marts.control(_processing(spark, sf_dir)).select("document_version_id", "latest_event_type", "current_stage", "total_events", "failed_attempts", "status")


_DOCS = _NLP + "," + _EVENTS.split("AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY retrieved_at DESC, ingestion_id DESC) AS rn FROM e1) WHERE rn = 1),")[1] + """,
    cur AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY retrieved_at DESC, version DESC) = 1 AS is_current FROM ids),
    agg AS (SELECT version, count(*) AS n_sections, sum(length(content))::BIGINT AS chars, max(section_idx) AS pages, sha256(string_agg(content, ' ' ORDER BY section_idx)) AS search_sha, string_agg('H' || section_idx, ',' ORDER BY section_idx) AS headings FROM sec GROUP BY version),
    ea AS (SELECT version, string_agg(DISTINCT t, ',' ORDER BY t) FILTER (label = 'ORG') AS orgs, count(DISTINCT t) FILTER (label = 'LAW') AS n_laws, count(*) AS n_entities FROM kept GROUP BY version),
    sd AS (SELECT cur.*, agg.* EXCLUDE (version), orgs, n_laws, n_entities, CASE WHEN agg.version IS NOT NULL OR text IS NOT NULL THEN 'Parsed' ELSE 'Title ' || doc_id END AS title FROM cur JOIN st USING (version) LEFT JOIN agg USING (version) LEFT JOIN ea USING (version) WHERE status = 'done')"""


def _search_documents(spark, sf_dir) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    staged = _staged(spark, sf_dir)
    return marts.search_documents(marts.identity(staged), marts.control(_processing(spark, sf_dir)), staged, parsed, marts.sections(parsed), marts.entities(_nlp(spark, sf_dir)))


@query(_DOCS + "SELECT version AS document_version_id, document AS document_id, is_current AS is_current_version, title, n_sections AS section_count, chars AS total_chars, pages AS page_count, search_sha, headings, orgs, n_laws, n_entities AS entity_count FROM sd")
def mart_search_documents(spark, sf_dir):
    """The serving table of documents."""
    d = _search_documents(spark, sf_dir)
    return d.select("document_version_id", "document_id", "is_current_version", "title", "section_count", "total_chars", "page_count", F.sha2("search_text", 256).alias("search_sha"), F.array_join("headings", ",").alias("headings"), F.array_join("orgs", ",").alias("orgs"), F.size("legal_refs").cast("long").alias("n_laws"), "entity_count")


@query(_DOCS + """,
    ch AS (SELECT sd.version, sd.document, sec.section_idx, sec.content, unnest(range(0, greatest(0, ceil((length(sec.content) - 2048) / 1792.0))::BIGINT + 1)) AS i FROM sec JOIN sd USING (version) WHERE is_current)
    SELECT sha256(concat_ws('||', version, section_idx::VARCHAR, i::VARCHAR)) AS chunk_id, document AS document_id, section_idx % 3 + 1 AS heading_level, length(substr(content, i * 1792 + 1, 2048))::INTEGER AS chunk_length_chars, 'Parsed' AS document_title
    FROM ch WHERE length(trim(substr(content, i * 1792 + 1, 2048), ' ')) > 50""")
def mart_search_chunks(spark, sf_dir):
    """Chunks of the current versions, with the level of their section by a compound key."""
    sections = marts.sections(_parsed(spark, sf_dir))
    out = marts.search_chunks(marts.chunk_rows(sections), _search_documents(spark, sf_dir), sections)
    return out.select("chunk_id", "document_id", "heading_level", "chunk_length_chars", "document_title")


@query(_DOCS + """
    SELECT ids.version AS document_version_id, 'Parsed' AS document_title, 'http://' || ids.doc_id AS source_url, ids.language AS scraped_language, n_sections AS section_count, chars AS total_content_chars, n_entities AS entity_count, CASE WHEN n_entities > 0 THEN 2 END AS unique_label_count
    FROM ids LEFT JOIN agg USING (version) LEFT JOIN ea USING (version) WHERE ids.text IS NOT NULL""")
def mart_knowledge_base(spark, sf_dir):
    """One row per version with metadata, sections and entities."""
    i = F.concat(F.lit("i"), F.col("doc_id"))
    d = table(spark, sf_dir, "documents")
    raw = conform(d.select(i.alias("file_id"), F.concat(F.lit("http://"), "doc_id").alias("source_url")), BRONZE["raw_documents"])
    meta = conform(d.select(i.alias("file_id"), F.to_json(F.struct(F.coalesce("lang", F.lit("xx")).alias("language"))).alias("metadata_json")), BRONZE["raw_metadata"])
    parsed = _parsed(spark, sf_dir)
    kb = marts.knowledge_base(parsed, raw, meta, marts.sections(parsed), marts.entities(_nlp(spark, sf_dir)))
    return kb.select("document_version_id", "document_title", "source_url", F.col("scraped_meta")["language"].alias("scraped_language"), "section_count", "total_content_chars", "entity_count", "unique_label_count")


_MANIFESTS = """,
    mf AS (
        SELECT 'm' || o_orderkey AS manifest, o_orderkey AS k, document AS d, CASE o_orderstatus WHEN 'F' THEN 'canonical_ready' WHEN 'O' THEN 'quarantined' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'parse' END AS failure
        FROM orders JOIN (SELECT * FROM cur WHERE is_current) c ON c.doc_id = o_orderkey % 200)"""


def _manifests(spark, sf_dir) -> DataFrame:
    """Processing manifests: every order whose remainder names a current document; each tenth replaces the one ten before."""
    staged = _staged(spark, sf_dir)
    newest = marts.dim_document(marts.identity(staged), marts.identity(staged).select("document_id").distinct().withColumns({"valid_from": F.lit("2024-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")}))
    ids = marts.identity(staged).join(newest.select("document_version_id"), "document_version_id").select(F.substring("ingestion_id", 2, 20).cast("long").alias("doc_id"), "document_id")
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").withColumn("doc_id", k % 200).join(ids, "doc_id")
    return marts.manifests(rows.select(F.concat(F.lit("m"), k).alias("processing_manifest_id"), "document_id", F.when(st == "F", "canonical_ready").when(st == "O", "quarantined").otherwise("failed").alias("status"), F.col("o_orderdate").alias("canonical_ready_at"), F.when(k % 10 == 0, F.concat(F.lit("m"), k - 10)).alias("supersedes_processing_manifest_id"), F.when(st == "P", F.struct(F.lit("parse").alias("failure_type"), F.lit("x").alias("message"))).alias("failure"), F.lit(None).cast("string").alias("provenance"), F.lit(None).cast("string").alias("quarantine")))


@query(_DOCS + _MANIFESTS + """
    SELECT manifest AS processing_manifest_id, d AS document_id, mf.status = 'canonical_ready' AS is_success, failure IS NOT NULL AS has_failure, coalesce(n_entities, 0) AS entities_count, coalesce(n_sections, 0) AS relations_count, coalesce(ev.n, 0) AS event_count, ev.a AS max_attempt_number,
        floor(epoch(ev.hi))::BIGINT - floor(epoch(ev.lo))::BIGINT AS latency_s, k IN (SELECT k - 10 FROM mf WHERE k % 10 = 0) AS is_superseded, CASE WHEN cur.source IN ('src0', 'src1') THEN cur.source ELSE 'unknown' END AS source_system_code, sha256(concat_ws('||', d, '2024-01-01 00:00:00')) AS document_sk, country
    FROM mf JOIN cur ON cur.document = d AND cur.is_current LEFT JOIN agg USING (version) LEFT JOIN ea USING (version) LEFT JOIN (SELECT version, count(*) AS n, max(attempt) AS a, max(ts) AS hi, min(ts) AS lo FROM ev GROUP BY version) ev USING (version)""")
def mart_fact(spark, sf_dir):
    """One row per manifest with everything counted beside it."""
    staged = _staged(spark, sf_dir)
    ids, manifest_rows, nlp = marts.identity(staged), _manifests(spark, sf_dir), _nlp(spark, sf_dir)
    history = ids.select("document_id").distinct().withColumns({"valid_from": F.lit("2024-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    dim = marts.dim_document(ids, history)
    published = manifest_rows.where("status = 'canonical_ready'").select("processing_manifest_id", F.lit("active").alias("lifecycle_status"), F.lit("law").alias("document_type"), F.lit("t").alias("title"), F.col("canonical_ready_at").alias("processed_at"))
    sections = marts.sections(_parsed(spark, sf_dir))
    out = marts.fact(manifest_rows, published, ids, staged, marts.entities(nlp), marts.relations(nlp), marts.chunk_rows(sections), _processing(spark, sf_dir), dim, spark.createDataFrame([("src0",), ("src1",)], "source_system_code string"), spark.createDataFrame([("CH",)], "jurisdiction_code string"))
    return out.select("processing_manifest_id", "document_id", "is_success", "has_failure", "entities_count", "relations_count", "event_count", F.col("max_attempt_number").cast("long").alias("max_attempt_number"), F.col("total_latency_s").cast("long").alias("latency_s"), "is_superseded", "source_system_code", "document_sk", "country")


@query(_DOCS + _MANIFESTS + """
    SELECT 'ingestion_by_day' AS metric_set, concat_ws('|', source, country, strftime(retrieved_at, '%Y-%m-%d')) AS k, count(*) AS n, count(DISTINCT document) AS m FROM ids GROUP BY source, country, strftime(retrieved_at, '%Y-%m-%d')
    UNION ALL SELECT 'processing_outcomes', status, count(*), count(failure) FROM mf GROUP BY status
    UNION ALL SELECT 'stage_latency', stage, round(avg(s) * 100)::BIGINT, count(*) FILTER (kind = 'failed') FROM (SELECT stage, kind, floor(epoch(lead(ts) OVER (PARTITION BY version ORDER BY ts, event_id))) - floor(epoch(ts)) AS s FROM ev) GROUP BY stage
    UNION ALL SELECT 'content', language_or_none, count(*), round(avg(length(content)) * 100)::BIGINT FROM (SELECT content, CASE WHEN language = 'xx' THEN 'none' ELSE language END AS language_or_none FROM sec) GROUP BY ALL""")
def mart_analytics(spark, sf_dir):
    """Four sets of metrics, each row packed as JSON and read back."""
    staged = _staged(spark, sf_dir)
    out = marts.analytics(marts.identity(staged), _manifests(spark, sf_dir), _processing(spark, sf_dir), marts.sections(_parsed(spark, sf_dir)))
    g = lambda name: F.get_json_object("payload", f"$.{name}")
    s = F.col("metric_set")
    key = F.when(s == "ingestion_by_day", F.concat_ws("|", g("source_system"), g("country"), g("day"))).when(s == "processing_outcomes", g("status")).when(s == "stage_latency", g("stage")).otherwise(g("document_type"))
    hundredths = lambda c: F.round(c.cast("double") * 100).cast("long")
    n = F.when(s == "stage_latency", hundredths(g("avg_seconds"))).otherwise(F.coalesce(g("versions"), g("n"), g("sections")).cast("long"))
    m = F.when(s == "content", hundredths(g("avg_chars"))).otherwise(F.coalesce(g("documents"), g("failed"), g("failures")).cast("long"))
    return out.select("metric_set", key.alias("k"), n.alias("n"), m.alias("m"))


# The control plane: nations are jurisdictions, suppliers sources, orders runs, lines captured resources, events lifecycle events.
_PLANE = """
    WITH src AS (SELECT s_suppkey AS source_id, s_nationkey AS j, s_name AS name FROM supplier WHERE s_nationkey % 5 > 0),
    run AS (SELECT o_orderkey AS run_id, o_custkey % (SELECT count(*) FROM supplier) AS source_id, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'completed' END AS status, o_orderkey % 4 = 0 AS refused, o_orderdate FROM orders),
    cap AS (SELECT l_orderkey AS run_id, l_suppkey AS source_id, 'http://x/' || l_partkey AS url, l_shipdate, l_linenumber FROM lineitem),
    lif AS (SELECT event_id % (SELECT count(*) FROM orders) AS run_id, user_id AS document_id, CASE WHEN event_type = 'purchase' THEN 'document.processed' WHEN event_type = 'error' THEN 'document.withdrawn' ELSE 'other' END AS kind FROM events)"""


def _plane(spark, sf_dir) -> dict[str, DataFrame]:
    n, o, li, e = (table(spark, sf_dir, t) for t in ("nation", "orders", "lineitem", "events"))
    sources = table(spark, sf_dir, "supplier")
    n_sources, n_runs = sources.count(), o.count()
    k = F.col("n_nationkey")
    return {
        "jurisdictions": n.select(k.cast("string").alias("jurisdiction_id"), F.col("n_name").alias("name"), F.lit("cantonal").alias("level"), F.when(k % 2 == 0, "short").alias("compliance_policy_id")),
        "sources": sources.where("s_nationkey % 5 > 0").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").cast("string").alias("jurisdiction_id"), F.col("s_name").alias("name")),
        "runs": o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % n_sources).alias("source_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, '{"refused": true}').otherwise("{}").alias("run_metadata"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderkey") % 3).alias("source_version_id")),
        "captured": li.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("source_id"), F.concat(F.lit("http://x/"), F.col("l_partkey")).alias("final_url"), F.col("l_shipdate").alias("fetched_at"), F.col("l_linenumber").alias("artifact_id"), F.when(F.col("l_linenumber") > 1, (F.col("l_partkey") % 3).cast("string")).alias("checksum"), F.when(F.col("l_linenumber") % 2 == 0, "application/pdf").otherwise("text/html").alias("content_type"), F.when(F.col("l_partkey") % 5 == 0, "A decision").when(F.col("l_partkey") % 5 == 1, "Contact us").otherwise("Page").alias("title"), F.lit("u").alias("source_url")),
        "lifecycle": e.select((F.col("event_id") % n_runs).alias("run_id"), F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "purchase", "document.processed").when(F.col("event_type") == "error", "document.withdrawn").otherwise("other").alias("event_type")),
        "statuses": e.where("event_type = 'click'").select((F.col("event_id") % n_runs).alias("run_id"), F.col("user_id").alias("document_id"), F.lit("quarantined").alias("status")),
        "reconciliations": n.where("n_nationkey % 3 > 0").select(k.cast("string").alias("jurisdiction_id"), F.lit("ATTRIBUTED").alias("attribution_status"), (k * 7).alias("expected"), F.when(k % 2 == 0, "PUBLISHED").otherwise("ESTIMATED").alias("denominator_tier"), (k % 4 == 0).alias("truncated"), F.lit("2024-01-01").alias("as_of"), F.lit("r").alias("run_id")),
        "versions": spark.createDataFrame([(i, f"v{i}") for i in range(3)], "source_version_id long, version_label string"),
    }


_LEDGER = _PLANE + """,
    acq AS (SELECT j, count(*) AS n, count(DISTINCT url) AS urls FROM cap JOIN src USING (source_id) GROUP BY j),
    rj AS (SELECT run.*, j FROM run JOIN src USING (source_id)),
    lf AS (SELECT j, count(DISTINCT document_id) FILTER (kind = 'document.processed') AS p, count(DISTINCT document_id) FILTER (kind = 'document.withdrawn') AS w FROM lif JOIN rj USING (run_id) GROUP BY j),
    q AS (SELECT j, count(DISTINCT user_id) AS n FROM (SELECT event_id % (SELECT count(*) FROM orders) AS run_id, user_id FROM events WHERE event_type = 'click') JOIN rj USING (run_id) GROUP BY j),
    led AS (
        SELECT n_nationkey AS j, n_name AS name, coalesce(acq.n, 0) AS acquired, coalesce(urls, 0) AS acquired_urls, coalesce(p, 0) AS processed, coalesce(w, 0) AS withdrawn, coalesce((SELECT count(*) FROM rj WHERE rj.j = n_nationkey AND status = 'failed' AND refused), 0) AS refused, coalesce(q.n, 0) AS quarantined,
            CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 7 END AS expected, CASE WHEN n_nationkey % 3 = 0 THEN 'NONE' WHEN n_nationkey % 2 = 0 THEN 'PUBLISHED' ELSE 'ESTIMATED' END AS tier, n_nationkey % 3 > 0 AND n_nationkey % 2 = 0 AND n_nationkey % 4 > 0 AS known
        FROM nation LEFT JOIN acq ON acq.j = n_nationkey LEFT JOIN lf ON lf.j = n_nationkey LEFT JOIN q ON q.j = n_nationkey)"""


def _ledger(p: dict[str, DataFrame]) -> DataFrame:
    return control_plane.acquisition_ledger(p["jurisdictions"], p["sources"], p["runs"], p["captured"], p["lifecycle"], p["statuses"], p["reconciliations"])


@query(_LEDGER + "SELECT j::VARCHAR AS jurisdiction_id, acquired, acquired_urls, processed, withdrawn, refused, quarantined, expected, tier AS denominator_tier, CASE WHEN known THEN expected - acquired_urls END AS acquired_gap, CASE WHEN known THEN expected - processed END AS processed_gap FROM led")
def plane_ledger(spark, sf_dir):
    """Every stage's count per jurisdiction, and gaps against published counts alone."""
    return _ledger(_plane(spark, sf_dir)).select("jurisdiction_id", "acquired", "acquired_urls", "processed", "withdrawn", "refused", "quarantined", "expected", "denominator_tier", "acquired_gap", "processed_gap")


@query(_LEDGER + """,
    f AS (SELECT *, j IN (SELECT j FROM src) AS s, CASE WHEN known THEN expected - acquired_urls END AS a, CASE WHEN known THEN expected - processed END AS p FROM led),
    r AS (SELECT j, list_filter([CASE WHEN NOT s AND j % 10 > 0 THEN 'NO_SOURCE' END, CASE WHEN NOT s AND j % 10 = 0 THEN 'NO_SOURCE_TEMPLATE_AVAILABLE' END, CASE WHEN s AND expected IS NULL THEN 'NO_DENOMINATOR' END, CASE WHEN s AND acquired_urls = 0 THEN 'NEVER_ACQUIRED' END, CASE WHEN s AND a > 0 THEN 'ACQUISITION_GAP' END, CASE WHEN s AND p > 0 THEN 'PROCESSING_GAP' END,
        CASE WHEN s AND (a < 0 OR p < 0) THEN 'HOLDINGS_EXCEED_DENOMINATOR' END, CASE WHEN s AND refused > 0 THEN 'REFUSALS_OUTSTANDING' END], lambda x: x IS NOT NULL) AS reasons FROM f)
    SELECT j::VARCHAR AS jurisdiction_id, list_aggregate(reasons, 'string_agg', ',') AS reasons FROM r WHERE len(reasons) > 0""")
def plane_queue(spark, sf_dir):
    """The eight rules of the work queue."""
    p = _plane(spark, sf_dir)
    templated = p["jurisdictions"].where("jurisdiction_id % 10 = 0").select("jurisdiction_id")
    return control_plane.acquisition_queue(_ledger(p), p["sources"], templated).select("jurisdiction_id", F.array_join("reasons", ",").alias("reasons"))


@query(_PLANE + "SELECT run_id, name AS source_name, 'v' || run_id % 3 AS version_label, j::VARCHAR AS jurisdiction_id FROM run JOIN src USING (source_id)")
def plane_listing(spark, sf_dir):
    """Runs with the names of source and version."""
    p = _plane(spark, sf_dir)
    return control_plane.run_listing(p["runs"], p["sources"], p["versions"]).select("run_id", "source_name", "version_label", "jurisdiction_id")


@query("""
    WITH c AS (SELECT l_orderkey AS run_id, 'http://x/' || l_partkey AS url, l_linenumber AS n, l_partkey % 5 AS k, CASE WHEN l_linenumber > 1 THEN l_partkey % 3 END AS sum FROM lineitem),
    s AS (SELECT run_id, count(*) AS checksums, sum(m - 1)::BIGINT AS duplicates FROM (SELECT run_id, sum, count(*) AS m FROM c WHERE sum IS NOT NULL GROUP BY ALL) GROUP BY run_id)
    SELECT run_id, count(*) AS resources, count(*) FILTER (n % 2 = 0) AS pdfs, count(*) FILTER (k = 0) AS decisions, count(*) FILTER (k = 1) AS boilerplate, coalesce(any_value(checksums), 0) AS checksums, coalesce(any_value(duplicates), 0) AS duplicates, array_to_string(list_sort(list(DISTINCT url))[1:3], ',') AS sample
    FROM c LEFT JOIN s USING (run_id) GROUP BY run_id""")
def plane_preview(spark, sf_dir):
    """What a run captured, with the first pages by name."""
    out = control_plane.run_preview(_plane(spark, sf_dir)["captured"], 3)
    return out.select("run_id", "resources", "pdfs", "decisions", "boilerplate", "checksums", "duplicates", F.array_join("sample", ",").alias("sample"))


@query(_PLANE + "SELECT run_id, l_linenumber AS artifact_id FROM cap JOIN src USING (source_id) WHERE j % 2 = 0 AND l_shipdate < TIMESTAMP '1999-01-01' - INTERVAL 400 DAY")
def plane_expired(spark, sf_dir):
    """Captured artifacts older than the policy of their jurisdiction keeps them."""
    p = _plane(spark, sf_dir)
    policies = spark.createDataFrame([("short", 400)], "policy_id string, retention_days int")
    return control_plane.expired_artifacts(p["captured"], p["sources"], p["jurisdictions"], policies, F.lit("1999-01-01").cast("timestamp")).select("run_id", "artifact_id")
