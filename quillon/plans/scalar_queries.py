"""Registered queries for scalar functions, lists, predicates and gates. Stand-in columns are named in each query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import data_quality, evaluation, gates, joins, predicates, sets, windows
from quillon.operators import hierarchy as H
from quillon.plans.registry import query
from quillon.sources import stores
from quillon.sources.tables import spread, table


@query(r"""
    SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS collapsed_sha, 'text/html' AS content_type, lower(lang) AS language, lpad((doc_id * 37)::VARCHAR, greatest(4, length((doc_id * 37)::VARCHAR))::INTEGER, '0') AS padded,
        sha256(substr(text, 1, 400)) AS preview_sha, CASE WHEN n_chars % 5 = 0 THEN 0.0 ELSE round((n_chars % 7)::DOUBLE / (n_chars % 5), 4) END AS ratio,
        CASE WHEN doc_id > 5 THEN (doc_id - 5) * 1000000000 + 7 END AS positive
    FROM documents""")
def text_scalars(spark, sf_dir):
    """F13 to F15, F26 to F28, F33 over all texts; numbers beyond nine digits included."""
    d = spread(table(spark, sf_dir, "documents"))
    i = F.col("doc_id")
    return d.select(
        "doc_id", F.sha2(X.collapse("text"), 256).alias("collapsed_sha"), X.content_type(F.concat(F.lit("Text/HTML ; charset="), F.coalesce("lang", F.lit("x")))).alias("content_type"),
        X.language(F.concat(F.upper("lang"), F.lit("-CH"))).alias("language"), X.zero_fill((i * 37).cast("string"), 4).alias("padded"), F.sha2(X.preview("text"), 256).alias("preview_sha"),
        X.ratio(F.col("n_chars") % 7, F.col("n_chars") % 5).alias("ratio"), X.positive_int(((i - 5) * 1_000_000_000 + F.when(i > 5, 7).otherwise(0)).cast("string")).alias("positive"),
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS dotted, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso,
        date_diff('day', date_trunc('week', o_orderdate), o_orderdate)::INTEGER AS days_into_week
    FROM orders""")
def date_scalars(spark, sf_dir):
    """dotted and ISO dates, some of them malformed, and the days since Monday."""
    from quillon.operators.aggregates import week

    o = table(spark, sf_dir, "orders")
    k, at = F.col("o_orderkey") % 3, F.col("o_orderdate")
    dotted = F.when(k == 0, F.date_format(at, "d/M/yyyy")).when(k == 1, F.date_format(at, "d.M.yyyy")).otherwise("31.2.2023")
    iso = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyyMMdd"))
    return o.select("o_orderkey", X.iso_from_dotted(dotted).alias("dotted"), X.iso_date(iso).alias("iso"), F.date_diff(F.to_date(at), week("o_orderdate")).alias("days_into_week"))


_TITLES = """
    WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' Untitled Document ' WHEN 1 THEN 'my-file_v1.PDF' WHEN 2 THEN '  ' WHEN 3 THEN 'Act no. ' || doc_id WHEN 4 THEN 'one.pdf' END AS hint,
        CASE doc_id % 4 WHEN 0 THEN 'Fedlex' WHEN 1 THEN 'a.b-c.html' WHEN 2 THEN ' Law ' || doc_id END AS structured, CASE WHEN doc_id % 5 > 0 THEN 'Heading ' || lang END AS heading FROM documents)"""


@query(_TITLES + r""",
    r AS (SELECT doc_id, list_filter([hint, structured, heading], lambda t: t IS NOT NULL AND trim(t, ' ') <> '' AND lower(trim(t, ' ')) NOT IN ('untitled document', 'fedlex')
        AND NOT (NOT regexp_matches(trim(t, ' '), '\s') AND length(regexp_replace(trim(t, ' '), '[^-_.]', '', 'g')) >= 2 AND regexp_matches(trim(t, ' '), '(?i)\.(docx?|pdf|html?|xhtml|xml|rtf|odt|odf|txt|md)$'))) AS real FROM d)
    SELECT doc_id, coalesce(trim(real[1], ' '), 'Untitled document') AS title FROM r""")
def titles(spark, sf_dir):
    """the first real title of three candidates."""
    i = F.col("doc_id")
    hint = F.when(i % 6 == 0, " Untitled Document ").when(i % 6 == 1, "my-file_v1.PDF").when(i % 6 == 2, "  ").when(i % 6 == 3, F.concat(F.lit("Act no. "), i)).when(i % 6 == 4, "one.pdf")
    structured = F.when(i % 4 == 0, "Fedlex").when(i % 4 == 1, "a.b-c.html").when(i % 4 == 2, F.concat(F.lit(" Law "), i))
    return table(spark, sf_dir, "documents").select("doc_id", X.title(hint, structured, F.when(i % 5 > 0, F.concat(F.lit("Heading "), F.col("lang")))).alias("title"))


@query("""
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'law' WHEN 2 THEN 'commentary' WHEN 3 THEN 'treaty' END AS document_type,
        CASE doc_id % 4 WHEN 0 THEN 'jur_ch_zh' WHEN 1 THEN 'jur_ch' WHEN 2 THEN 'jur_x' END AS place, CASE WHEN lang IN ('fr', 'de') THEN upper(lang) WHEN doc_id % 2 = 0 THEN 'CH' END AS country,
        doc_id % 3 < 2 AS official, doc_id % 3 = 0 AS abbreviation, CASE WHEN doc_id % 2 = 0 THEN lang END AS inner_text
    FROM documents""")
def document_kinds(spark, sf_dir):
    """Types, places, tokens of ids, kinds of source, short titles, values inside JSON."""
    i, lang = F.col("doc_id"), F.col("lang")
    extracted = F.when(i % 5 == 0, " Urteil").when(i % 5 == 1, "LOI").when(i % 5 == 2, " ")
    hint = F.when(i % 5 == 2, "Kommentar").when(i % 5 == 3, "Treaty ")
    place = X.jurisdiction({"schweiz": "jur_ch"}, F.when(i % 4 == 0, "JUR_ch_zh").when(i % 4 == 1, " Schweiz").otherwise("nowhere"), F.when(i % 4 == 2, "jur_x"))
    token = X.corpus_token(F.concat(F.lit("src-"), F.coalesce(lang, F.lit("")), F.when(i % 2 == 0, "_CH.x").otherwise("-chx")), {"fr": "FR", "de": "DE", "ch": "CH"})
    payload = F.when(i % 2 == 0, F.to_json(F.struct(F.struct(lang.alias("b")).alias("a")))).otherwise(F.to_json(F.struct(F.struct(F.array(lang).alias("b")).alias("a"))))
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.document_type(extracted, hint).alias("document_type"), place.alias("place"), token.alias("country"),
        X.is_official(F.when(i % 3 == 0, "official_primary").when(i % 3 == 1, "official_mirror")).alias("official"),
        X.is_abbreviation(F.when(i % 3 == 0, "BetmG").when(i % 3 == 1, "Gesetz").otherwise("ZGB 1")).alias("abbreviation"), X.json_text(payload, "$.a.b").alias("inner_text"),
    )


@query("""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'zip' ELSE 'unknown' END AS format,
        CASE WHEN page_id % 8 = 7 THEN 'empty_body' WHEN page_id % 8 = 6 THEN 'content_type_mismatch' WHEN page_id % 8 = 0 THEN 'html_where_binary_expected' WHEN page_id % 4 = 3 OR page_id % 4 = 2 THEN 'format_signature_missing' END AS capture_reason
    FROM pages""")
def captures(spark, sf_dir):
    """What the bytes are, and why a capture is refused; all pages' bytes, some with another beginning."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    body = F.when(i % 4 == 0, F.concat(F.lit("﻿ "), F.col("html"))).when(i % 4 == 1, F.concat(F.lit("%PDF-1.7 "), F.col("html"))).when(i % 4 == 2, F.concat(F.lit("PK\x03\x04"), F.col("html"))).otherwise("plain words").cast("binary")
    rows = p.select("page_id", body.alias("body"), F.when(i % 8 == 4, "text/html").otherwise("application/pdf").alias("expected"), F.when(i % 8 == 6, "text/html").when(i % 8 == 4, "text/html; charset=utf-8").otherwise("application/pdf").alias("declared"))
    rows = rows.withColumn("format", X.sniff_bytes("body")).withColumn("body", F.when(i % 8 != 7, F.col("body")))
    return gates.capture(rows, "body", "expected", "declared", "format", 5).select("page_id", "format", "capture_reason")


@query("""
    SELECT doc_id, lang || ',src' || doc_id % 3 AS entries, lang || ',b' AS piped, 'CH-ZH,jur_' || lang AS places, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS n_both, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS only_first, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS only_second, lang = 'de' AS german
    FROM documents WHERE lang IS NOT NULL""")
def list_scalars(spark, sf_dir):
    """Lists in text, ids of the right shape, overlaps, prefixes."""
    lang, src = F.col("lang"), F.concat(F.lit("src"), F.col("doc_id") % 3)
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    over = sets.overlap_counts(F.array(lang, src, lang), F.array(F.lit("src1"), lang))
    return d.select(
        "doc_id", F.array_join(X.csv_list(F.concat(lang, F.lit(" ,,"), src, F.lit(", "), lang)), ",").alias("entries"), F.array_join(evaluation.pipe_list(F.concat(lang, F.lit("| b ||"), lang)), ",").alias("piped"),
        F.array_join(X.valid_places(F.array(F.lit("CH-ZH"), F.lit("ch"), F.concat(F.lit("jur_"), lang), F.lit("jur_X!"))), ",").alias("places"),
        over["both"].alias("n_both"), over["only_first"].alias("only_first"), over["only_second"].alias("only_second"), predicates.starts_with("lang", "d").alias("german"),
    )


@query("""
    SELECT n_nationkey, ['Köniz bei Bern (BE) / Cö ' || n_nationkey, 'Köniz bei Bern / Cö ' || n_nationkey, 'Köniz', 'Köniz bei Bern', 'Cö ' || n_nationkey, 'koeniz-bei-bern-be-coe-' || n_nationkey, 'koeniz-bei-bern-coe-' || n_nationkey, 'koeniz', 'koeniz-bei-bern', 'coe-' || n_nationkey].list_aggregate('string_agg', '|') AS forms,
        n_nationkey AS place_id, 'r' || n_regionkey AS country
    FROM nation""")
def place_names(spark, sf_dir):
    """Spellings of a name, the place of a slug, the country above a place."""
    n = table(spark, sf_dir, "nation")
    named = n.select("n_nationkey", F.concat(F.lit("Köniz bei Bern (BE) / Cö "), F.col("n_nationkey")).alias("name"), F.concat(F.lit(" Nation "), F.col("n_nationkey")).alias("written"))
    tree = n.select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.lit("cantonal").alias("level"), F.col("n_name").alias("name"))
    tree = tree.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("federal").alias("level"), F.col("r_name").alias("name")))
    placed = H.place_by_slug(named, "written", tree)
    return placed.join(H.country_of(tree).withColumnRenamed("id", "place_id"), "place_id").select("n_nationkey", F.array_join(sets.name_forms(F.col("name")), "|").alias("forms"), F.col("place_id").cast("int").alias("place_id"), "country")


@query("""
    SELECT event_id, event_type <> 'error' AS other_kind, event_id % 3 <> 1 AS not_refused, event_type <> 'view' AS legal FROM events""")
def flag_predicates(spark, sf_dir):
    """Kinds, rows without a kind, booleans inside JSON that may be absent."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), "event_type", F.when(i % 3 == 0, "{}").when(i % 3 == 1, '{"refused": true}').otherwise('{"refused": false}').alias("meta"))
    return rows.select("event_id", predicates.not_kind("kind", "error").alias("other_kind"), predicates.json_flag("meta", "$.refused", False).alias("not_refused"), (F.col("event_type") != "view").alias("legal"))


@query("""
    WITH old AS (SELECT max(ts) AS m FROM events WHERE event_type = 'view')
    SELECT event_id, true AS dated FROM events, old WHERE event_type <> 'view' AND ts > m - INTERVAL 0 SECOND
    UNION ALL SELECT event_id, false FROM events, old WHERE event_type <> 'view' AND (ts > m OR event_id % 10 = 0)""")
def newer_rows(spark, sf_dir):
    """Rows beyond the high-water mark, without and with unknown times."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    old, new = e.where("event_type = 'view'"), e.where("event_type <> 'view'")
    loose = predicates.newer_than(new.withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts"))), "ts", old, "9999-01-01")
    return predicates.newer_than(new, "ts", old).select("event_id", F.lit(True).alias("dated")).unionByName(loose.select("event_id", F.lit(False).alias("dated")))


@query(r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 11 AS n_sections, doc_id % 3 = 0 AS html, len(regexp_extract_all(coalesce(text, ''), '(?i)art\.|artikel|§|abs\.|ziff\.|\bcomma\b|\blett\.|\blit\.|cpv\.|\bcapoverso\b|\blet\.')) AS m FROM documents)
    SELECT doc_id, length(t)::INTEGER AS extracted_chars, m::INTEGER AS marker_count,
        CASE WHEN trim(t, ' ') = '' THEN 'no_text_layer' WHEN n_sections = 0 THEN 'no_sections_extracted' WHEN html THEN NULL WHEN length(t) < CASE WHEN doc_id % 2 = 0 THEN 500 ELSE 200 END THEN 'below_content_floor' WHEN m < CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END THEN 'below_content_floor' END AS quarantine_reason
    FROM d""")
def quarantine_reasons(spark, sf_dir):
    """Why a document is withheld, with floors of its source where these are numbers."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (i % 11).alias("n_sections"), F.when(i % 3 == 0, "text/HTML; charset=x").otherwise("application/pdf").alias("kind"), F.when(i % 2 == 0, "500").otherwise("many").alias("chars"), F.when(i % 2 == 0, "0").otherwise("-3").alias("markers"))
    return gates.quarantine(d, "text", "n_sections", "kind", gates.override(F.col("chars"), gates.MIN_CHARS), gates.override(F.col("markers"), gates.MIN_MARKERS)).select("doc_id", "extracted_chars", "marker_count", "quarantine_reason")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 < 3 THEN '2000-01-01' END AS from_date, CASE WHEN o_orderkey % 4 = 0 THEN 'manifest' WHEN o_orderkey % 4 < 3 THEN 'extracted' END AS origin FROM orders""")
def force_windows(spark, sf_dir):
    """A date of the manifest beats what was extracted; missing stays missing."""
    k = F.col("o_orderkey") % 4
    found = gates.in_force_window(F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, " "), F.when(k < 3, "2000-01-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", found["date"].alias("from_date"), found["origin"].alias("origin"))


@query("""
    WITH c AS (SELECT doc_id, n_chars % 4 AS n FROM documents WHERE n_chars % 4 > 0)
    SELECT doc_id, n AS n_citations, CASE WHEN n = 3 THEN 0 ELSE n END AS n_keys, CASE WHEN n = 3 THEN 0.78 ELSE 0.95 END::DOUBLE AS confidence, CASE WHEN n = 2 THEN 'case_law_reference' ELSE 'statute_reference' END AS insight_type
    FROM c WHERE CASE WHEN n = 3 THEN 0.78 ELSE 0.95 END >= 0.75""")
def insights(spark, sf_dir):
    """Passages with citations become insights, of a confidence that keys raise."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 900).alias("passage"), (F.col("n_chars") % 4).alias("n"))
    cited = d.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "n").select("doc_id", F.when(F.col("n") < 3, F.concat(F.lit("k"), "i")).alias("citation_key"), F.when(F.col("n") == 2, "bge").otherwise("sr").alias("citation_type"))
    return gates.insight(d, cited, ["doc_id"]).where(F.col("confidence") >= 0.75).select("doc_id", "n_citations", "n_keys", "confidence", "insight_type")


@query("""
    SELECT o_custkey, count(*) AS units, bool_and(o_orderstatus = 'F') AS complete FROM orders GROUP BY o_custkey
    UNION ALL SELECT c_custkey, 0, true FROM customer ANTI JOIN orders ON o_custkey = c_custkey""")
def drained_runs(spark, sf_dir):
    """Is every order of a customer done; a customer without orders is."""
    from quillon.operators.coverage import drained

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    units = o.groupBy("o_custkey").agg(F.count("*").alias("units"))
    return drained(o, c.unionByName(o.select("o_custkey")).distinct(), "o_custkey", F.col("o_orderstatus") == "F").join(units, "o_custkey", "left").select("o_custkey", F.coalesce("units", F.lit(0)).alias("units"), "complete")


@query("""
    WITH q AS (SELECT doc_id FROM documents), g AS (SELECT doc_id FROM labels), p AS (SELECT doc_id FROM documents WHERE doc_id % 3 > 0)
    SELECT doc_id, CASE WHEN g.doc_id IS NULL AND p.doc_id IS NULL THEN 'missing gold,missing prediction' WHEN g.doc_id IS NULL THEN 'missing gold' WHEN p.doc_id IS NULL THEN 'missing prediction' ELSE 'complete' END AS state
    FROM q LEFT JOIN (SELECT DISTINCT * FROM g) g USING (doc_id) LEFT JOIN p USING (doc_id)""")
def evaluation_triples(spark, sf_dir):
    """Queries with answer and prediction, and an error row for each that lacks one."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    whole, errors = joins.split_missing(d, table(spark, sf_dir, "labels").select("doc_id").distinct(), d.where("doc_id % 3 > 0"), "doc_id")
    return whole.select("doc_id", F.lit("complete").alias("state")).unionByName(errors.select("doc_id", F.col("error").alias("state")))


@query("""
    WITH s AS (SELECT doc_id, 1.0 - (doc_id % 40) / 400.0 AS a, CASE WHEN doc_id % 90 = 0 THEN 0.0 ELSE 1.0 END AS b FROM documents)
    SELECT count(*) AS n, round(avg(a), 4) AS citation_precision, round(avg(b), 4) AS hallucination, round(avg(a), 4) >= 0.95 AS citation_precision_ok, round(avg(b), 4) >= 0.98 AS hallucination_ok, round(avg(a), 4) >= 0.95 AND round(avg(b), 4) >= 0.98 AS passed FROM s""")
def evaluation_summary(spark, sf_dir):
    """Averages of scores, and whether each gate and all pass."""
    i = F.col("doc_id")
    scores = table(spark, sf_dir, "documents").select(*[(F.lit(1.0) if c not in ("citation_precision", "hallucination") else 1.0 - (i % 40) / 400.0 if c == "citation_precision" else F.when(i % 90 == 0, 0.0).otherwise(1.0)).alias(c) for c in (*evaluation.WEIGHTS, "overall_score")])
    return evaluation.summary(scores).select("n", "citation_precision", "hallucination", "citation_precision_ok", "hallucination_ok", "passed")


@query("""
    SELECT 'ordinal_from_zero' AS rule, count(*) FILTER (l_linenumber < 2) AS failures FROM lineitem UNION ALL SELECT 'parent_given', count(*) FILTER (l_orderkey % 100 = 0) FROM lineitem
    UNION ALL SELECT 'depth_from_zero', 0 UNION ALL SELECT 'content_given', count(*) FILTER (l_returnflag = 'N') FROM lineitem
    UNION ALL SELECT 'confidence_is_a_share', count(*) FILTER (l_discount * 20 > 1) FROM lineitem UNION ALL SELECT 'claim_given', 0 UNION ALL SELECT 'supported', count(*) FILTER (l_tax = 0) FROM lineitem
    UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'undeclared', 2""")
def record_rules(spark, sf_dir):
    """Q6, Q9: validators of sections and insights on order lines, and a column contract."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.when(F.col("l_orderkey") % 100 != 0, F.col("l_orderkey")).alias("document_id"), (F.col("l_linenumber") - 2).alias("ordinal"), F.lit(0).alias("depth"), F.when(F.col("l_returnflag") == "N", " ").otherwise("x").alias("content"), (F.col("l_discount") * 20).alias("confidence"), F.col("l_returnflag").alias("claim"), F.when(F.col("l_tax") > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("support"))
    missing, extra = data_quality.column_contract(rows, ["document_id", "ordinal", "depth", "content", "confidence", "section_id"])
    contract = spark.createDataFrame([("missing", len(missing)), ("undeclared", len(extra))], "rule string, failures long")
    return data_quality.row_rules(rows, data_quality.section_rules() | data_quality.insight_rules()).unionByName(contract)


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS e FROM lineitem),
    s AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS n FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, 'gap' AS problem, count(*) AS n FROM c WHERE l_linenumber <> e GROUP BY l_orderkey UNION ALL SELECT l_orderkey, 'current', n FROM s WHERE n <> 1""")
def index_rules(spark, sf_dir):
    """Q7, A10: indexes with gaps, and keys with other than one current row."""
    li = table(spark, sf_dir, "lineitem").withColumn("idx", F.col("l_linenumber") - 1)
    gaps = data_quality.sparse_index(li, ["l_orderkey"], "idx").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", F.lit("gap").alias("problem"), "n")
    return gaps.unionByName(data_quality.several_current(li.withColumn("cur", F.col("l_linestatus") == "F"), "l_orderkey", "cur").select("l_orderkey", F.lit("current").alias("problem"), "n"))


@query("""
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a0' WHEN 1 THEN 'a1' WHEN 2 THEN 'a2' END AS artifact_id FROM documents WHERE doc_id % 4 < 3""")
def primary_artifacts(spark, sf_dir):
    """The primary document, else by role, else by content type; bundles without any have none."""
    i = F.col("doc_id")
    make = lambda name, role, kind: F.struct(F.lit(name).alias("artifact_id"), role.alias("role"), F.lit(kind).alias("content_type"))
    rows = table(spark, sf_dir, "documents").select(i.alias("bundle_id"), F.explode(F.array(make("a0", F.when(i % 4 == 0, "primary_document").otherwise("other"), "image/png"), make("a1", F.when(i % 4 == 1, "consolidated").otherwise("other"), "image/png"), make("a2", F.lit("other"), "text/html; charset=x"))).alias("a")).select("bundle_id", "a.*")
    rows = rows.where(~((F.col("bundle_id") % 4 == 3) & (F.col("artifact_id") == "a2")))
    return stores.primary_artifact(rows, ["consolidated"]).select(F.col("bundle_id").alias("doc_id"), "artifact_id")


@query("""
    SELECT doc_id, doc_id % 3 > 0 AS intact, sha256(coalesce(text, '')) AS body_sha, lang, source FROM documents""")
def envelopes(spark, sf_dir):
    """Bodies inside envelopes with their checksums, and push messages."""
    i, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    wrapped = F.when(i % 2 == 0, F.to_json(F.struct(F.base64(body.cast("binary")).alias("body_base64")))).otherwise(body).cast("binary")
    message = F.base64(F.to_json(F.struct("lang", "source")).cast("binary"))
    rows = table(spark, sf_dir, "documents").select("doc_id", stores.unwrapped(wrapped).alias("content"), F.when(i % 3 > 0, F.upper(F.sha2(body, 256))).otherwise("0").alias("checksum"), stores.push_message(message, "lang STRING, source STRING").alias("m"))
    return stores.verified(rows, F.col("checksum")).select("doc_id", "intact", F.sha2("content", 256).alias("body_sha"), "m.lang", "m.source")


@query("""
    SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents WHERE lang IS NOT NULL""")
def sparql_bindings(spark, sf_dir):
    """A result set's bindings as columns; an optional variable may be unbound."""
    term = lambda c: F.struct(F.lit("literal").alias("type"), c.cast("string").alias("value"))
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    body = F.to_json(F.struct(F.struct(F.array(F.struct(term(F.col("doc_id")).alias("d"), term(F.col("lang")).alias("l"))).alias("bindings")).alias("results")))
    rows = stores.sparql_rows(d.select(body.alias("b")), "b", ["d", "l"]).select(F.col("d").cast("long").alias("doc_id"), F.col("l").alias("lang"))
    triples = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("subject"), F.lit("source").alias("predicate"), F.col("source").alias("object"))
    return joins.optional(rows.withColumnRenamed("doc_id", "subject"), triples, "subject", "source", "source").withColumnRenamed("subject", "doc_id")


@query("""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE '(none)' END AS session_key, CASE WHEN n_chars > 0 THEN (n_chars - least(n_chars, 100))::DOUBLE / n_chars END AS spread FROM documents""")
def session_keys(spark, sf_dir):
    """The first session key there is, and the spread of descending scores."""
    k, n = F.col("doc_id") % 3, F.col("n_chars").cast("double")
    key = windows.session_key("a", "b")
    rows = table(spark, sf_dir, "documents").withColumns({"a": F.when(k == 0, F.col("source")).when(k == 1, " "), "b": F.when(k == 1, F.col("lang"))})
    return rows.select("doc_id", key.alias("session_key"), windows.relative_spread(F.array(n, F.least(n, F.lit(100.0)))).alias("spread"))


_LINES = r"""
    WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls, 'Law ' || doc_id AS title FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, title, list_transform(ls, lambda x: trim(regexp_replace(CASE WHEN regexp_matches(x, '^[-*+]\s') THEN regexp_replace(x, '^[-*+]\s+', '') ELSE x END, '\s+', ' ', 'g'), ' ')) AS ls FROM d)"""


def _markdown(spark, sf_dir):
    """Blocks of Markdown around every whole text: a title, an introduction, and headings of two levels."""
    from quillon.operators import normalise

    d = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    source = F.concat(F.lit("# Law "), F.col("doc_id"), F.lit("\nintro  words\n## Part A\n"), F.col("text"), F.lit("\n### Part  B\n- one\n* two\n## Empty\n"))
    return d.select("doc_id", source.alias("md")).select("doc_id", normalise.markdown_blocks(F.col("md")).alias("blocks"))


@query(_LINES + """
    SELECT doc_id, 0 AS ordinal, 'Part A' AS title, 1 AS depth, '' AS ancestors, sha256(array_to_string(list_concat(['intro words'], ls), chr(10) || chr(10))) AS content_sha FROM b
    UNION ALL SELECT doc_id, 1, 'Part B', 2, 'Part A', sha256('one' || chr(10) || chr(10) || 'two') FROM b""")
def markdown_sections(spark, sf_dir):
    """Blocks and sections of Markdown; the introduction goes to the first section, an empty one does not count."""
    from quillon.operators import normalise

    out = normalise.sections(_markdown(spark, sf_dir), "doc_id")
    return out.select("doc_id", "ordinal", "title", "depth", F.array_join("ancestors", "/").alias("ancestors"), F.sha2("content", 256).alias("content_sha"))


@query(_LINES + r""",
    t AS (SELECT doc_id, title, array_to_string(list_concat(list_concat(['intro words', 'Part A'], ls), ['Part B', 'one', 'two', 'Empty']), chr(10) || chr(10)) AS body, ls FROM b)
    SELECT doc_id, sha256(title || chr(10) || chr(10) || body) AS text_sha, 'structured_html' AS flavour, sha256(trim(array_to_string(ls, chr(10)), ' ')) AS plain_sha FROM t""")
def markdown_texts(spark, sf_dir):
    """The body of blocks with the title in front, the flavour, and plain text as one paragraph."""
    from quillon.operators import normalise

    b = _markdown(spark, sf_dir)
    title = F.filter("blocks", lambda x: x["type"] == "title")[0]["text"]
    body = normalise.body_text(F.col("blocks"))
    own = F.array_join(F.transform(F.slice("blocks", 4, F.size("blocks") - 7), lambda x: x["text"]), "\n")
    b = b.select("doc_id", title.alias("title"), body.alias("body"), normalise.flavour(F.col("blocks")).alias("flavour"), own.alias("own"))  # each made once
    return b.select("doc_id", F.sha2(normalise.full_text(F.col("title"), F.col("body")), 256).alias("text_sha"), "flavour", F.sha2(normalise.plain_blocks(F.col("own"))[0]["text"], 256).alias("plain_sha"))
