"""Registered queries for citations, search, facets, writes, status rules and event application. Stand-in columns are named in each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.operators import aggregates as A
from quillon.operators import citations, coverage, hierarchy, joins, mutation, search, sets, windows
from quillon.operators.search_index import SearchIndex
from quillon.plans.queries import _tree
from quillon.plans.registry import query
from quillon.sources import stores
from quillon.sources.tables import spread, table
from quillon.streaming import projection

#: A sentence for each kind of citation, with the (type, text, key) that it holds.
SENTENCES: tuple[tuple[str, tuple[tuple[str, str, str | None], ...]], ...] = (
    ("see SR 101.3 there", (("sr", "SR 101.3", "sr:101.3"),)),
    ("as BGE 123 II 45 E. 3.1 holds", (("bge", "BGE 123 II 45 E. 3.1", None),)),
    ("by § 12 Abs. 3 lit. a Steuergesetz it", (("ch_paragraph", "§ 12 Abs. 3 lit. a Steuergesetz", None),)),
    ("in BGBl. I Nr. 51/1991 and", (("at_bgbl", "BGBl. I Nr. 51/1991", "at_bgbl:i:51/1991"),)),
    ("Regulation (EU) 2016/679 and", (("eu_regulation", "Regulation (EU) 2016/679", "celex:32016R0679"),)),
    ("Richtlinie 2004/38/EG ist", (("eu_directive", "Richtlinie 2004/38/EG", "celex:32004L0038"),)),
    ("under 32016R0679 alone", (("eu_celex", "32016R0679", "celex:32016R0679"),)),
    ("in ECLI:EU:C:2014:317 it", (("eu_ecli", "ECLI:EU:C:2014:317", "ecli:ECLI:EU:C:2014:317"),)),
    ("so BVerfGE 65, 1 (43) and", (("de_bverfge", "BVerfGE 65, 1 (43)", None),)),
    ("order 1 BvR 209/83 of", (("de_bverfg_docket", "1 BvR 209/83", "de_docket:1 BvR 209/83"),)),
    ("also BGHZ 154, 239 says", (("de_bgh", "BGHZ 154, 239", None),)),
    ("in ECLI:DE:BGH:2019:280519UVIZR121.18.0 it", (("de_ecli", "ECLI:DE:BGH:2019:280519UVIZR121.18.0", "ecli:ECLI:DE:BGH:2019:280519UVIZR121.18.0"),)),
    ("by § 823 BGB one", (("de_paragraph", "§ 823 BGB", "de_statute:BGB"),)),
    ("selon article 1240 du Code civil on", (("fr_code_article", "article 1240 du Code civil", None),)),
    ("see pourvoi n° 20-12.345 now", (("fr_pourvoi", "pourvoi n° 20-12.345", "fr_pourvoi:20-12.345"),)),
    ("by Cass. com. he", (("fr_cassation", "Cass. com.", None),)),
    ("with CE, n° 123456 then", (("fr_conseil_etat", "CE, n° 123456", "fr_ce:123456"),)),
    ("in ECLI:FR:CCASS:2020:C100123 it", (("fr_ecli", "ECLI:FR:CCASS:2020:C100123", "ecli:ECLI:FR:CCASS:2020:C100123"),)),
    ("per art. 2043 c.c. si", (("it_codice_article", "art. 2043 c.c.", "it_codice:c.c."),)),
    ("cf. Cass. lav. n. 123/2019 ivi", (("it_cassazione", "Cass. lav. n. 123/2019", "it_cass:123/2019"),)),
    ("so Consiglio di Stato, Sez. IV, n. 456/2020 ha", (("it_consiglio_stato", "Consiglio di Stato, Sez. IV, n. 456/2020", "it_cds:456/2020"),)),
    ("in ECLI:IT:COST:2018:120 it", (("it_ecli", "ECLI:IT:COST:2018:120", "ecli:ECLI:IT:COST:2018:120"),)),
    ("after Art. 8 Abs. 2 ZGB it", (("article", "Art. 8 Abs. 2 ZGB", "abbrev_art:ZGB/8"),)),
)
_EXPECTED = ", ".join(f"({i}, '{kind}', '{found}', {f"'{key}'" if key else 'NULL'})" for i, (_, rows) in enumerate(SENTENCES) for kind, found, key in rows)


def _with_sentences(df: DataFrame, number: str) -> DataFrame:
    sentence = F.element_at(F.array(*[F.lit(s) for s, _ in SENTENCES]), (F.col(number) % len(SENTENCES) + 1).cast("int"))
    return df.withColumn("text", F.concat_ws("\n", F.coalesce("text", F.lit("")), sentence))


@query(f"SELECT doc_id, kind AS citation_type, found AS citation_text, key AS citation_key FROM documents JOIN (VALUES {_EXPECTED}) v(n, kind, found, key) ON doc_id % {len(SENTENCES)} = n")
def citations_in_documents(spark, sf_dir):
    """Citations of all whole texts, each with a sentence of one of the 23 kinds behind it."""
    d = _with_sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    return citations.extract(d, "text").select("doc_id", "citation_type", "citation_text", "citation_key")


@query(f"SELECT conv_id, turn, kind AS citation_type, found AS citation_text, key AS citation_key FROM conversations JOIN (VALUES {_EXPECTED}) v(n, kind, found, key) ON conv_id % {len(SENTENCES)} = n")
def citations_in_conversations(spark, sf_dir):
    """C1 to C23 with offsets, over all turns: what stands at the offsets is the citation."""
    d = _with_sentences(table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn")), "conv_id").select("id", "text")
    rows = citations.with_offsets(d, "id", "text").join(d, "id").where(F.expr("substring(text, start + 1, `end` - start)") == F.col("citation_text"))
    part = lambda i: F.split_part("id", F.lit(":"), F.lit(i)).cast("long")
    return rows.select(part(1).alias("conv_id"), part(2).alias("turn"), "citation_type", "citation_text", "citation_key")


_NAMED = (("sr:101", "sr:101"), ("see ECLI:EU:C:2014:317", "ecli:ECLI:EU:C:2014:317"), ("SR 101.3", "sr:101.3"), ("BGBl. Nr. 51/1991", "at_bgbl:51/1991"), ("Verordnung (EU) 2016/679", "celex:32016R0679"), ("Directive 2004/38/EC", "celex:32004L0038"), ("32016R0679", "celex:32016R0679"), ("Art. 8 ZGB", "abbrev_art:ZGB/8"), ("rent law", None), ("ecli:eu:c:1", "ecli:EU:C:1"))


@query(f"""
    WITH q AS (SELECT * FROM (VALUES {", ".join(f"('{q}', {f"'{k}'" if k else 'NULL'})" for q, k in _NAMED)}) v(q, k)),
    t AS (SELECT 'sr:' || (101 + doc_id) AS k, doc_id FROM documents UNION ALL SELECT 'at_bgbl:51/1991', doc_id FROM documents UNION ALL SELECT 'celex:32016R0679', 5),
    p AS (SELECT k, count(DISTINCT doc_id) AS n, min(doc_id) AS d FROM t GROUP BY k)
    SELECT q, k AS citation_key, CASE WHEN k IS NULL THEN 'not_normalizable' WHEN n IS NULL THEN 'no_target_in_corpus' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution_status, CASE WHEN n = 1 THEN d::VARCHAR END AS target_document_id FROM q LEFT JOIN p USING (k)""")
def citation_forward(spark, sf_dir):
    """What a search text names and where it leads."""
    i = F.col("doc_id")
    keys = F.explode(F.array(F.concat(F.lit("sr:"), 101 + i), F.lit("at_bgbl:51/1991")))
    targets = table(spark, sf_dir, "documents").select(keys.alias("target_key"), i.cast("string").alias("document_id"), F.lit(None).cast("string").alias("section_id"))
    targets = targets.unionByName(spark.createDataFrame([("celex:32016R0679", "5", None)], targets.schema))
    named = citations.forward(spark.createDataFrame([(q,) for q, _ in _NAMED], "q string"), targets)
    again = citations.resolve_on_write(named, lambda: targets)  # resolving once more changes nothing
    return again.select("q", "citation_key", "resolution_status", "target_document_id")


@query("""
    SELECT doc_id, 'official_citation:BGE ' || doc_id AS target_key FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'sr:' || (100 + doc_id % 900) FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'celex:32016R0679' FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, unnest(['at_bgbl:51/1991', 'at_bgbl:i:51/1991']) FROM documents WHERE doc_id % 5 = 0""")
def citation_targets(spark, sf_dir):
    """The keys under which documents are found."""
    i = F.col("doc_id")
    title = F.concat_ws(" ", F.when(i % 3 == 0, F.concat(F.lit("SR "), 100 + i % 900)).when(i % 3 == 1, "on 32016R0679"), F.when(i % 5 == 0, "BGBl. I Nr. 51/1991"))
    d = table(spark, sf_dir, "documents").select(i.alias("document_id"), F.when(i % 2 == 0, F.concat(F.lit("BGE "), i)).otherwise(" ").alias("official_citation"), title.alias("title"))
    return citations.targets_of(d).select(F.col("document_id").alias("doc_id"), "target_key")


_EDGES = "WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS citation_id, l_orderkey AS src, 'p' || l_partkey AS k FROM lineitem), t AS (SELECT DISTINCT 'p' || o_custkey AS k, o_orderkey AS d FROM orders)"


def _edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("citation_id"), F.col("l_orderkey").alias("source_document_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("citation_key"))
    return e, table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_custkey")).alias("target_key"), F.col("o_orderkey").alias("document_id"))


@query(_EDGES + " SELECT d AS document_id, count(*) AS n_citations, count(DISTINCT src) AS n_documents FROM e JOIN t USING (k) WHERE src <> d GROUP BY d")
def citation_cited_by(spark, sf_dir):
    """How often others cite each document; lines cite, orders are cited by their customer's number."""
    return citations.cited_by(*_edges(spark, sf_dir))


@query(_EDGES + " SELECT 'own' AS side, citation_id FROM e WHERE src = 7 UNION ALL SELECT 'citing', citation_id FROM e WHERE k IN ('p7', 'p8') AND src <> 7")
def citation_neighbours(spark, sf_dir):
    """A document's own citations, and those that name its keys, without its own."""
    e, _ = _edges(spark, sf_dir)
    keys = spark.createDataFrame([("p7",), ("p8",)], "citation_key string")
    found = citations.citing(e.withColumn("target_document_id", F.lit(None).cast("long")), keys, 7)
    return citations.citations_of(e, 7).select(F.lit("own").alias("side"), "citation_id").unionByName(found.select(F.lit("citing").alias("side"), "citation_id"))


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(replace(replace(replace(translate(lower(coalesce({c}, '')), 'äöü', 'aou'), 'ß', 'ss'), 'ae', 'a'), 'oe', 'o'), '(^|[^aeq])ue', '\1u', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query(rf"""
    WITH d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS title FROM documents),
    t AS (SELECT doc_id, 1.0 AS weight, {_WORDS.format(c="text")} AS ws FROM d UNION ALL SELECT doc_id, 4.0, {_WORDS.format(c="title")} FROM d),
    s AS (SELECT weight, count(*) AS n, sum(len(ws)) / count(*) AS a FROM t GROUP BY weight),
    p AS (SELECT doc_id, weight, len(ws) AS dl, token, count(*) AS tf FROM (SELECT *, unnest(ws) AS token FROM t)
        WHERE (left(token, 2) = 'li' AND levenshtein(token, 'licence') <= 2) OR (left(token, 2) = 've' AND levenshtein(token, 'versiom') <= 2) OR (left(token, 2) = 'th' AND levenshtein(token, 'these') <= 1) OR (left(token, 2) = 'wo' AND levenshtein(token, 'works') <= 1) GROUP BY ALL),
    f AS (SELECT weight, token, count(*) AS df FROM p GROUP BY ALL),
    r AS (SELECT doc_id, weight, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) * weight AS score FROM p JOIN f USING (weight, token) JOIN s USING (weight) GROUP BY doc_id, weight)
    SELECT doc_id AS doc, round(max(score) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, 5) AS score FROM r GROUP BY doc_id""")
def search_ranked(spark, sf_dir):
    """Free text with words near its own, weighted fields, boosts; from postings made once per field."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("ch"))).alias("jurisdiction_ids")))
    index = SearchIndex.current(d, "doc_id", ["content", "title"], "content-title")
    out = search.ranked(index, d, "doc_id", "licence versiom these works", {"content": 1.0, "title": 4.0}, phrase_fields=["title"], preferred=["ch"])
    return out.select("doc", F.round("score", 5).alias("score"))


@query(r"""
    SELECT doc_id, CASE WHEN instr(lower(coalesce(text, '')), 'license') > 0 THEN substr(text, greatest(1, instr(lower(text), 'license') - 50), 200) WHEN doc_id % 2 = 0 THEN 'regeste' WHEN text IS NOT NULL THEN substr(text, 1, 400) ELSE '' END AS fragment,
        CASE WHEN contains(' ' || array_to_string(""" + _WORDS.format(c="text") + r""", ' ') || ' ', ' the license ') THEN 8.0 ELSE 0.0 END::DOUBLE AS boost FROM documents""")
def search_fragments(spark, sf_dir):
    """The fragment around the first hit with its fallbacks, and the boost of a phrase."""
    d = spread(table(spark, sf_dir, "documents")).withColumn("title", F.col("text"))
    return d.select("doc_id", search.highlight(F.col("text"), "license", F.when(F.col("doc_id") % 2 == 0, "regeste"), F.substring("text", 1, 400)).alias("fragment"), search.phrase_boost(["the", "license"], fields=["title"]).alias("boost"))


_ASKED = (("*", "wildcard", "", False), ("Art. 8 ZGB", "short_legal", "", False), ("rent law Zug", "short_legal", "", False), ("how long does a tenant have to object to a rent increase", "free_text", "", False), ("kanton zug rules on notice periods for flats", "free_text", "n1", False), ("rules of the canton of bern on dogs and on cats", "free_text", "n2", True))


@query(f"SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in _ASKED)}) v(q, shape, named, refused)")
def search_shapes(spark, sf_dir):
    """The shape of search texts, the places they name, and whether that refuses them; held places come from the table."""
    held = [f"n{r.n_nationkey}" for r in table(spark, sf_dir, "nation").where("n_nationkey = 1").collect()]
    places = [("n1", ["zug"], "ch-zg"), ("n2", ["bern"], "ch-be")]
    rows = []
    for q, *_ in _ASKED:
        named = search.mentions(search.query_tokens(q), places, ("kanton", "canton"))
        rows.append((q, search.query_shape(q), ",".join(named), search.refuses(named, held)))
    return spark.createDataFrame(rows, "q string, shape string, named string, refused boolean")


@query("SELECT x AS value, count(*) AS n FROM (SELECT DISTINCT o_orderkey, unnest([o_orderstatus, left(o_orderpriority, 1), o_orderstatus]) AS x FROM orders) GROUP BY x")
def multi_facet(spark, sf_dir):
    """A facet of a field with several values, each counted once a row."""
    return A.facet(table(spark, sf_dir, "orders").select(F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1), "o_orderstatus").alias("tags")), "tags")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS exact, true AS close FROM orders GROUP BY o_orderstatus")
def approximate_counts(spark, sf_dir):
    """Distinct values by a sketch, within three of its standard errors of the exact count."""
    o = table(spark, sf_dir, "orders")
    both = A.approx_distinct(o, ["o_orderstatus"], "o_custkey").join(o.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("exact")), "o_orderstatus")
    return both.select("o_orderstatus", "exact", (F.abs(F.col("n") - F.col("exact")) <= 0.06 * F.col("exact")).alias("close"))


@query("SELECT DISTINCT l_partkey AS value FROM lineitem ORDER BY 1 LIMIT 3000")
def held_values(spark, sf_dir):
    """The distinct keys of an index, at most 3,000 as its consumers ask."""
    return A.held_set(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("SELECT source, count(*) AS total, count(lang) AS having, count(*) - count(lang) AS lacking FROM documents GROUP BY source")
def existing_values(spark, sf_dir):
    """Rows that have a field and rows that lack it."""
    return A.existing(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("""
    WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_type, sum(n)::BIGINT AS total FROM c GROUP BY p_type ORDER BY 2 DESC, 1 LIMIT 4)
    SELECT p_type, p_brand, n, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand)::INTEGER AS rank FROM c JOIN t USING (p_type)) WHERE rank <= 3""")
def nested_facets(spark, sf_dir):
    """The most frequent types, and in each the most frequent brands."""
    return A.nested_facet(table(spark, sf_dir, "part"), "p_type", "p_brand", 4, 3).select("p_type", "p_brand", "n", "total", "rank")


@query("""
    SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, count(*) AS runs, count(*) FILTER (o_orderstatus = 'P') AS failures, sum(o_orderkey % 3)::BIGINT AS a, count(*) FILTER (o_orderkey % 2 = 0) AS b FROM orders GROUP BY 1""")
def weekly_run_kpis(spark, sf_dir):
    """Runs, failures and merged counters of codes by week."""
    k = F.col("o_orderkey")
    codes = F.map_filter(F.create_map(F.lit("a"), (k % 3), F.lit("b"), F.when(k % 2 == 0, F.lit(1).cast("long"))), lambda _, v: v.isNotNull())
    out = A.weekly_kpis(table(spark, sf_dir, "orders").withColumn("codes", codes), "o_orderdate", F.col("o_orderstatus") == "P", "codes")
    return out.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "runs", "failures", F.col("codes")["a"].alias("a"), F.coalesce(F.col("codes")["b"], F.lit(0)).alias("b"))


@query("""
    WITH n AS (SELECT *, min(CASE WHEN event_type = 'click' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - epoch_us(ts) AS wait FROM events)
    SELECT count(*) AS events, count(*) FILTER (event_type = 'view') AS searches, count(*) FILTER (event_type = 'view' AND wait <= 300000000) AS focused, round(count(*) FILTER (event_type = 'view' AND wait <= 300000000) / count(*) FILTER (event_type = 'view'), 6) AS focus_rate,
        round(count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type = 'view'), 6) AS resets_per_search, round(count(*) FILTER (event_type = 'signup') / count(DISTINCT user_id), 6) AS refinements_per_session FROM n""")
def journey(spark, sf_dir):
    """The indicators of search journeys over all events."""
    out = A.journey_kpis(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", {"search": "view", "focus": "click", "reset": "error", "refine": "signup"})
    return out.select("events", "searches", "focused", *[F.round(c, 6).alias(c) for c in ("focus_rate", "resets_per_search", "refinements_per_session")])


@query("SELECT o_custkey, count(*) AS done, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY o_custkey")
def shard_rollup(spark, sf_dir):
    """Totals over the shards of a key."""
    shards = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.struct(F.lit(1).alias("done"), (F.col("o_orderstatus") == "P").cast("int").alias("failed")).alias("v")))).alias("shards"))
    return A.shard_totals(shards, "o_custkey", "shards")


@query("""
    WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS w FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, 'f' || i) AS rn FROM e)
    SELECT vec_id, round(sum(w), 5) AS mass, string_agg('f' || i, ',' ORDER BY rn) FILTER (rn <= 3) AS top, round(sum(w) FILTER (rn <= 3), 5) AS top_mass FROM r GROUP BY vec_id""")
def feature_mass(spark, sf_dir):
    """The mass of a map of weights, and its heaviest entries."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.map_from_arrays(F.transform("embedding", lambda _, i: F.concat(F.lit("f"), i)), F.col("embedding").cast("array<double>")).alias("m"))
    top = A.top_entries("m", 3)
    return e.select("vec_id", F.round(A.mass("m"), 5).alias("mass"), F.array_join(F.map_keys(top), ",").alias("top"), F.round(A.mass(top), 5).alias("top_mass"))


@query("""
    SELECT 'history' AS list, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 10) UNION ALL SELECT 'page', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 3)""")
def pages_of_rows(spark, sf_dir):
    """Pages of ordered rows, with filters, offsets and limits kept within bounds."""
    o = table(spark, sf_dir, "orders")
    one = A.history_page(o, "o_orderdate", "o_orderkey", 5000, 10, o_orderstatus="F", o_custkey=None).select(F.lit("history").alias("list"), "o_orderkey")
    return one.unionByName(A.page(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 0, 3).select(F.lit("page").alias("list"), "o_orderkey"))


@query("""
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders)
    SELECT o_custkey, max(o_orderkey) FILTER (rn = 1) AS latest, max(place)::INTEGER AS last_place, last(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS status FROM o GROUP BY o_custkey""")
def latest_and_positions(spark, sf_dir):
    """The latest row of a key, places within it, and the status seen last."""
    o = table(spark, sf_dir, "orders")
    last = windows.latest(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("latest"))
    places = o.withColumn("p", windows.position(["o_custkey"], F.col("o_orderkey"))).groupBy("o_custkey").agg(F.max("p").alias("last_place"))
    return last.join(places, "o_custkey").join(windows.newest(o, ["o_custkey"], "o_orderstatus", "o_orderdate", "o_orderkey").withColumnRenamed("o_orderstatus", "status"), "o_custkey")


@query("""
    WITH t AS (SELECT c_custkey AS id, c_mktsegment AS v, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS done FROM customer), r AS (SELECT o_orderkey AS id, 'new' AS v FROM orders WHERE o_orderkey % 4 = 0)
    SELECT coalesce(t.id, r.id) AS id, CASE WHEN t.id IS NULL OR (r.id IS NOT NULL AND t.done IS NULL) THEN r.v ELSE t.v END AS guarded, CASE WHEN t.id IS NULL THEN r.v ELSE t.v END AS inserted, CASE WHEN t.id IS NOT NULL THEN coalesce(r.v, t.v) END AS patched, t.id IS NOT NULL AND r.id IS NULL AS kept
    FROM t FULL JOIN r ON t.id = r.id""")
def keyed_writes(spark, sf_dir):
    """Insert or ignore, update where a marker is null, patch and delete by key."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"), F.when(F.col("c_custkey") % 2 == 0, 1).alias("done"))
    r = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("v"), F.lit(1).alias("done"))
    out = mutation.update_where_null(t, r, "id", "done").select("id", F.col("v").alias("guarded"))
    out = out.join(mutation.insert_new(t, r, ["id"]).select("id", F.col("v").alias("inserted")), "id", "left").join(mutation.patch(t, r, "id", ["v"]).select("id", F.col("v").alias("patched")), "id", "left")
    return out.join(mutation.delete_keys(t, r, "id").select("id", F.lit(True).alias("kept")), "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query("""
    SELECT o_orderkey, coalesce(m, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision FROM orders LEFT JOIN (SELECT o_custkey, max(o_orderkey % 50) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey) USING (o_custkey) WHERE o_orderkey % 2 = 1""")
def next_revisions(spark, sf_dir):
    """Revisions that go on from the greatest known."""
    o = table(spark, sf_dir, "orders")
    known = o.where("o_orderkey % 2 = 0").select("o_custkey", (F.col("o_orderkey") % 50).alias("revision"))
    return mutation.next_revision(o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey"), known, "o_custkey", "o_orderkey").select("o_orderkey", "revision")


@query("""
    SELECT o_orderkey, o_orderstatus IN ('O', 'F') AND o_orderkey % 3 > 0 AS may, 'a=' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ',b=new' ELSE ',b=old' END || CASE WHEN o_orderkey % 5 = 0 THEN ',c=1' ELSE '' END AS merged FROM orders""")
def corrections(spark, sf_dir):
    """Steps of corrections that are allowed, and maps with their overlays."""
    k = F.col("o_orderkey")
    current, wanted = F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending"), F.when(k % 3 == 0, "superseded").when(k % 3 == 1, "applied").otherwise("rejected")
    none = F.lit(None).cast("string")
    base = F.create_map(F.lit("a"), k.cast("string"), F.lit("b"), F.lit("old"), F.lit("c"), none)
    merged = mutation.overlaid(base, F.create_map(F.lit("b"), F.when(k % 2 == 0, "new").otherwise(none), F.lit("c"), F.when(k % 5 == 0, "1").otherwise(none)))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", mutation.may_move(current, wanted).alias("may"), shown.alias("merged"))


@query("""
    WITH r AS (SELECT n_nationkey AS k, 'S' || n_regionkey AS v FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 1000, 'x')
    SELECT s_suppkey::VARCHAR AS id, CASE WHEN r.k IS NULL THEN 'unchanged' WHEN s_suppkey % 10 = 0 THEN 'had' ELSE 'updated' END AS outcome FROM (SELECT s_suppkey, s_nationkey FROM supplier) LEFT JOIN r ON k = s_nationkey
    UNION ALL SELECT k::VARCHAR, 'unmatched' FROM r WHERE k NOT IN (SELECT s_nationkey FROM supplier)""")
def keyed_csv_merge(spark, sf_dir):
    """A keyed list merged into records: had already, updated, unchanged, and keys that match nothing."""
    n = table(spark, sf_dir, "nation")
    r = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("S"), F.col("n_regionkey")).alias("v")).unionByName(spark.createDataFrame([(1000, "x")], "k int, v string"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")).join(r.withColumnRenamed("v", "now"), "k", "left").withColumn("v", F.when(F.col("s_suppkey") % 10 == 0, F.col("now")))
    merged, lost = mutation.keyed_merge(s, r, "k", "v")
    return merged.select(F.col("s_suppkey").cast("string").alias("id"), "outcome").unionByName(lost.select(F.col("k").cast("string").alias("id"), F.lit("unmatched").alias("outcome")))


@query("""
    SELECT * FROM (VALUES ('a', 'PRESENT', 'none'), ('b', 'DROPPED', 'widen schema and replay'), ('c', 'NEVER_EMITTED', 'none')) v(key, verdict, action)""")
def metadata_drops(spark, sf_dir):
    """Keys that were emitted and not stored, over all documents, and what to do about them."""
    d = table(spark, sf_dir, "documents").select(F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.col("source")).alias("emitted"), F.create_map(F.lit("a"), F.col("source")).alias("stored"))
    audit = mutation.metadata_audit(d, ["a", "b", "c"], "emitted", "stored")
    return audit.join(mutation.repair_plan(audit), "key").select("key", "verdict", "action")


@query("""
    SELECT 'ledger' AS list, 'd' || o_custkey AS id, string_agg(r, ',' ORDER BY r::INTEGER) AS revisions FROM (SELECT DISTINCT o_custkey, (o_orderkey % 7)::VARCHAR AS r FROM orders WHERE o_custkey IN (1, 2)) GROUP BY o_custkey
    UNION ALL SELECT 'document', 'd' || o_custkey, count(*)::VARCHAR FROM orders WHERE o_custkey NOT IN (1, 2) GROUP BY o_custkey UNION ALL SELECT 'swept', o_orderstatus, count(*)::VARCHAR FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY o_orderstatus""")
def retraction(spark, sf_dir):
    """A retraction's ledger row and what stays, and a retention sweep."""
    o = table(spark, sf_dir, "orders")
    d = o.select(F.concat(F.lit("d"), F.col("o_custkey")).alias("document_id"), (F.col("o_orderkey") % 7).cast("int").alias("document_revision"))
    plan = mutation.retract(d, d, ["d1", "d2", "nowhere"], "takedown", "asked for", "op", None, F.lit("2024-01-01").cast("timestamp"))
    swept, _ = mutation.sweep(o, F.col("o_orderdate") < "1995-01-01", dry_run=False)
    kept = plan.documents.groupBy("document_id").agg(F.count("*").cast("string").alias("revisions"))
    return plan.ledger.select(F.lit("ledger").alias("list"), F.col("document_id").alias("id"), F.array_join(F.col("retracted_revisions").cast("array<string>"), ",").alias("revisions")).unionByName(kept.select(F.lit("document").alias("list"), F.col("document_id").alias("id"), "revisions")).unionByName(swept.groupBy(F.col("o_orderstatus").alias("id")).agg(F.count("*").cast("string").alias("revisions")).select(F.lit("swept").alias("list"), "id", "revisions"))


@query("""
    WITH u AS (SELECT 0 AS i, o_orderkey AS id, o_custkey AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, o_orderkey, -1 FROM orders WHERE o_orderkey % 3 = 0)
    SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM u) WHERE rn = 1 AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def enumerations(spark, sf_dir):
    """Enumerations put together, each id once by the first that has it, without the ended ones, clustered by id."""
    o = table(spark, sf_dir, "orders")
    first, second = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v")), o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(-1).cast("long").alias("v"))
    ended = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")).unionByName(spark.createDataFrame([(None,)], "id long"))
    return mutation.clustered(joins.not_in(sets.union_by_id([first, second], "id", "v"), ended, "id"), "id")


@query("""
    SELECT o_orderkey, -1 AS part, o_orderstatus AS record FROM orders UNION ALL SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER, 'p' || l_partkey FROM lineitem""")
def flattened_records(spark, sf_dir):
    """A document's own records and those of its parts as rows."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(F.array(F.concat(F.lit("p"), x["l_partkey"])).alias("cited"))).alias("parts"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderstatus").alias("own")).join(parts, "o_orderkey", "left")
    everything = sets.flattened(d, "o_orderkey", "own", "parts", "cited")
    orphans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_anti")
    lost = orphans.select("o_orderkey", windows.position(["o_orderkey"], F.col("l_linenumber"), F.col("l_partkey")).alias("part"), F.concat(F.lit("p"), F.col("l_partkey")).alias("record"))
    return everything.select("o_orderkey", F.coalesce("part", F.lit(-1)).alias("part"), "record").unionByName(lost)


@query("""
    SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"n":{"b":["x"]}}' AS kept, event_type || chr(10) || 'x' AS plain FROM events""")
def json_walks(spark, sf_dir):
    """JSON without certain keys at any depth, and all its strings in order."""
    k = F.get_json_object("props", "$.k")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"k": '), k, F.lit(', "gone": "'), "event_type", F.lit('", "n": {"gone": 1, "b": ["x"]}}')).alias("j"))
    return sets.plain_text(e, "j").select("event_id", sets.without_keys(F.col("j"), ["gone"]).alias("kept"), F.col("plain_text").alias("plain"))


@query("""
    WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, 'federal' AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'cantonal' FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'municipal' FROM supplier),
    c(id, scope) AS (SELECT id, id FROM t UNION ALL SELECT c.id, t.parent_id FROM c JOIN t ON c.scope = t.id WHERE t.parent_id IS NOT NULL),
    lv AS (SELECT DISTINCT c.id, unnest(CASE t.level WHEN 'federal' THEN ['constitutional', 'federal'] WHEN 'cantonal' THEN ['cantonal'] ELSE ['municipal'] END) AS norm_level FROM c JOIN t ON c.scope = t.id),
    dc AS (SELECT 's' || l_suppkey AS id, CASE WHEN l_linenumber = 1 THEN 'federal' ELSE 'municipal' END AS norm_level, l_orderkey * 10 + l_linenumber AS d, l_shipdate FROM lineitem)
    SELECT lv.id, lv.norm_level, CASE lv.norm_level WHEN 'constitutional' THEN 10 WHEN 'federal' THEN 30 WHEN 'cantonal' THEN 40 ELSE 50 END AS rank, count(d) AS n, count(d) > 0 AS covered, coalesce(array_to_string(list(d ORDER BY l_shipdate DESC, d)[1:2], ','), '') AS newest
    FROM lv LEFT JOIN dc USING (id, norm_level) GROUP BY lv.id, lv.norm_level""")
def norm_report(spark, sf_dir):
    """The levels of law that bind each place, with the documents of each and the newest of them."""
    levels = hierarchy.binding_levels(hierarchy.governing_scopes(_tree(spark, sf_dir)))
    d = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("id"), F.when(F.col("l_linenumber") == 1, "federal").otherwise("municipal").alias("norm_level"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"), F.col("l_shipdate").alias("effective_date"))
    return hierarchy.report(levels, d, 2).select("id", "norm_level", "rank", "n", "covered", F.coalesce(F.array_join(F.col("newest").cast("array<string>"), ","), F.lit("")).alias("newest"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 30 WHEN o_orderkey % 4 = 1 THEN 10 WHEN o_orderkey % 4 = 2 THEN 40 ELSE 20 END AS level, q.scope FROM orders
    JOIN (SELECT n_nationkey AS n, unnest(['n' || n_nationkey, 'r' || n_regionkey]) AS scope FROM nation) q ON q.n = o_orderkey % 25""")
def document_levels(spark, sf_dir):
    """The level of a document, and the places that govern one that it names."""
    k = F.col("o_orderkey")
    level = hierarchy.document_level(F.when(k % 4 < 3, F.array(F.lit(20), F.when(k % 4 == 2, 40).otherwise(30))), F.when(k % 4 == 1, 10).when(k % 4 == 2, 50).when(k % 4 == 3, 20))
    o = table(spark, sf_dir, "orders")
    scopes = hierarchy.preferred_scopes(o.select(k.alias("query_id"), F.concat(F.lit("n"), k % 25).alias("place")), hierarchy.governing_scopes(_tree(spark, sf_dir)))
    return o.select("o_orderkey", level.alias("level")).join(scopes, k == scopes["query_id"]).select("o_orderkey", "level", "scope")


_STAGE = """
    WITH r AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS run, CASE k % 6 WHEN 1 THEN 'failed' WHEN 2 THEN 'quarantined' WHEN 3 THEN 'accepted' WHEN 4 THEN 'processing' WHEN 5 THEN 'ready' END AS latest, CASE WHEN k % 4 = 0 THEN 'applied' END AS life, k % 5 AS un, k % 10 AS late FROM orders),
    b AS (SELECT *, CASE WHEN latest IS NULL THEN CASE WHEN run = 'failed' THEN 'blocked' ELSE 'pending' END WHEN latest = 'failed' THEN 'failed' WHEN latest = 'quarantined' THEN 'blocked' WHEN latest IN ('accepted', 'processing') THEN 'in_progress' ELSE 'ok' END AS base FROM r),
    s AS (SELECT *, CASE WHEN late = 9 AND base <> 'failed' THEN 'blocked' WHEN un = 4 AND base = 'ok' THEN 'in_progress' ELSE base END AS p1, CASE WHEN life IS NOT NULL THEN 'ok' WHEN latest IS NULL THEN 'pending' WHEN latest IN ('failed', 'quarantined') THEN 'blocked' ELSE 'in_progress' END AS p2, CASE WHEN life IS NOT NULL THEN 'ok' ELSE 'pending' END AS p3 FROM b)"""


def _stages(spark, sf_dir) -> DataFrame:
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(st == "P", "failed").when(st == "O", "running").otherwise("completed").alias("run"), F.when(k % 6 == 1, "failed").when(k % 6 == 2, "quarantined").when(k % 6 == 3, "accepted").when(k % 6 == 4, "processing").when(k % 6 == 5, "ready").alias("latest"), F.when(k % 4 == 0, "applied").alias("life"), F.when(k % 5 == 4, 1).alias("un"), F.when(k % 10 == 9, 1).alias("late"))
    return rows.withColumns({"p1": coverage.processing_stage(F.col("latest"), F.col("run"), F.col("un"), F.col("late")), "p2": coverage.projection_stage(F.col("latest"), F.col("life")), "p3": coverage.search_stage(F.col("life"))})


@query(_STAGE + """
    SELECT k AS o_orderkey, p1, p2, CASE WHEN run = 'failed' AND p3 = 'pending' THEN 'not_applicable' ELSE p3 END AS p3,
        CASE WHEN 'failed' IN (p1, p2, p3) THEN 'failed' WHEN 'blocked' IN (p1, p2, p3) THEN 'blocked' WHEN ('pending' IN (p1, p2, p3) OR 'in_progress' IN (p1, p2, p3)) AND run = 'completed' THEN 'stalled' WHEN 'pending' IN (p1, p2, p3) OR 'in_progress' IN (p1, p2, p3) THEN 'in_progress' ELSE 'ok' END AS health FROM s""")
def stage_statuses(spark, sf_dir):
    """The status of each stage of a run, and of the whole."""
    stages = F.array("p1", "p2", "p3")
    old = F.lit("2020-01-01").cast("timestamp")
    health = coverage.rollup(stages, F.col("run"), old, F.lit("2024-01-01").cast("timestamp"))
    return _stages(spark, sf_dir).select("o_orderkey", "p1", "p2", coverage.reachable(stages, F.col("run"))[2].alias("p3"), health.alias("health"))


@query(_STAGE + """
    SELECT k AS o_orderkey, CASE WHEN k % 11 = 0 THEN 'run_refused_by_lock' WHEN run = 'failed' THEN 'run_failed' WHEN run = 'completed' AND k % 3 = 0 THEN 'publish_path_disabled' WHEN run = 'running' THEN 'too_early_to_diagnose' WHEN p1 IN ('pending', 'in_progress') AND k % 3 > 0 THEN 'di_consumer_silent'
        WHEN k % 3 > 0 AND k % 7 = 0 AND p2 IN ('pending', 'in_progress') THEN 'projection_stalled' WHEN k % 7 > 0 AND p3 = 'pending' THEN 'search_projection_pending' ELSE 'unknown' END AS cause FROM s""")
def stall_causes(spark, sf_dir):
    """Why a run has not got where it should, the first cause that holds."""
    k = F.col("o_orderkey")
    return _stages(spark, sf_dir).select("o_orderkey", coverage.stall_cause(F.when(k % 11 == 0, True), F.col("run"), k % 3, k % 7, F.col("p1"), F.col("p2"), F.col("p3")).alias("cause"))


@query("""
    WITH t AS (SELECT o_orderkey AS k, CASE WHEN k % 4 = 0 THEN 'live' WHEN k % 4 = 1 THEN 'awaiting_evidence' ELSE 'scaffold' END AS code, CASE WHEN k % 3 = 0 THEN 'open' WHEN k % 3 = 1 THEN 'closed_by_operator' ELSE 'never_turned' END AS key FROM orders),
    b AS (SELECT *, CASE WHEN code = 'scaffold' THEN 'provider_scaffold' WHEN key = 'closed_by_operator' THEN 'template_disabled_by_operator' WHEN code = 'awaiting_evidence' THEN 'provider_awaiting_evidence' WHEN key = 'never_turned' THEN 'template_never_enabled' END AS blocker FROM t)
    SELECT code, key, blocker, count(*) AS n, (SELECT count(*) FROM b WHERE blocker IS NULL) AS launchable, (SELECT count(*) FROM b WHERE code <> 'scaffold' AND key <> 'closed_by_operator') AS acceptance_ready FROM b GROUP BY ALL""")
def launch_classes(spark, sf_dir):
    """Templates by the two keys that hold them, and how many could be launched."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 4 == 0, " Live").when(k % 4 == 1, "awaiting_evidence").when(k % 4 == 2, "odd").alias("readiness"), (k % 3 == 0).alias("enabled"), F.when(k % 3 == 1, "override").alias("provenance"))
    classes = coverage.launch_class(rows, "readiness", "enabled", "provenance")
    total = coverage.launch_summary(classes).first()
    return classes.groupBy(F.col("code_key").alias("code"), F.col("config_key").alias("key"), "blocker").agg(F.count("*").alias("n")).withColumns({"launchable": F.lit(total.launchable).cast("long"), "acceptance_ready": F.lit(total.acceptance_ready).cast("long")})


@query("""
    SELECT o_orderkey, o_orderkey % 4 > 1 AS reported, o_orderkey % 4 IN (0, 2) AS is_evidence, CASE o_orderkey % 4 WHEN 1 THEN 'gate_coverage_unknown' WHEN 3 THEN 'gate_not_evaluated' ELSE '' END AS refusals, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ATTRIBUTED' ELSE 'AMBIGUOUS' END AS attribution, CASE WHEN o_orderkey % 5 = 1 AND o_custkey > 0 THEN o_custkey END AS expected, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5 - 1) * 3 + 1 END AS observed FROM orders WHERE o_orderkey % 5 <> 4""")
def evidence(spark, sf_dir):
    """Gates that were not evaluated refuse, and coverage is attributed to one entity or to none."""
    k = F.col("o_orderkey")
    gate = lambda o: F.struct(F.lit("g").alias("gate"), F.lit(o).alias("outcome"))
    verdict = coverage.gate_verdict(F.when(k % 4 == 1, F.array().cast("array<struct<gate:string,outcome:string>>")).when(k % 4 == 2, F.array(gate("excluded"))).when(k % 4 == 3, F.array(gate("excluded"), gate("not_evaluated"))))
    entity = lambda o: F.struct(F.col("o_custkey").alias("expected"), F.lit(o).alias("observed"))
    payload = coverage.coverage_payload(F.when(k % 5 == 1, F.array(entity(1))).when(k % 5 == 2, F.array(entity(1), entity(3))).when(k % 5 == 3, F.array(entity(1), entity(3), entity(3))))
    rows = table(spark, sf_dir, "orders").where(k % 5 != 4).select("o_orderkey", verdict.alias("v"), payload.alias("c"))
    return rows.select("o_orderkey", "v.reported", "v.is_evidence", F.array_join("v.refusals", ",").alias("refusals"), "c.attribution", "c.expected", "c.observed")


@query("""
    WITH u AS (SELECT user_id, bool_or(event_type = 'purchase') AS ended, max(ts) AS seen FROM events WHERE event_id % 7 > 0 GROUP BY user_id), m AS (SELECT max(ts) AS t FROM events)
    SELECT 'stranded' AS list, user_id::VARCHAR AS id FROM u, m WHERE NOT ended AND seen <= t - INTERVAL 1 HOUR UNION ALL SELECT 'due', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate <= TIMESTAMP '1997-01-01' AND (o_orderkey % 3 = 0 OR o_orderdate > TIMESTAMP '1995-01-01')
    UNION ALL SELECT 'fresh', CASE WHEN epoch(TIMESTAMP '1998-01-01') - epoch(max(l_shipdate)) > 6 * 3600 THEN 'error' WHEN epoch(TIMESTAMP '1998-01-01') - epoch(max(l_shipdate)) > 2 * 3600 THEN 'warn' ELSE 'pass' END FROM lineitem""")
def overdue(spark, sf_dir):
    """Units left without an end, schedules that are due, and how fresh a table is."""
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("ts").alias("t")).first().t
    units = coverage.reconcile_units(e.where("event_id % 7 > 0"), "user_id", "ts", "event_type", "event_id", ["purchase"], F.lit(top))
    k = F.col("o_orderkey")
    due = coverage.schedules_due(table(spark, sf_dir, "orders").select("o_orderkey", (k % 2 == 0).alias("enabled"), F.col("o_orderdate").alias("previous_fire"), F.when(k % 3 > 0, F.lit("1995-01-01").cast("timestamp")).alias("last_run")), F.lit("1997-01-01").cast("timestamp"))
    fresh = coverage.freshness(table(spark, sf_dir, "lineitem"), "l_shipdate", F.lit("1998-01-01").cast("timestamp"))
    lost = coverage.stranded(units, F.lit(top) - F.expr("INTERVAL 1 HOUR"))
    named = lambda df, name, c: df.select(F.lit(name).alias("list"), F.col(c).cast("string").alias("id"))
    return named(lost, "stranded", "user_id").unionByName(named(due, "due", "o_orderkey")).unionByName(named(fresh, "fresh", "status"))


@query("""
    SELECT event_id, CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'signup' THEN 'quarantined' ELSE CASE WHEN event_id % 2 = 1 THEN 'rejected_permanent' WHEN event_id % 6 >= 4 THEN 'dead_lettered' ELSE 'transient_retry' END END AS route FROM events""")
def routes(spark, sf_dir):
    """Where an event goes after it was handled."""
    i, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "purchase", "ok").when(kind == "signup", "quarantined").otherwise("failed")
    return table(spark, sf_dir, "events").select("event_id", projection.route(status, i % 2 == 0, i % 6, 4).alias("route"))


@query("""
    WITH e AS (SELECT l_orderkey AS k, CASE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) WHEN 1 THEN 'accepted' WHEN 2 THEN 'processing' WHEN 3 THEN 'canonical_ready' ELSE 'again' END AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)
    SELECT k, string_agg(s, '>' ORDER BY n) AS statuses, count(*) = 3 AS complete FROM e GROUP BY k""")
def status_sequences(spark, sf_dir):
    """The statuses of a unit in order, and whether they are whole."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n")).withColumn("s", F.when(F.col("n") == 1, "accepted").when(F.col("n") == 2, "processing").when(F.col("n") == 3, "canonical_ready").otherwise("again"))
    return projection.status_sequence(e, "k", "n", "s").select("k", F.array_join("statuses", ">").alias("statuses"), "complete")


_APPLIED = """
    WITH e AS (SELECT event_id, user_id AS k, event_id % 9 AS r, CASE WHEN event_type = 'error' THEN 'withdrawn' ELSE 'upsert' END AS kind, event_id % 3 AS b FROM events),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC, b DESC, event_id DESC) AS rn FROM e) WHERE rn = 1)"""


@query(_APPLIED + "SELECT k, event_id, r FROM n WHERE kind <> 'withdrawn'")
def applied_events(spark, sf_dir):
    """Three batches under the stale guard; withdrawn keys are gone for readers and older events do not revive them."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), (i % 9).alias("r"), F.when(F.col("event_type") == "error", "withdrawn").otherwise("upsert").alias("kind"))
    held = None
    for b in range(3):
        held = projection.merged(held, e.where(i % 3 == b), "k", "r")
    return projection.live(held).select("k", "event_id", "r")


@query(_APPLIED + """SELECT 'part' AS list, o_orderkey AS id, 0 AS n FROM orders WHERE o_custkey % 20 NOT IN (SELECT k FROM n WHERE kind = 'withdrawn') UNION ALL
    SELECT 'withdrawal', p_partkey, 1 FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)""")
def withdrawn_parts(spark, sf_dir):
    """Parts of withdrawn keys go too, and what an outbox no longer has becomes a withdrawal."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), (i % 9).alias("r"), F.when(F.col("event_type") == "error", "withdrawn").otherwise("upsert").alias("kind"))
    held = None
    for b in range(3):
        held = projection.merged(held, e.where(i % 3 == b), "k", "r")
    parts = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("k"))
    kept = projection.without_withdrawn(parts, held, "k").select(F.lit("part").alias("list"), F.col("o_orderkey").alias("id"), F.lit(0).alias("n"))
    outbox = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    published = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("document_revision"))
    gone = stores.withdrawals(outbox, published, "id")
    return kept.unionByName(gone.select(F.lit("withdrawal").alias("list"), "id", F.col("document_revision").alias("n")))


@query("""
    WITH e AS (SELECT event_id % 3000 AS id, user_id AS k, event_id % 5 AS r, event_id AS a FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a) > 1 AS copy FROM e),
    o AS (SELECT *, CASE WHEN copy THEN 'ignored_duplicate' WHEN r < max(CASE WHEN NOT copy THEN r END) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'stale' ELSE 'applied' END AS outcome FROM m)
    SELECT outcome, count(*) AS n, CASE WHEN outcome = 'ignored_duplicate' THEN 0 ELSE count(*) END AS appended FROM o GROUP BY outcome""")
def projection_history(spark, sf_dir):
    """What a history gets of a batch, and the counts that are told."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select((i % 3000).alias("id"), F.col("user_id").alias("k"), (i % 5).alias("r"), i.alias("a"))
    marked = projection.outcomes(e, "id", "k", "r", "a")
    history, counts = projection.with_history(marked.limit(0), marked)
    return counts.join(history.groupBy("outcome").agg(F.count("*").alias("appended")), "outcome", "left").withColumn("appended", F.coalesce("appended", F.lit(0)))


@query("""
    SELECT o_custkey AS document_id, max(o_orderkey % 9) AS document_revision FROM orders WHERE o_custkey > 50 GROUP BY o_custkey""")
def latest_documents(spark, sf_dir):
    """The newest row of each document after an id, of few columns."""
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 9).alias("document_revision"), F.col("o_orderdate").alias("processed_at"), F.col("o_orderstatus").alias("heavy"))
    return stores.latest_documents(d, ["document_id", "document_revision"], 50)


@query("""
    WITH s AS (SELECT doc_id, 'x' || lang AS id FROM documents WHERE lang IS NOT NULL) SELECT doc_id, 'x_' || doc_id || '_0' AS edge, sha256(concat_ws('||', '=' || id, '=a\\|b', '~')) AS safe FROM s""")
def fallback_ids(spark, sf_dir):
    """Section 1.3, X1: positional edge ids, and hashes in which a null differs from nothing."""
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return d.select("doc_id", ids.edge_id("x", "doc_id", F.lit(0)).alias("edge"), ids.null_safe_hash_id(F.concat(F.lit("x"), F.col("lang")), F.lit("a|b"), F.lit(None).cast("string")).alias("safe"))
