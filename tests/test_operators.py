"""Operators on small tables made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import ids, text
from quillon.operators import aggregates, chunking, citations, coverage, data_quality, evaluation, gates, hierarchy, joins, mutation, normalise, predicates, search, sparse, windows

D = dt.date


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one(spark, column, **values):
    names, given = list(values), list(values.values())
    schema = ", ".join(f"{n} {'string' if not isinstance(v, int) or isinstance(v, bool) else 'int'}" for n, v in zip(names, given, strict=True))
    return spark.createDataFrame([tuple(given)], schema).select(column.alias("x")).first().x


# --- functions ---


def test_base32_id_is_the_number_spelled_out(spark):
    import hashlib

    number = int.from_bytes(hashlib.sha256(b"a||b").digest()[:16], "big")
    want = "".join(ids.ALPHABET[number >> 5 * i & 31] for i in reversed(range(26)))
    assert one(spark, ids.base32_id("doc", "a", "b"), a="a", b="b") == f"doc_{want}"


def test_hash_ids_and_nulls(spark):
    df = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    r = df.select(ids.hash_id("x", "y", "z").alias("p"), ids.hash_id("x", "z").alias("q"), ids.null_safe_hash_id("x", "y", "z").alias("s"), ids.null_safe_hash_id("x", "z").alias("t")).first()
    assert r.p == r.q and r.s != r.t


@pytest.mark.parametrize(("given", "want"), [("https://a.ch", "https://a.ch/"), ("https://a.ch/x?utm_source=1&b=2#f", "https://a.ch/x?b=2"), ("https://a.ch/x/?utm_source=1", "https://a.ch/x/")])
def test_canonical_urls(spark, given, want):
    assert one(spark, text.url_canonical("u"), u=given) == want


def test_small_text_functions(spark):
    assert one(spark, text.iso_from_dotted("s"), s="01.02.2020") == "2020-02-01"
    assert one(spark, text.iso_from_dotted("s"), s="31.02.2020x") is None
    assert one(spark, text.fold("s"), s="Zürich Straße Goethe") == "zurich strasse gothe"
    assert one(spark, text.zero_fill("s", 4), s="12345") == "12345"
    assert one(spark, text.is_filename("s"), s="fedlex-data-admin-ch-eli-cc-2008-414-20230901-de-docx")
    assert not one(spark, text.is_filename("s"), s="Tierschutzgesetz 2008.pdf copy")
    assert one(spark, text.title(F.col("h"), F.lit("  "), F.lit("Heading")), h="Fedlex") == "Heading"
    assert one(spark, text.modality("s"), s="  <!DOCTYPE html><p>") == "html"
    assert one(spark, text.modality("s"), s="# T\n- a") == "markdown"
    assert one(spark, text.corpus_token("s", {"ch": "CH", "at": "AT"}), s="ris-at-2020") == "AT"
    assert one(spark, text.sniff_bytes(F.col("s").cast("binary")), s="\n%PDF-1.7") == "pdf"
    assert one(spark, text.positive_int("s"), s="0") is None


# --- windows, aggregates, predicates, joins ---


def test_sessions_keep_untimed_rows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:05:00", 2), (1, "2024-01-01 00:10:00.000001", 3), (1, None, 4), (2, None, 5)], "k int, t string, i int").withColumn("t", F.col("t").cast("timestamp"))
    assert rows(windows.with_session(e, ["k"], "t", 300, F.col("i")), "i", "session") == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 1)]


def test_first_known_newest_and_top(spark):
    df = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, 5, "y"), ("a", 2, 6, "z")], "k string, o int, v int, s string")
    assert rows(windows.first_known(df, ["k"], ["v"], F.col("o")), "v") == [(5,)]
    assert rows(windows.newest(df, ["k"], "s", "o", "v"), "s") == [("z",)]
    assert rows(windows.top_k(df, ["k"], 2, F.desc("o"), F.desc("v")), "s", "rank") == [("y", 2), ("z", 1)]


def test_weekly_buckets_are_dense(spark):
    e = spark.createDataFrame([("a", "2024-01-03"), ("a", "2024-01-16"), ("b", "2023-01-01")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = rows(aggregates.weekly_buckets(e, "k", "t", "2024-01-17", 3), "k", "week", "n")
    assert got == sorted([("a", D(2024, 1, 1), 1), ("a", D(2024, 1, 8), 0), ("a", D(2024, 1, 15), 1), ("b", D(2024, 1, 1), 0), ("b", D(2024, 1, 8), 0), ("b", D(2024, 1, 15), 0)], key=repr)


def test_facets_count_a_row_once_per_value(spark):
    df = spark.createDataFrame([(["x", "x", "y"],), (["x"],), (None,)], "v array<string>")
    assert [tuple(r) for r in aggregates.facet(df, "v").collect()] == [("x", 2), ("y", 1)]


def test_completeness_share_and_entries(spark):
    seen, known = spark.createDataFrame([("a", 2), ("b", 1)], "k string, n long"), spark.createDataFrame([("a", 2), ("c", 1)], "k string, n long")
    assert rows(aggregates.completeness(seen, known, "k"), "k", "complete") == [("a", True), ("b", False), ("c", False)]
    assert rows(aggregates.share_of_total(seen.select("k"), ["k"]), "k", "share") == [("a", 0.5), ("b", 0.5)]
    m = spark.createDataFrame([({"t1": 0.5, "t2": 0.5, "t3": 0.9},)], "m map<string,double>")
    assert m.select(aggregates.top_entries("m", 2).alias("m")).first().m == {"t3": 0.9, "t1": 0.5}


def test_journey_kpis(spark):
    e = spark.createDataFrame([("s", "search", "2024-01-01 00:00:00"), ("s", "search", "2024-01-01 00:03:00"), ("s", "focus", "2024-01-01 00:08:00"), ("s", "reset", None), ("t", "search", None), ("t", "refine", None)], "s string, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    names = {n: n for n in ("search", "focus", "reset", "refine")}
    r = aggregates.journey_kpis(e, "s", "k", "t", names).first()
    assert (r.searches, r.timed_searches, r.focused, r.focus_rate, r.resets_per_search, r.refinements_per_session) == (3, 2, 1, 0.5, 1 / 3, 0.5)
    assert aggregates.journey_kpis(e.limit(0), "s", "k", "t", names).first().focus_rate is None


def test_empty_and_absent_filters(spark):
    df = spark.createDataFrame([("a", ["p"]), ("b", None)], "k string, v array<string>")
    count = lambda f, v: df.where(predicates.in_terms(df, f, v)).count()
    assert [count("k", None), count("k", []), count("k", ["a"]), count("v", ["p", "q"])] == [2, 0, 1, 1]


def test_refinements(spark):
    df = spark.createDataFrame([("a", 3, True, "Das Gesetz"), ("b", 9, False, "anderes")], "k string, n int, t boolean, x string")
    keep = lambda *r: rows(predicates.refine(df, predicates.parse_refinements(list(r))), "k")
    assert keep({"kind": "range", "field": "N", "min": 3, "max": 8}) == [("a",)]
    assert keep({"kind": "toggle", "field": "t", "value": True}, {"kind": "text", "field": "x", "value": "gesetz"}) == [("a",)]
    assert keep({"kind": "toggle", "field": "t", "value": False}, {"bad": 1}, "junk") == [("a",), ("b",)]
    assert keep({"kind": "terms", "field": "k", "values": ["B"]}) == [("b",)]


def test_in_force_states(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), D(2024, 6, 1)), (2, D(2020, 1, 1), D(2024, 5, 31)), (3, D(2024, 6, 2), None), (4, None, None), (5, None, D(2030, 1, 1))], "i int, f date, u date")
    at = F.lit("2024-06-01").cast("date")
    out = df.select("i", predicates.in_force_state("f", "u", at).alias("s"), predicates.valid_at("f", "u", at).alias("v"))
    assert rows(out, "i", "s", "v") == [(1, "in_force", True), (2, "repealed", False), (3, "not_yet_in_force", False), (4, "unknown", True), (5, "in_force", True)]


def test_rules_flags_and_kinds(spark):
    df = spark.createDataFrame([("ch", "de", '{"refused": true}', None), ("at", "de", "{}", "commentary_insight")], "c string, l string, j string, k string")
    rule = predicates.first_rule([({"c": "ch"}, "swiss"), ({"l": "de"}, "german"), ({}, "any")], "none")
    assert rows(df.select("c", rule.alias("r")), "c", "r") == [("at", "german"), ("ch", "swiss")]
    assert rows(df.where(predicates.json_flag("j", "$.refused", False)), "c") == [("at",)]
    assert rows(df.where(predicates.not_kind("k", "commentary_insight")), "c") == [("ch",)]


def test_not_in_survives_nulls_and_either_key(spark):
    a, b = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "k int, d int"), spark.createDataFrame([(1, 8), (None, 9)], "k int, d int")
    assert rows(joins.not_in(a, b, "k"), "k") == [(2,), (3,)]
    assert rows(joins.either_key(a, b, ["k", "d"], ["k", "d"], "k"), "k", "r_d") == [(1, 8), (2, 8), (3, 9)]


def test_as_of_falls_back(spark):
    v = spark.createDataFrame(
        [("past", "v1", D(2020, 1, 1), D(2020, 12, 31)), ("past", "v2", D(2021, 1, 1), None), ("past", "v3", D(2030, 1, 1), None), ("ended", "v1", D(2020, 1, 1), D(2020, 2, 1)), ("future", "v8", D(2031, 1, 1), None), ("future", "v9", D(2030, 1, 1), None), ("undated", "u1", None, None), ("undated", "u2", None, None)],
        "k string, v string, f date, u date",
    )
    got = rows(joins.as_of(v, ["k"], "v", "f", "u", F.lit("2024-01-01").cast("date")), "k", "v", "in_force")
    assert got == [("ended", "v1", False), ("future", "v9", False), ("past", "v2", True), ("undated", "u2", True)]


def test_requested_keys_get_a_row(spark):
    got = joins.requested(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 3), ("c", 1)], "k string, n long"), "k", "n")
    assert rows(got, "k", "n", "held") == [("a", 3, True), ("b", 0, False), ("c", 1, True)]


# --- chunks, markup, gates ---


@pytest.mark.parametrize("size", [1, 60, 2047, 2048, 2049, 3840, 4096, 14592, 30001])
def test_lossless_chunks_cover_everything(spark, size):
    body = "".join(chr(97 + i % 26) for i in range(size))
    df = spark.createDataFrame([(1, body)], "i int, t string")
    cut = chunking.chunks(df, "t", least=0).orderBy("chunk_idx").collect()
    seen = cut[0].chunk_text
    for r in cut[1:]:
        assert len(seen) > r.chunk_idx * 1792
        seen = seen[: r.chunk_idx * 1792] + r.chunk_text
    assert seen == body
    windows_ = chunking.windows(df, "t", 600, 40).orderBy("window_idx").collect()
    seen = ""
    for r in windows_:
        seen = seen[: r.window_idx * 560] + r.window_text
    assert seen == body


def test_passages(spark):
    df = spark.createDataFrame([(1, "One.\n \nTwo\nlines."), (2, "A b. " * 300)], "i int, t string")
    got = chunking.passages(df, "t").groupBy("i").count()
    assert rows(got, "i", "count") == [(1, 2), (2, 300)]


def test_markdown_and_sections(spark):
    text_ = "intro\n# Title\npre\n## One\na\n- b\n### Deep\nc\n## Empty\n## Two\nd"
    df = spark.createDataFrame([(1, text_), (2, "only\ntext"), (3, "")], "i int, t string").withColumn("blocks", normalise.markdown_blocks(F.col("t")))
    got = rows(normalise.sections(df, "i"), "i", "ordinal", "title", "depth", "content", "ancestors")
    assert got == [(1, 0, "One", 1, "intro\n\npre\n\na\n\nb", []), (1, 1, "Deep", 2, "c", ["One"]), (1, 2, "Two", 1, "d", []), (2, 0, "Body", 0, "only\n\ntext", [])]


def blocks_of(read, markup):
    return [(b["type"], b["text"], b["level"], b["anchor"]) for b in read(markup)]


def test_html_blocks(spark):
    html = "<html><head><title> T </title><style>x</style></head><body><nav><p>no</p></nav>dropped<article id=a>loose<h2>Art. 1</h2><div><p id=p>a&amp;b<br><b>c</b></p></div><ul><li>i<p>j</p></li></ul>tail</article><table><td>d</td></table><script>1<2</script></body></html>"
    want = [("title", "T", None, None), ("paragraph", "loose", None, "a"), ("heading", "Art. 1", 2, "a"), ("paragraph", "a&b c", None, "p"), ("list_item", "ij", None, "a"), ("paragraph", "tail", None, "a"), ("paragraph", "d", None, None)]
    df = normalise.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "<b>only</b> text"), (4, "<section>open<main>never closed")], "i int, h string"), "h")
    got = {r.i: [(b.type, b.text, b.level, b.anchor) for b in r.blocks] for r in df.collect()}
    assert got == {1: want, 2: [], 3: [("paragraph", "only text", None, None)], 4: [("paragraph", "open", None, None), ("paragraph", "never closed", None, None)]}


def test_xml_blocks(spark):
    xml = "<doc xmlns='u'><Metadaten><p>no</p></Metadaten><Abschnitt nr='2'><titel>Rechte</titel><titel>Zweiter</titel><Paragraf><nr>5</nr><absatz>Text <i>hier</i></absatz><ziffer nr='1'>eins</ziffer><inhalt><satz>s</satz></inhalt></Paragraf></Abschnitt><ueberschrift typ='kz'>Seite</ueberschrift><ueberschrift>Frei</ueberschrift></doc>"
    assert blocks_of(normalise.xml_blocks_of, xml) == [("heading", "Abschnitt 2 Rechte", 2, None), ("heading", "§ 5", 4, None), ("paragraph", "Text hier", None, None), ("list_item", "1 eins", None, None), ("paragraph", "s", None, None), ("heading", "Frei", 2, None)]
    assert blocks_of(normalise.xml_blocks_of, "<a>plain <b>x</b></a>") == [("paragraph", "plain x", None, None)]
    assert blocks_of(normalise.xml_blocks_of, "<a>")[0][0] == "invalid"
    df = normalise.xml_blocks(spark.createDataFrame([(xml,)], "x string"), "x")
    assert len(df.first().blocks) == 6


def test_quarantine_order(spark):
    long = "Art. 1 " + "x" * 300
    df = spark.createDataFrame([(1, " ", 0, "a/b"), (2, "t", 0, "text/html"), (3, "t", 1, "text/html; x"), (4, "Art. t", 1, "application/pdf"), (5, "x" * 300, 1, "application/pdf"), (6, long, 1, "application/pdf")], "i int, t string, n int, c string")
    got = rows(gates.quarantine(df, "t", "n", "c"), "i", "quarantine_reason")
    assert got == [(1, "no_text_layer"), (2, "no_sections_extracted"), (3, None), (4, "below_content_floor"), (5, "below_content_floor"), (6, None)]
    assert one(spark, gates.override(F.col("v"), 200), v="0") == 0 and one(spark, gates.override(F.col("v"), 200), v="-1") == 200 and one(spark, gates.override(F.col("v"), 200), v="x") == 200


def test_capture_guard(spark):
    pdf = "application/pdf"
    df = spark.createDataFrame([(1, "", pdf, pdf), (2, "<html>", pdf, "text/html"), (3, "<html>", pdf, pdf), (4, "junk", pdf, pdf), (5, "%PDF-1", pdf, None), (6, "x" * 20, "text/html", None)], "i int, b string, e string, d string")
    df = df.withColumn("b", F.col("b").cast("binary")).withColumn("s", text.sniff_bytes("b"))
    got = rows(gates.capture(df, "b", "e", "d", "s", 10), "i", "capture_reason")
    assert got == [(1, "empty_body"), (2, "content_type_mismatch"), (3, "html_where_binary_expected"), (4, "format_signature_missing"), (5, "below_size_floor"), (6, None)]


# --- citations, search, hierarchy ---

CITED = {
    "SR 220.1 und SR 220.1": [("sr", "SR 220.1", "sr:220.1")],
    "BGE 147 III 49 E. 2.1": [("bge", "BGE 147 III 49 E. 2.1", None)],
    "§ 5 Abs. 2 lit. b Jagdgesetz": [("ch_paragraph", "§ 5 Abs. 2 lit. b Jagdgesetz", None)],
    "BGBl. I Nr. 12/2010": [("at_bgbl", "BGBl. I Nr. 12/2010", "at_bgbl:i:12/2010")],
    "Bundesgesetzblatt Nr. 7 aus 1999": [("at_bgbl", "Bundesgesetzblatt Nr. 7 aus 1999", "at_bgbl:7/1999")],
    "Verordnung (EU) 2016/679": [("eu_regulation", "Verordnung (EU) 2016/679", "celex:32016R0679")],
    "Regulation (EU) No 910/2014": [("eu_regulation", "Regulation (EU) No 910/2014", None)],
    "Richtlinie 2006/43/EG": [("eu_directive", "Richtlinie 2006/43/EG", "celex:32006L0043")],
    "32016R0679": [("eu_celex", "32016R0679", "celex:32016R0679")],
    "ECLI:EU:C:2014:317": [("eu_ecli", "ECLI:EU:C:2014:317", "ecli:ECLI:EU:C:2014:317")],
    "2 BvR 859/15": [("de_bverfg_docket", "2 BvR 859/15", "de_docket:2 BvR 859/15")],
    "§ 823 BGB": [("de_paragraph", "§ 823 BGB", "de_statute:BGB")],
    "pourvoi n° 18-12.345": [("fr_pourvoi", "pourvoi n° 18-12.345", "fr_pourvoi:18-12.345")],
    "CE, 12 mai 2020, n° 412345": [("fr_conseil_etat", "CE, 12 mai 2020, n° 412345", "fr_ce:412345")],
    "art. 2043 c.c.": [("it_codice_article", "art. 2043 c.c.", "it_codice:c.c.")],
    "Cass. civ. n. 123/2020": [("fr_cassation", "Cass. civ.", None), ("it_cassazione", "Cass. civ. n. 123/2020", "it_cass:123/2020")],
    "Art. 41 Abs. 1 OR": [("article", "Art. 41 Abs. 1 OR", "abbrev_art:OR/41")],
    "Art. 3 Der": [],
    "": [],
}


def test_citations_and_offsets(spark):
    texts = list(CITED)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows(citations.extract(df, "t"), "i", "citation_type", "citation_text", "citation_key")
    assert got == sorted(((i, *c) for i, t in enumerate(texts) for c in CITED[t]), key=repr)
    placed = citations.with_offsets(df, "i", "t").collect()
    assert sorted((r.i, r.citation_type, r.citation_text, r.citation_key) for r in placed if r.citation_key) == sorted(x for x in got if x[3])
    assert all(texts[r.i][r.start : r.end] == r.citation_text for r in placed)


@pytest.mark.parametrize(("q", "want"), [("sr:101", "sr:101"), ("ecli:ecli:eu:c:1:2", "ecli:ECLI:EU:C:1:2"), ("siehe SR 101", "sr:101"), ("BGBl. I Nr. 3/2001", "at_bgbl:3/2001"), ("Art. 8 ZGB", "abbrev_art:ZGB/8"), ("foo:bar", None)])
def test_query_keys(spark, q, want):
    assert one(spark, citations.query_key(F.col("q")), q=q) == want


def test_resolution_and_citing(spark):
    targets = spark.createDataFrame([("d1", None, "sr:1"), ("d1", "s1", "sr:1"), ("d2", None, "sr:2"), ("d3", None, "sr:2")], "document_id string, section_id string, target_key string")
    edges = spark.createDataFrame([("c1", "d9", "sr:1"), ("c2", "d9", "sr:2"), ("c3", "d1", "sr:3"), ("c4", "d1", None)], "citation_id string, source_document_id string, citation_key string")
    got = citations.resolve(edges, targets)
    assert rows(got, "citation_id", "resolution_status", "target_document_id", "target_section_id") == [("c1", "resolved", "d1", "s1"), ("c2", "ambiguous", None, None), ("c3", "no_target_in_corpus", None, None), ("c4", "not_normalizable", None, None)]
    assert rows(citations.resolution_stats(got), "total", "with_key", "resolved", "rate") == [(4, 3, 1, 0.25)]
    keys = spark.createDataFrame([("sr:3",)], "citation_key string")
    assert rows(citations.citing(got, keys, "d1"), "citation_id") == [("c1",)]


def test_search(spark):
    docs = spark.createDataFrame([("d1", "Tierschutz Gesetz", "the law"), ("d2", "Hundegesetz", "Gesetz über Hunde Gesetz"), ("d3", "Anderes", None)], "id string, title string, content string")
    got = search.best_fields(docs, "id", search.query_tokens("Wie Gesetz")).orderBy(F.desc("score")).collect()
    assert [r.doc for r in got] == ["d1", "d2"]
    assert [search.query_shape(q) for q in (None, "*", "SR 101", "Tierschutz Zürich", "was muss ich beim Halten von Hunden beachten")] == ["wildcard", "wildcard", "short_legal", "short_legal", "free_text"]
    n, average = search.corpus_stats(docs, "title")
    assert [r[0] for r in rows(search.bm25(search.postings(docs, "id", "title"), n, average, ["gesetz", "anderes"]), "doc")] == ["d1", "d3"]
    fuzzy = search.fuzzy_tokens(search.postings(docs, "id", "title"), ["gesets", "tierschuts"])
    assert rows(fuzzy, "token", "query") == [("gesetz", "gesets"), ("tierschutz", "tierschuts")]
    boost = docs.select("id", search.phrase_boost(["tierschutz", "gesetz"], fields=["title"]).alias("b"))
    assert rows(boost, "id", "b") == [("d1", 8.0), ("d2", 0.0), ("d3", 0.0)]
    vocabulary = [("ch-zh", ["zurich"], "ch-zh"), ("ch-be", ["bern"], "ch-be")]
    assert search.mentions(["kanton", "zurich", "bern"], vocabulary, ["kanton"]) == ["ch-zh"]
    assert search.mentions(["stadt", "von", "bern"], vocabulary, ["stadt"]) == ["ch-be"]
    assert search.refuses(["a"], ["b"]) and not search.refuses(["a", "b"], ["b"]) and not search.refuses([], ["b"])


def test_gate_order(spark):
    q = spark.createDataFrame([("none", 1.0), ("massless", 0.0), ("low", 100.0), ("flat", 10.0), ("ok", 10.0)], "query_id string, mass double")
    s = spark.createDataFrame([("massless", "d", 1.0), ("low", "d", 7.9), *(("flat", f"d{i}", 5.0) for i in range(3)), ("ok", "d1", 5.0), ("ok", "d2", 1.0), ("ok", "d3", 0.8)], "query_id string, doc_id string, score double")
    assert rows(sparse.gate(q, s, 3, margin=True), "query_id", "verdict", "whole_corpus") == [("flat", "margin_collapse", True), ("low", "below_floor", False), ("massless", "unscorable", False), ("none", "no_candidates", False), ("ok", "admitted", True)]
    g = sparse.gate(q, s)
    assert rows(g.where("verdict = 'admitted'"), "query_id") == [("flat",), ("ok",)] and {r.whole_corpus for r in g.collect()} == {None}
    assert sparse.admitted(g, s, 1).count() == 2
    m = spark.createDataFrame([({"t1": 0.5, "x": 1.0, "t2": 0.001, "t3": float("nan"), "t4": float("inf")},)], "m map<string,double>")
    assert m.select(sparse.sanitised("m").alias("m")).first().m == {"t1": 0.5}


def test_hierarchy(spark):
    tree = spark.createDataFrame([("ch", None, "federal"), ("chf", "ch", "federal"), ("zh", "ch", "cantonal"), ("zhs", "zh", "municipal"), ("x", "y", "federal"), ("y", "x", "federal")], "id string, parent_id string, level string")
    scopes = hierarchy.governing_scopes(tree)
    assert rows(scopes.where("id = 'zhs'"), "scope") == [("ch",), ("chf",), ("zh",), ("zhs",)]
    assert rows(scopes.where("id = 'x'"), "scope") == [("x",), ("y",)]
    assert rows(hierarchy.superiors(scopes).where("id = 'zhs'"), "scope") == [("ch",), ("chf",), ("zh",)]
    assert rows(hierarchy.binding_levels(scopes).where("id = 'zh'"), "norm_level") == [("cantonal",), ("constitutional",), ("federal",)]
    docs = spark.createDataFrame([("zh", "cantonal", "d1", D(2020, 1, 1)), ("zh", "cantonal", "d2", None)], "id string, norm_level string, document_id string, effective_date date")
    got = rows(hierarchy.report(hierarchy.binding_levels(scopes).where("id = 'zh'"), docs, 1), "norm_level", "n", "newest", "covered")
    assert got == [("cantonal", 2, ["d1"], True), ("constitutional", 0, None, False), ("federal", 0, None, False)]
    level = spark.createDataFrame([([30, 40], 10), ([40], 50), ([], 20)], "r array<int>, d int").select(hierarchy.document_level(F.col("r"), F.col("d")).alias("x"))
    assert sorted(r.x for r in level.collect()) == [10, 20, 40]


# --- mutation ---


def test_merges(spark):
    t, s = spark.createDataFrame([(1, "a", None), (2, "b", "m")], "k int, v string, p string"), spark.createDataFrame([(2, "B", None), (3, "C", None)], "k int, v string, p string")
    assert rows(mutation.upsert(t, s, ["k"]), "k", "v") == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(mutation.upsert(mutation.upsert(t, s, ["k"]), s, ["k"]), "k", "v") == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(mutation.insert_new(t, s.unionByName(s), ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(mutation.update_where_null(t, spark.createDataFrame([(1, "A", "q"), (2, "B", "q"), (3, "C", "q")], t.schema), "k", "p"), "k", "v") == [(1, "A"), (2, "b"), (3, "C")]
    assert rows(mutation.patch(t, s, "k", ["v"]), "k", "v", "p") == [(1, "a", None), (2, "B", "m")]
    assert rows(mutation.changed_keys(t, s, "k", ["v"]), "k", "change") == [(1, "removed"), (2, "changed"), (3, "added")]
    merged, missing = mutation.keyed_merge(t, s, "k", "v")
    assert rows(merged, "k", "outcome") == [(1, "unchanged"), (2, "updated")] and rows(missing, "k") == [(3,)]


def test_history_by_steps_equals_history_from_a_log(spark):
    days = [F.lit(f"2024-01-0{i}").cast("timestamp") for i in (1, 2, 3, 4)]
    history = spark.createDataFrame([], "k string, s string, valid_from timestamp, valid_to timestamp")
    states = [[("a", "x"), ("b", None)], [("a", "x"), ("b", "n")], [("a", "y"), ("c", "z")], [("a", "y"), ("c", "z"), ("b", "n")]]
    for day, state in zip(days, states, strict=True):
        history = spark.createDataFrame(mutation.scd2_apply(history, spark.createDataFrame(state, "k string, s string"), "k", ["s"], day).collect(), history.schema)
        assert history.where("valid_to IS NULL").groupBy("k").count().where("count > 1").count() == 0
    got = [(r.k, r.s, r.valid_from.day, r.valid_to and r.valid_to.day) for r in history.collect()]
    assert sorted(got, key=repr) == sorted([("a", "x", 1, 3), ("a", "y", 3, None), ("b", None, 1, 2), ("b", "n", 2, 3), ("b", "n", 4, None), ("c", "z", 3, None)], key=repr)
    log = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("a", "y", 4)], "k string, s string, t int")
    assert rows(mutation.scd2_from_log(log, "k", ["s"], "t"), "s", "valid_from", "valid_to", "is_current") == [("x", 1, 3, False), ("y", 3, None, True)]


def test_scd2_steps_keep_the_history_of_all_orders(spark):
    from quillon.plans.registered import QUERIES
    from tests.conftest import MEDIUM

    keeps = [lambda k: k % 2 == 0, lambda k: k % 3 > 0, lambda k: k % 5 > 0]
    day = lambda i: 1_704_067_200_000_000 + (i - 1) * 86_400_000_000  # noqa: E731 - microseconds of 2024-01-0i
    want = []
    for k, status in spark.read.parquet(f"{MEDIUM}/orders.parquet").select("o_orderkey", "o_orderstatus").collect():
        now = None
        for i, keep in enumerate(keeps, 1):
            new = ("X" if k % 7 == i else status) if keep(k) else None
            if now and now[0] != new:
                want.append((k, now[0], now[1], day(i)))
                now = None
            if new and not now:
                now = (new, day(i))
        want += [(k, *now, None)] if now else []
    got = [tuple(r) for r in QUERIES["scd2_steps"](spark, MEDIUM).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and max(r[0] for r in got) >= 2000


def test_retraction_guardrails(spark):
    docs = spark.createDataFrame([(f"d{i}", 1) for i in range(20)] + [("d1", 2)], "document_id string, document_revision int")
    parts = spark.createDataFrame([("d1", "s"), ("d2", "s")], "document_id string, section_id string")
    at = F.lit("2024-01-01").cast("timestamp")
    call = lambda ids_, code="takedown", why="r", who="o", by=None: mutation.retract(docs, parts, ids_, code, why, who, by, at)
    r = call(["d1", "gone"])
    assert (r.matched, r.documents.count(), r.sections.count(), r.ledger.first().retracted_revisions) == (1, 19, 1, [1, 2])
    assert call(["gone"]).matched == 0
    for bad in ({"ids_": ["d1"], "code": "x"}, {"ids_": ["d1"], "why": " "}, {"ids_": ["d1"], "who": ""}, {"ids_": ["d1", "d2", "d3"]}, {"ids_": ["d1"], "by": "d1"}, {"ids_": ["d1"], "by": "nope"}, {"ids_": ["d1"], "code": "duplicate_identity"}):
        with pytest.raises(mutation.Refused):
            call(**bad)


def test_orphans_sweep_audit_and_overlay(spark):
    index, canonical = spark.createDataFrame([(i,) for i in range(8)], "k int"), spark.createDataFrame([(i,) for i in range(7)], "k int")
    assert rows(mutation.orphans(index, canonical, "k"), "k") == [(7,)]
    with pytest.raises(mutation.Refused):
        mutation.orphans(index, canonical.limit(0), "k")
    with pytest.raises(mutation.Refused):
        mutation.orphans(index, canonical.where("k < 3"), "k")
    kept, n = mutation.sweep(index, F.col("k") > 5, dry_run=False)
    assert (kept.count(), n, mutation.sweep(index, F.col("k") > 5)[0].count()) == (6, 2, 8)
    m = spark.createDataFrame([({"a": "1", "b": "1"}, {"a": "1"})], "e map<string,string>, s map<string,string>")
    audit = mutation.metadata_audit(m, ["a", "b", "c"], "e", "s")
    assert rows(audit, "key", "verdict") == [("a", "PRESENT"), ("b", "DROPPED"), ("c", "NEVER_EMITTED")]
    assert rows(mutation.metadata_audit(m.limit(0), ["a"], "e", "s"), "key", "verdict") == [("a", "INDETERMINATE")]
    assert rows(mutation.repair_plan(audit), "key", "action")[1] == ("b", "widen schema and replay")
    assert m.select(mutation.overlaid(F.col("e"), F.create_map(F.lit("b"), F.lit("2"))).alias("m")).first().m == {"a": "1", "b": "2"}
    moves = spark.createDataFrame([("pending", "applied"), ("applied", "rejected")], "a string, b string").select(mutation.may_move(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in moves.collect()] == [True, False]


# --- coverage, quality, evaluation ---


def test_control_status_classes(spark):
    e = spark.createDataFrame([(1, 1, "failed", 1), (2, 1, "failed", 2), (2, 2, "failed", 3), (2, 3, "failed", 4), (3, 1, "started", 5), (4, 1, "started", 6), (4, 2, "succeeded", 7), (5, 1, "dead_letter", 8), (6, 1, "other", 9), (7, 1, "failed", 10), (7, 1, "started", 11)], "k int, t int, e string, i int")
    got = rows(coverage.control_status(e, "k", "t", "e", "i"), "k", "control_status", "failed_attempts")
    assert got == [(1, "retryable", 1), (2, "dead_letter", 3), (3, "in_progress", 0), (4, "done", 0), (5, "dead_letter", 0), (6, "processing", 0), (7, "in_progress", 1)]


def test_gap_queue_payload_and_rollup(spark):
    df = spark.createDataFrame([("b", 5, 3, "PUBLISHED", False), ("a", 5, 3, "ESTIMATED", False), ("c", 5, 9, "PUBLISHED", True)], "n string, e int, h int, t string, x boolean")
    gap = coverage.gap("e", "h", "t", "x")
    assert rows(df.select("n", gap.alias("g")), "n", "g") == [("a", None), ("b", 2), ("c", None)]
    queue = coverage.work_queue(df, [("gap", gap > 0), ("excess", F.col("h") > F.col("e")), ("guess", F.col("t") == "ESTIMATED")], "n").collect()
    assert [(r.n, r.reasons) for r in queue] == [("b", ["gap"]), ("c", ["excess"]), ("a", ["guess"])]
    p = spark.createDataFrame([([(3, 1)],), ([(3, 1), (4, 2)],), ([(0, 1)],), ([],)], "p array<struct<expected:int,observed:int>>").select(coverage.coverage_payload(F.col("p")).alias("x"))
    assert [tuple(r.x) for r in p.collect()] == [("ATTRIBUTED", 3, 1), ("AMBIGUOUS", None, 3), ("ATTRIBUTED", None, 1), ("AMBIGUOUS", None, 0)]
    place = spark.createDataFrame([("none", False, False, None, 0, 0, None, None), ("template", False, True, None, 0, 0, None, None), ("new", True, False, None, 0, 1, None, None), ("over", True, False, 3, 5, 0, -2, 1)], "n string, has_source boolean, has_template boolean, expected int, acquired int, refused int, a int, p int")
    queue = {r.n: r.reasons for r in coverage.work_queue(place, coverage.work_reasons("a", "p"), "n").collect()}
    assert queue == {"none": ["NO_SOURCE"], "template": ["NO_SOURCE_TEMPLATE_AVAILABLE"], "new": ["NO_DENOMINATOR", "NEVER_ACQUIRED", "REFUSALS_OUTSTANDING"], "over": ["PROCESSING_GAP", "HOLDINGS_EXCEED_DENOMINATOR"]}
    at = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    roll = lambda s, run, end: one(spark, coverage.rollup(F.split("s", ","), F.lit(run), end, at(9)), s=s)
    assert [roll("ok,pending,blocked", "completed", at(1)), roll("ok,pending", "completed", at(1)), roll("ok,pending", "completed", F.lit(None).cast("timestamp")), roll("ok", "failed", at(1)), roll("ok,in_progress", "running", at(1))] == ["blocked", "stalled", "in_progress", "ok", "in_progress"]


def test_stages_causes_locks_and_gates(spark):
    n = F.lit(None)
    stage = lambda latest, run="completed", open_=0, late=0: one(spark, coverage.processing_stage(F.lit(latest).cast("string"), F.lit(run), F.lit(open_), F.lit(late)), s="")
    assert [stage(None), stage(None, "failed"), stage("failed", late=3), stage("quarantined"), stage("accepted"), stage("canonical_ready"), stage("canonical_ready", open_=2), stage("canonical_ready", open_=2, late=1)] == ["pending", "blocked", "failed", "blocked", "in_progress", "ok", "in_progress", "blocked"]
    assert one(spark, coverage.projection_stage(F.lit("quarantined"), n), s="") == "blocked" and one(spark, coverage.search_stage(F.lit("x")), s="") == "ok"
    assert one(spark, coverage.reachable(F.split("s", ","), F.lit("cancelled")), s="ok,pending") == ["ok", "not_applicable"]
    cause = lambda run, p, li, di="ok", pr="ok", se="ok", refused=False: one(spark, coverage.stall_cause(F.lit(refused), F.lit(run), F.lit(p), F.lit(li), F.lit(di), F.lit(pr), F.lit(se)), s="")
    assert [cause("pending", 0, 0, refused=True), cause("pending", 0, 0), cause("completed", 0, 0), cause("running", 0, 0), cause("completed", 1, 0, "in_progress"), cause("completed", 1, 0, "ok", "pending"), cause("completed", 1, 1, "ok", "ok", "pending"), cause("completed", 1, 1)] == ["run_refused_by_lock", "no_dispatch_worker", "publish_path_disabled", "too_early_to_diagnose", "di_consumer_silent", "projection_stalled", "search_projection_pending", "unknown"]
    t = spark.createDataFrame([("a", "live", True, None), ("b", "live", False, None), ("c", "live", False, "override"), ("d", "awaiting_evidence", True, None), ("e", "?", True, None)], "n string, r string, e boolean, p string")
    out = coverage.launch_class(t, "r", "e", "p")
    assert rows(out, "n", "lock_state", "blocker") == [("a", "open", None), ("b", "acceptance_only", "template_never_enabled"), ("c", "closed", "template_disabled_by_operator"), ("d", "acceptance_only", "provider_awaiting_evidence"), ("e", "closed", "provider_scaffold")]
    assert tuple(coverage.launch_summary(out).first()) == (5, 1, 3, 1)
    g = spark.createDataFrame([(None,), ([],), ([("x", "passed"), ("y", "excluded")],), ([("x", "not_evaluated")],)], "g array<struct<gate:string,outcome:string>>").select(coverage.gate_verdict(F.col("g")).alias("v"))
    assert [(r.v.reported, r.v.is_evidence, r.v.refusals) for r in g.collect()] == [(False, True, []), (False, False, ["gate_coverage_unknown"]), (True, True, []), (True, False, ["gate_not_evaluated"])]


def test_reconciliation(spark):
    e = spark.createDataFrame([("u1", "2024-01-01", "accepted", 1), ("u1", "2024-01-01", "canonical_ready", 2), ("u2", "2024-01-01", "accepted", 3), ("u3", "2024-01-09", "processing", 4)], "u string, t string, s string, i int").withColumn("t", F.col("t").cast("timestamp"))
    units = coverage.reconcile_units(e, "u", "t", "s", "i", ["canonical_ready"], F.lit("2024-01-09 12:00:00").cast("timestamp"))
    assert rows(units, "u", "latest_status", "terminated", "past_deadline") == [("u1", "canonical_ready", True, False), ("u2", "accepted", False, True), ("u3", "processing", False, False)]
    assert [coverage.reconcile_verdict(u).first().verdict for u in (units, units.where("terminated"), units.limit(0))] == ["UNTERMINATED", "RECONCILED", "NOTHING_OBSERVED"]
    assert rows(coverage.stranded(units, F.lit("2024-01-05").cast("timestamp")), "u") == [("u2",)]
    assert coverage.freshness(e, "t", F.lit("2024-01-09 03:00:00").cast("timestamp")).first().status == "warn"


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (None, "c", 3)], "k int, s string, i int")
    got = data_quality.row_rules(df, {"known": data_quality.not_null("k"), "set": data_quality.accepted("s", ["a", "b"]), "range": data_quality.between("i", 0, 1, F.col("s") != "c")})
    assert rows(got, "rule", "failures") == [("known", 1), ("range", 0), ("set", 1)]
    sets = {"unique": data_quality.not_unique(df, "k"), "dense": data_quality.sparse_index(df.withColumn("g", F.lit(1)), ["g"], "i"), "parent": data_quality.unrelated(df, "s", df.where("k = 1"), "s")}
    assert rows(data_quality.run(sets), "rule", "failures") == [("dense", 1), ("parent", 1), ("unique", 1)]
    assert data_quality.column_contract(df, ["k", "z"]) == ({"z"}, {"s", "i"})


def test_evaluation(spark):
    schema = "query_id string, gold_short_answer string, answer_text string, required_doc_ids string, used_doc_ids string, forbidden_doc_ids string, source_class_claimed string, expected_source_class string, task_type string, model_flags string, must_flag_non_binding string"
    df = spark.createDataFrame([("q1", "must keep dogs leashed", "Dogs are leashed", "a|b", "a|c", "c", "law", "law", "temporal_version", "temporal_ok=true", "true")], schema)
    r = evaluation.score(df).first()
    assert (r.correctness, r.citation_precision, r.citation_recall, r.temporal_accuracy, r.hallucination) == (0.5, 0.0, 0.5, 1.0, 0.0)
    assert r.overall_score == round(0.3 * 0.5 + 0.1 * 0.5 + 0.15 + 0.1 + 0.05 * (0.5 * 0.7 + 0.5 * 0.3), 3)
    assert evaluation.summary(evaluation.score(df)).first().passed is False
