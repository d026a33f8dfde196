"""Citation extraction, keys, resolution and the citation graph.

A pattern's matches are taken natively by ``regexp_extract_all``; only exact offsets need Python (``with_offsets``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import shared_folder

# Citation types in order of extraction, with the pattern of each.
PATTERNS: dict[str, str] = {
    "sr": r"\bSR\s+(\d{3}(?:\.\d+)*)\b",
    "bge": r"\bBGE\s+\d{1,3}\s+[IV]+\s+\d+(?:\s+E\.\s+[\d.]+)?\b",
    "ch_paragraph": r"§§?\s*(\d+[a-z]?)(?:\s*,\s*\d+[a-z]?)*(?:\s+Abs\.?\s*\d+[a-z]?)?(?:\s+(?:lit|Bst)\.?\s*[a-z])?\s+(?!Verordnung\b)([A-ZÄÖÜ][A-Za-zÄÖÜäöüß]*?(?:gesetz|verordnung|ordnung|reglement|verfassung|vorschriften|statut|erlass|beschluss|dekret|konkordat))\b",
    "at_bgbl": r"(?i)\b(?:BGBl\.\s*(?:([IVX]+)\s*)?Nr\.\s*(\d+[a-zA-Z]?)/(\d{4})|Bundesgesetzblatt\s+(?:(?:Teil\s*)?([IVX]+)\s*,?\s*)?Nr\.\s*(\d+[a-zA-Z]?)\s+aus\s+(\d{4}))\b",
    "eu_regulation": r"(?i)\b(?:Regulation|Verordnung|Règlement)\s*\((?:EU|EG|EC|CE)\)\s*(?:No\.?\s*)?\d{1,4}/\d{2,4}\b",
    "eu_directive": r"(?i)\b(?:Directive|Richtlinie)\s*\d{4}/\d{1,4}/(?:EU|EG|EC|CE)\b",
    "eu_celex": r"\b[1-9]\d{4}[A-Z]{1,2}\d{4}(?:\([A-Z0-9]+\))?\b",
    "eu_ecli": r"\bECLI:EU:([CTF]):(\d{4}):(\d{1,5})\b",
    "de_bverfge": r"\bBVerfGE\s+\d{1,3},\s*\d{1,4}(?:\s*\(\d{1,4}\))?",
    "de_bverfg_docket": r"\b([12])\s+(BvR|BvL|BvE|BvF|BvG|BvK|BvM|BvN|BvQ|PBvU)\s+(\d{1,5})/(\d{2,4})\b",
    "de_bgh": r"\b(BGHZ|BGHSt)\s+\d{1,3},\s*\d{1,4}(?:\s*\(\d{1,4}\))?\b",
    "de_ecli": r"\bECLI:DE:([A-Z]{2,10}):(\d{4}):([A-Za-z0-9._-]+)\b",
    "de_paragraph": r"§§?\s*\d+[a-z]?(?:\s*,\s*\d+[a-z]?)*\s+(BGB|StGB|ZPO|StPO|HGB|GG|AO|AktG|UWG|UrhG|MarkenG|PatG|InsO|EStG|KStG|UStG|GewO|BauGB|BauNVO|SGB|VwVfG|VwGO|GVG|MietspiegelG|TKG|TMG|BDSG|BetrVG|KSchG|ArbGG|StVO|StVG)\b",
    "fr_code_article": r"\b(?:[Aa]rt(?:icle)?\.?)\s+(?:[LRD]\.?\s*)?\d+(?:-\d+)*\s+du\s+[Cc]ode\s+(?:civil|p[ée]nal|de\s+(?:commerce|proc[ée]dure\s+(?:civile|p[ée]nale))|du\s+travail|de\s+l['’]environnement|de\s+la\s+consommation|de\s+la\s+sant[ée]\s+publique|des\s+assurances)\b",
    "fr_pourvoi": r"(?i)\b(?:pourvoi\s+)?n[°º]\s*(\d{2}-\d{2}\.\d{3,5})\b",
    "fr_cassation": r"(?i)\bCass\.?\s*(?:civ|com|soc|crim|mixte|ass\.?\s*pl[eé]n)\.?(?:\s*\d+re?e?)?",
    "fr_conseil_etat": r"(?i)\bCE\s*,\s*(?:(?:\d{1,2}\s+\w+\s+\d{4})\s*,\s*)?n[°º]\s*(\d{5,7})\b",
    "fr_ecli": r"\bECLI:FR:([A-Z]{1,6}):(\d{4}):([A-Za-z0-9._-]+)\b",
    "it_codice_article": r"\b[Aa]rt(?:icolo|\.)?\s+\d+(?:-\w+)?(?:,?\s*comma\s+\d+)?\s+([Cc]\.?\s*[cp]\.?(?:\s*[cp]\.?)?)",
    "it_cassazione": r"(?i)\bCass(?:azione|\.)\s*(?:civ|pen|sez\.?\s*[IVX]+|lav|trib|unite?)\.?(?:\s*,?\s*sez\.?\s*[IVX]+)?\s*,?\s*n\.?\s*(\d{1,6})/(\d{4})\b",
    "it_consiglio_stato": r"(?i)\bCons(?:iglio)?\.?\s+(?:di\s+)?Stato\s*,?\s*(?:Sez\.?\s*[IVX]+)?\s*,?\s*n\.?\s*(\d{1,6})/(\d{4})\b",
    "it_ecli": r"\bECLI:IT:([A-Z]{2,8}):(\d{4}):([A-Za-z0-9._-]+)\b",
    "article": r"\bArt\.?\s+(\d+(?:bis|ter|quater|quinquies|sexies)?)(?:\s+(?:Abs|al|cpv)\.?\s+\d+)?(?:\s+(?:lit|let)\.?\s+[a-z])?\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöü]+)\b",
}
ABBREVIATION = r"^(?=(?:.*[A-ZÄÖÜ]){2})[A-ZÄÖÜ][A-Za-zÄÖÜäöü]*$"
IDENTIFIER_TYPES = ("sr", "celex", "ecli", "at_bgbl", "de_docket", "de_statute", "fr_pourvoi", "fr_ce", "it_cass", "it_cds", "it_codice", "official_citation", "abbrev", "abbrev_art")
EU_COURTS = {"C": "court-of-justice", "T": "general-court", "F": "civil-service-tribunal"}


def _java(pattern: str) -> str:
    """Word classes are Unicode's, as in the language the patterns come from."""
    return "(?U)" + pattern


def _group(kind: str, text: Column, group: int) -> Column:
    return F.regexp_extract(text, _java(PATTERNS[kind]), group)


def _padded(text: Column, letter: str) -> Column:
    year, number = F.regexp_extract(text, r"(\d{4})/(\d{1,4})", 1), F.regexp_extract(text, r"(\d{4})/(\d{1,4})", 2)
    return F.when(year != "", F.concat(F.lit("celex:3"), year, F.lit(letter), F.lpad(number, 4, "0")))


def key(kind: Column, text: Column) -> Column:
    """The lookup key of a citation, or null for kinds that need a search."""
    g = lambda k, i: _group(k, text, i)
    part = F.lower(F.coalesce(F.nullif(g("at_bgbl", 1), F.lit("")), F.nullif(g("at_bgbl", 4), F.lit("")), F.lit("")))
    number = F.coalesce(F.nullif(g("at_bgbl", 2), F.lit("")), g("at_bgbl", 5))
    year = F.coalesce(F.nullif(g("at_bgbl", 3), F.lit("")), g("at_bgbl", 6))
    return (
        F.when(kind == "sr", F.concat(F.lit("sr:"), g("sr", 1)))
        .when(kind == "eu_celex", F.concat(F.lit("celex:"), text))
        .when(kind.isin("eu_ecli", "de_ecli", "fr_ecli", "it_ecli"), F.concat(F.lit("ecli:"), text))
        .when(kind == "de_bverfg_docket", F.concat(F.lit("de_docket:"), g("de_bverfg_docket", 1), F.lit(" "), g("de_bverfg_docket", 2), F.lit(" "), g("de_bverfg_docket", 3), F.lit("/"), g("de_bverfg_docket", 4)))
        .when(kind == "at_bgbl", F.concat(F.lit("at_bgbl"), F.when(part != "", F.concat(F.lit(":"), part)).otherwise(""), F.lit(":"), number, F.lit("/"), year))
        .when(kind == "eu_regulation", _padded(text, "R"))
        .when(kind == "eu_directive", _padded(text, "L"))
        .when(kind == "de_paragraph", F.concat(F.lit("de_statute:"), g("de_paragraph", 1)))
        .when(kind == "fr_pourvoi", F.concat(F.lit("fr_pourvoi:"), g("fr_pourvoi", 1)))
        .when(kind == "fr_conseil_etat", F.concat(F.lit("fr_ce:"), g("fr_conseil_etat", 1)))
        .when(kind == "it_cassazione", F.concat(F.lit("it_cass:"), g("it_cassazione", 1), F.lit("/"), g("it_cassazione", 2)))
        .when(kind == "it_consiglio_stato", F.concat(F.lit("it_cds:"), g("it_consiglio_stato", 1), F.lit("/"), g("it_consiglio_stato", 2)))
        .when(kind == "it_codice_article", F.concat(F.lit("it_codice:"), F.replace(F.lower(F.trim(g("it_codice_article", 1))), F.lit(" "), F.lit(""))))
        .when((kind == "article") & g("article", 2).rlike(ABBREVIATION), F.concat(F.lit("abbrev_art:"), g("article", 2), F.lit("/"), g("article", 1)))
    )


def key_aliases(k: Column) -> Column:
    """A key and, for gazette keys with a part, the form without it that targets are stored under."""
    return F.when(k.rlike("^at_bgbl:[^:]+:"), F.array(k, F.regexp_replace(k, "^at_bgbl:[^:]+:", "at_bgbl:"))).otherwise(F.array(k))


def extract(df: DataFrame, text: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """One row per distinct (text, type) of each row's citations: ``citation_type``, ``citation_text``, ``citation_key``.

    ``emit_order`` orders by type, then place. Citations of different types may overlap. Fully native.
    """

    def of(kind: str) -> Column:
        every = F.regexp_extract_all(F.col(text), F.lit(_java(PATTERNS[kind])), F.lit(0))
        return F.transform(every, lambda m: F.struct(F.lit(kind).alias("citation_type"), m.alias("citation_text")))

    found = [of(k) for k in kinds]
    rows = df.select(*df.columns, F.posexplode(F.array_distinct(F.concat(*found))).alias("emit_order", "__c")).select(*df.columns, "emit_order", "__c.*")
    shaped = (F.col("citation_type") != "article") | _group("article", F.col("citation_text"), 2).rlike(ABBREVIATION)
    return rows.where(shaped).withColumn("citation_key", key(F.col("citation_type"), F.col("citation_text")))


def with_offsets(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """The same with ``start`` and ``end``, ordered by start; in Arrow batches, as built-in functions give no offsets."""
    import re

    patterns = [(k, re.compile(p)) for k, p in PATTERNS.items()]
    shape = re.compile(ABBREVIATION)
    kind = df.schema[id_column].dataType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, out = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                seen: dict[tuple[str, str], tuple] = {}
                for name, p in patterns:
                    for m in p.finditer(t or ""):
                        if name != "article" or shape.match(m.group(2)):
                            seen.setdefault((m.group(0), name), (name, m.group(0), m.start(), m.end()))
                rows = sorted(seen.values(), key=lambda r: r[2])
                which += [i] * len(rows)
                out += rows
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(which, pa.int64())), *[pa.array(c, ty) for c, ty in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]], [id_column, "citation_type", "citation_text", "start", "end"])

    rows = df.select(id_column, text).mapInArrow(f, f"{id_column} {kind}, citation_type string, citation_text string, start int, end int")
    return rows.withColumn("citation_key", key(F.col("citation_type"), F.col("citation_text")))


def query_key(q: Column) -> Column:
    """The key a search text names; the first kind that matches wins."""
    t = F.trim(q)
    given = F.when(F.split_part(t, F.lit(":"), F.lit(1)).isin(*IDENTIFIER_TYPES) & (F.instr(t, ":") > 1), F.when(t.startswith("ecli:"), F.concat(F.lit("ecli:"), F.upper(F.substring(t, F.lit(6), F.length(t))))).otherwise(t))
    found = lambda p, i: F.nullif(F.regexp_extract(t, _java(p), i), F.lit(""))
    bgbl = r"(?i)BGBl\.?\s*(?:[IVX]+\s*)?Nr\.?\s*(\d+[a-zA-Z]?)/(\d{4})"
    regulation, directive = r"(?i)(?:Regulation|Verordnung|Règlement)\s*\((?:EU|EG|EC|CE)\)\s*(?:No\.?\s*)?(\d{4})/(\d{1,4})", r"(?i)(?:Directive|Richtlinie)\s*(\d{4})/(\d{1,4})/(?:EU|EG|EC|CE)"
    return F.coalesce(
        given,
        F.concat(F.lit("ecli:"), F.upper(found(r"(?i)\bECLI:[A-Z]{2}:[A-Z0-9]+:\d{4}:[A-Z0-9._-]+", 0))),
        F.concat(F.lit("sr:"), found(PATTERNS["sr"], 1)),
        F.concat(F.lit("at_bgbl:"), found(bgbl, 1), F.lit("/"), found(bgbl, 2)),
        F.concat(F.lit("celex:3"), found(regulation, 1), F.lit("R"), F.lpad(found(regulation, 2), 4, "0")),
        F.concat(F.lit("celex:3"), found(directive, 1), F.lit("L"), F.lpad(found(directive, 2), 4, "0")),
        F.concat(F.lit("celex:"), found(r"\b([1-9]\d{4}[A-Z]{1,2}\d{4})\b", 1)),
        F.when(found(PATTERNS["article"], 2).rlike(ABBREVIATION), F.concat(F.lit("abbrev_art:"), found(PATTERNS["article"], 2), F.lit("/"), found(PATTERNS["article"], 1))),
    )


def resolve(edges: DataFrame, targets: DataFrame, key_column: str = "citation_key") -> DataFrame:
    """Adds ``resolution_status`` and ``target_document_id`` (C26): not_normalizable, no_target_in_corpus, ambiguous or resolved.

    Several targets of one document are no ambiguity; of these one with a section is preferred. No cap on keys.
    """
    per_key = targets.groupBy(F.col("target_key").alias(key_column)).agg(F.count_distinct("document_id").alias("__docs"), F.min_by(F.struct("document_id", "section_id"), F.struct(F.col("section_id").isNull(), "document_id", "section_id")).alias("__best"))
    joined = edges.join(per_key, key_column, "left")
    status = F.when(F.col(key_column).isNull(), "not_normalizable").when(F.col("__docs").isNull(), "no_target_in_corpus").when(F.col("__docs") > 1, "ambiguous").otherwise("resolved")
    one = F.col("__docs") == 1
    return joined.withColumn("resolution_status", status).withColumn("target_document_id", F.when(one, F.col("__best.document_id"))).withColumn("target_section_id", F.when(one, F.col("__best.section_id"))).drop("__docs", "__best")


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Totals, with a key, resolvable, rate."""
    return resolved.agg(F.count("*").alias("total"), F.count("citation_key").alias("with_key"), F.count_if(F.col("resolution_status") == "resolved").alias("resolved")).withColumn("rate", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("resolved") / F.col("total"), 4)))


def citing(edges: DataFrame, keys: DataFrame, document_id: str | None, limit: int | None = None) -> DataFrame:
    """Edges that name one of the keys or point at the document, without the document's own."""
    by_key = edges.join(keys.select("citation_key").distinct(), "citation_key", "left_semi")
    by_document = edges.where(F.col("target_document_id") == document_id) if document_id is not None else edges.limit(0)
    found = by_key.unionByName(by_document).dropDuplicates(["citation_id"]).orderBy("citation_id")
    found = found if limit is None else found.limit(limit)
    return found if document_id is None else found.where(~F.col("source_document_id").eqNullSafe(document_id))


def targets_of(documents: DataFrame) -> DataFrame:
    """Keys under which documents are found (C27): the official citation, and the first register, CELEX and ECLI number in it or the title."""
    text = F.concat_ws(" ", "official_citation", "title")
    first = lambda p, prefix, i: F.when(F.regexp_extract(text, _java(p), 0) != "", F.concat(F.lit(prefix), F.regexp_extract(text, _java(p), i)))
    bgbl = F.when(_group("at_bgbl", text, 0) != "", key(F.lit("at_bgbl"), _group("at_bgbl", text, 0)))
    keys = F.array_compact(F.array(F.concat(F.lit("official_citation:"), F.nullif(F.trim("official_citation"), F.lit(""))), first(PATTERNS["sr"], "sr:", 1), first(PATTERNS["eu_celex"], "celex:", 0), first(r"\bECLI:[A-Z]{2}:[A-Z0-9]+:\d{4}:[A-Za-z0-9._-]+", "ecli:", 0), F.regexp_replace(bgbl, "^at_bgbl:[^:]+:", "at_bgbl:"), bgbl))
    w = Window.partitionBy("document_id", "target_key").orderBy("__pos")
    return documents.select("document_id", F.lit(None).cast("string").alias("section_id"), F.posexplode(keys).alias("__pos", "target_key")).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__pos")


def forward(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """What each search text (``q``) names: its key, how that resolves and to which document."""
    return resolve(queries.withColumn("citation_key", query_key(F.col("q"))), targets)


def resolve_on_write(edges: DataFrame, lookup: Callable[[], DataFrame]) -> DataFrame:
    """Edges resolved against the targets that ``lookup`` reads; if they cannot be read, edges are written as they came.

    Targets are read whole here, into the shared folder, so a lookup that fails only when it runs leaves the edges
    untouched too, and the write itself no longer depends on it.
    """
    shared_folder(edges.sparkSession)
    try:
        targets = lookup().select("target_key", "document_id", "section_id").checkpoint()
    except Exception:  # whatever kept the targets from being read
        return edges
    known = [c for c in ("resolution_status", "target_document_id", "target_section_id") if c in edges.columns]
    return resolve(edges.drop(*known), targets)


def citations_of(edges: DataFrame, document_id: str) -> DataFrame:
    """A document's own citations, by where they stand."""
    return edges.where(F.col("source_document_id") == document_id).orderBy("citation_id")


def cited_by(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(document_id, n_citations, n_documents): how often others cite each document by any of its keys.

    A document of one key, however many share that key, has its key's sums without what it says itself, so no pair of
    citation and document is made; only documents of several keys are joined to the sources of each, which may be the same.
    """
    cited = edges.where("citation_key IS NOT NULL").groupBy("citation_key", F.col("source_document_id").alias("source")).agg(F.count("*").alias("n"))
    of_keys = targets.where("target_key IS NOT NULL").select(F.col("target_key").alias("citation_key"), "document_id").distinct()
    documents = of_keys.groupBy("document_id").agg(F.count("*").alias("keys"), F.min("citation_key").alias("citation_key"))
    one = (F.col("keys") == 1) & F.col("document_id").isNotNull()
    single = documents.where(one).select("document_id", "citation_key")
    sums = cited.groupBy("citation_key").agg(F.sum("n").alias("__n"), F.count("source").alias("__sources"))
    own = cited.select("citation_key", F.col("source").alias("document_id"), F.col("n").alias("__own"))
    found = single.join(own, ["citation_key", "document_id"], "left").join(sums, "citation_key")
    counts = found.select("document_id", (F.col("__n") - F.coalesce("__own", F.lit(0))).alias("n_citations"), (F.col("__sources") - F.when(F.col("__own").isNull(), 0).otherwise(1)).alias("n_documents")).where("n_citations > 0")
    rest = documents.where(~one)
    if rest.isEmpty():
        return counts
    pairs = of_keys.join(rest.select(F.col("document_id").alias("__d")), F.col("document_id").eqNullSafe(F.col("__d")), "left_semi")
    others = cited.join(pairs, "citation_key").where(~F.col("source").eqNullSafe(F.col("document_id")))
    return counts.unionByName(others.groupBy("document_id").agg(F.sum("n").alias("n_citations"), F.count_distinct("source").alias("n_documents")))
