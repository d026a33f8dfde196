"""The bronze-to-marts plan: staging, identity, sections, entities, control status, serving marts, fact and dimension.

Every step is a function of DataFrames. Sides are aggregated to one row per key before they are joined, lists have an
order, ties have a rule, and no column depends on the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.ids import document_id, hash_id
from quillon.operators.chunking import chunks
from quillon.operators.coverage import DONE
from quillon.operators.coverage import control_status as classified
from quillon.sources.schemas import DOCLING, ENTITIES, RELATIONS

# Labels and relations that are kept.
ENTITY_LABELS = ("PERSON", "ORG", "GPE", "LOC", "DATE", "MONEY", "LAW", "PRODUCT", "EVENT")
RELATION_TYPES = ("nsubj", "nsubjpass", "dobj", "pobj", "appos", "compound", "prep", "agent", "attr", "nmod")


def landing(envelopes: DataFrame) -> DataFrame:
    """Captured document candidates, typed and with defaults."""
    kept = envelopes.where((F.col("artifact_type") == "document_candidate") & (F.col("http_status").try_cast("int") == 200))
    typed = kept.withColumns({"retrieved_at": F.col("retrieved_at").try_cast("timestamp"), "http_status": F.col("http_status").try_cast("int"), "discovery_depth": F.col("discovery_depth").try_cast("int")})
    return typed.fillna({"country": "UNKNOWN", "jurisdiction": "UNKNOWN", "document_class": "unknown"}).drop("ingested_at", "_source_file")


def docling(raw: DataFrame) -> DataFrame:
    """Parsed documents: one JSON column as typed columns."""
    parsed = raw.withColumn("doc", F.from_json("docling_json", DOCLING))
    return parsed.select(F.coalesce("document_version_id", "file_id").alias("document_version_id"), "file_id", F.col("processed_at").try_cast("timestamp").alias("processed_at"), "policy_set_id", "doc.*")


def manifests(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"failure_type": F.col("failure.failure_type"), "failure_message": F.col("failure.message"), "canonical_ready_at": F.col("canonical_ready_at").cast("timestamp")})


def events(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"attempt_number": F.col("attempt_number").try_cast("int"), "event_timestamp": F.col("event_timestamp").try_cast("timestamp")})


def identity(staged: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Ids of document and version, and whether this content is new for its document (F1, M5)."""
    ids = staged.withColumn("document_id", document_id("source_system", "source_document_id", "language", "source_uri")).withColumn("document_version_id", hash_id("source_system", "source_uri", "checksum"))
    out = ids.select("document_id", "document_version_id", "ingestion_id", "source_system", "source_uri", "source_document_id", F.col("checksum").alias("content_hash"), "country", "jurisdiction", "document_class", "language", "retrieved_at")
    once = out.withColumn("__rn", F.row_number().over(Window.partitionBy("document_version_id").orderBy(F.desc("retrieved_at"), F.desc("ingestion_id")))).where("__rn = 1").drop("__rn")  # D13
    if prior is None:
        return once.withColumn("is_new_version", F.lit(True))
    seen = prior.select("document_id", "content_hash").distinct().withColumn("__seen", F.lit(True))
    return once.join(seen, ["document_id", "content_hash"], "left").withColumn("is_new_version", F.col("__seen").isNull()).drop("__seen")


def sections(parsed: DataFrame) -> DataFrame:
    """One row per section with content."""
    rows = parsed.where("sections IS NOT NULL").select("document_version_id", "file_id", F.col("title").alias("document_title"), "document_type", "source_uri", "processed_at", F.posexplode("sections").alias("section_idx", "s"))
    kept = rows.where(F.length(F.trim("s.content")) > 0)
    return kept.select(hash_id("document_version_id", "section_idx").alias("section_id"), "document_version_id", "file_id", "section_idx", "document_title", "document_type", "source_uri", F.col("s.heading").alias("section_heading"), F.col("s.level").alias("heading_level"), F.col("s.content").alias("section_content"), "s.page_number", F.length("s.content").alias("content_length_chars"), "processed_at")


def entities(raw: DataFrame, labels: Sequence[str] = ENTITY_LABELS) -> DataFrame:
    """One row per kept entity."""
    rows = raw.where("entities_json IS NOT NULL").select(F.coalesce("document_version_id", "file_id").alias("document_version_id"), "file_id", "section_idx", F.coalesce("model_name", "nlp_policy_id").alias("model_name"), F.posexplode(F.from_json("entities_json", ENTITIES)).alias("pos", "e"))
    return rows.where(F.col("e.label").isin(*labels)).select(hash_id("document_version_id", "section_idx", "pos", "e.label").alias("entity_id"), "document_version_id", "file_id", "section_idx", F.col("e.text").alias("entity_text"), F.col("e.label").alias("entity_label"), "e.start_char", "e.end_char", "e.confidence", "model_name")


def relations(raw: DataFrame, kinds: Sequence[str] = RELATION_TYPES) -> DataFrame:
    """One row per kept relation."""
    rows = raw.where("relations_json IS NOT NULL").select(F.coalesce("document_version_id", "file_id").alias("document_version_id"), "section_idx", F.coalesce("nlp_policy_id", "model_name").alias("nlp_policy_id"), F.posexplode(F.from_json("relations_json", RELATIONS)).alias("pos", "r"))
    return rows.where(F.col("r.relation").isin(*kinds)).select(hash_id("document_version_id", "section_idx", "pos").alias("relation_id"), "document_version_id", "section_idx", "r.head_text", "r.head_idx", "r.dep_text", "r.dep_idx", F.col("r.relation").alias("relation_type"), "nlp_policy_id")


def control(staged_events: DataFrame, done: Sequence[str] = DONE) -> DataFrame:
    """The status of each version from its whole history (V13; D7, D9)."""
    stage = staged_events.groupBy("document_version_id").agg(F.max_by("stage", F.struct("event_timestamp", "attempt_number", "event_id")).alias("current_stage"))
    return classified(staged_events, "document_version_id", "event_timestamp", "event_type", "event_id", done=done, attempt="attempt_number").withColumnRenamed("control_status", "status").join(stage, "document_version_id")


def _in_order(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("section_idx", column))), lambda x: x[column])


def chunk_rows(section_rows: DataFrame, metadata: DataFrame | None = None, tokens: int = 512, overlap: int = 64, lossless: bool = True) -> DataFrame:
    """Texts ready to embed."""
    rows = section_rows
    if metadata is not None:
        rows = rows.join(metadata.select("file_id", F.from_json("metadata_json", "map<string,string>").alias("meta")), "file_id", "left")
    cut = chunks(rows, "section_content", tokens, overlap, lossless)
    return cut.withColumn("chunk_id", hash_id("document_version_id", "section_idx", "chunk_idx")).withColumn("chunk_length_chars", F.length("chunk_text")).drop("section_content", "content_length_chars", "heading_level")


def _section_stats(section_rows: DataFrame, *keys: str) -> DataFrame:
    return section_rows.groupBy(*keys).agg(F.count("*").alias("section_count"), F.sum("content_length_chars").alias("total_chars"), F.max("page_number").alias("page_count"), F.array_join(_in_order("section_content"), " ").alias("search_text"), F.filter(_in_order("section_heading"), lambda h: h.isNotNull()).alias("headings"))


def search_documents(ids: DataFrame, status: DataFrame, staged: DataFrame, parsed: DataFrame, section_rows: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """The serving table of documents: processed versions with their text, entities and whether they are current."""
    newest = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("retrieved_at"), F.desc("document_version_id"))) == 1  # D12
    current = ids.withColumn("is_current_version", newest).select("document_id", "document_version_id", "ingestion_id", "is_current_version")
    found = entity_rows.groupBy("document_version_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("entity_label") == "ORG", F.col("entity_text")))).alias("orgs"),
        F.array_sort(F.collect_set(F.when(F.col("entity_label").isin("DATE", "LAW"), F.col("entity_text")))).alias("legal_refs"),
        F.count("*").alias("entity_count"),
    )
    env = staged.select("ingestion_id", "source_system", "source_uri", "source_document_id", F.col("title").alias("env_title"), "language", "country", "jurisdiction", "document_class", "authority_name", "authority_type", "court_name", "court_level", F.col("retrieved_at").alias("publication_date"))
    heads = parsed.select("document_version_id", "policy_set_id", "title", "document_type").dropDuplicates(["document_version_id"])
    out = current.join(status.where("status = 'done'").select("document_version_id"), "document_version_id").join(env, "ingestion_id").join(heads, "document_version_id", "left")
    out = out.join(_section_stats(section_rows, "document_version_id"), "document_version_id", "left").join(found, "document_version_id", "left")
    return out.withColumn("title", F.coalesce("title", "env_title")).drop("env_title", "ingestion_id")


def search_chunks(chunk_table: DataFrame, documents: DataFrame, section_rows: DataFrame) -> DataFrame:
    """The serving table of chunks: those of current versions, with their heading."""
    docs = documents.where("is_current_version").select("document_version_id", "document_id", "source_system", F.col("title").alias("doc_title"), "language", "country", "jurisdiction", "document_class", "authority_name", "is_current_version")
    levels = section_rows.select("document_version_id", "section_idx", "heading_level")
    return chunk_table.join(docs, "document_version_id").join(levels, ["document_version_id", "section_idx"], "left").withColumn("document_title", F.col("doc_title")).withColumnRenamed("file_id", "ingestion_id").drop("doc_title", "meta")


def knowledge_base(parsed: DataFrame, raw_documents: DataFrame, raw_metadata: DataFrame, section_rows: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """One row per version with metadata, sections and entities."""
    meta = raw_documents.select("file_id", "source_url", "mime_type", "ingested_at").join(raw_metadata.select("file_id", F.from_json("metadata_json", "map<string,string>").alias("scraped_meta")), "file_id", "left")
    keys = ["document_version_id", "file_id"]
    found = entity_rows.groupBy(*keys).agg(F.count("*").alias("entity_count"), F.count_distinct("entity_label").alias("unique_label_count"), F.array_sort(F.collect_set("entity_text")).alias("unique_entities"))
    stats = _section_stats(section_rows, *keys).withColumnRenamed("total_chars", "total_content_chars").drop("search_text")
    docs = parsed.select(*keys, F.col("title").alias("document_title"), "document_type", F.col("metadata").alias("docling_metadata"), F.col("schema_version").alias("docling_schema_version"), F.col("processed_at").alias("docling_processed_at"))
    return docs.join(meta, "file_id", "left").join(stats, keys, "left").join(found, keys, "left")


def dim_document(ids: DataFrame, history: DataFrame) -> DataFrame:
    """Documents with validity windows and a surrogate key (M4, J7); attributes are the newest version's."""
    newest = ids.withColumn("__rn", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("retrieved_at"), F.desc("document_version_id")))).where("__rn = 1")
    attributes = newest.select("document_id", "document_version_id", "source_system", "country", "jurisdiction", "document_class", "language")
    return history.join(attributes, "document_id", "left").withColumn("document_sk", hash_id("document_id", "valid_from")).withColumn("is_current", F.col("valid_to").isNull())


def fact(manifest_rows: DataFrame, published: DataFrame, ids: DataFrame, staged: DataFrame, entity_rows: DataFrame, relation_rows: DataFrame, chunk_table: DataFrame, staged_events: DataFrame, dim: DataFrame, dim_source: DataFrame, dim_jurisdiction: DataFrame) -> DataFrame:
    """One row per processing manifest (V14, J6, J8, M6); ``ids`` and manifests share one id scheme.

    Every joined side has one row per key; small dimensions are broadcast by Spark where their size allows.
    """
    per = lambda df, name: df.groupBy("document_version_id").agg(F.count("*").alias(name))
    w = Window.partitionBy("document_id").orderBy(F.desc("retrieved_at"), F.desc("document_version_id"))
    versions = ids.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("document_id", "document_version_id", "ingestion_id")
    seen = staged_events.groupBy("document_version_id").agg(F.count("*").alias("event_count"), F.max("attempt_number").alias("max_attempt_number"), F.min("event_timestamp").alias("first_event_at"), F.max("event_timestamp").alias("last_event_at"))
    replaced = manifest_rows.where("supersedes_processing_manifest_id IS NOT NULL").select(F.col("supersedes_processing_manifest_id").alias("processing_manifest_id"), F.lit(True).alias("is_superseded")).distinct()
    env = staged.select("ingestion_id", "source_system", "country", "jurisdiction", "document_class", "authority_name", "language").dropDuplicates(["ingestion_id"])
    out = manifest_rows.drop("provenance", "failure", "quarantine")
    out = out.join(published.select("processing_manifest_id", "lifecycle_status", "document_type", "title", "processed_at").dropDuplicates(["processing_manifest_id"]), "processing_manifest_id", "left")
    out = out.join(versions, "document_id", "left").join(env, "ingestion_id", "left")
    for side in (per(entity_rows, "entities_count"), per(relation_rows, "relations_count"), per(chunk_table, "chunk_count"), seen):
        out = out.join(side, "document_version_id", "left")
    out = out.join(replaced, "processing_manifest_id", "left").join(dim.where("is_current").select("document_id", "document_sk"), "document_id", "left")
    out = out.join(dim_source.select(F.col("source_system_code"), F.col("source_system_code").alias("source_system")), "source_system", "left").join(dim_jurisdiction.select(F.col("jurisdiction_code"), F.col("jurisdiction_code").alias("jurisdiction")), "jurisdiction", "left")
    return out.fillna({"source_system_code": "unknown", "jurisdiction_code": "UNKNOWN", "is_superseded": False, "entities_count": 0, "relations_count": 0, "chunk_count": 0, "event_count": 0}).withColumns(
        {"is_success": F.col("status") == "canonical_ready", "has_failure": F.col("failure_type").isNotNull(), "total_latency_s": (F.unix_timestamp("last_event_at") - F.unix_timestamp("first_event_at")).cast("double")}
    )


def analytics(ids: DataFrame, manifest_rows: DataFrame, staged_events: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Four sets of metrics, each row packed as JSON."""
    w = Window.partitionBy("document_version_id").orderBy("event_timestamp", "event_id")
    timed = staged_events.withColumn("s", F.unix_timestamp(F.lead("event_timestamp").over(w)) - F.unix_timestamp("event_timestamp"))
    sets = {
        "ingestion_by_day": ids.groupBy("source_system", "country", "jurisdiction", "document_class", F.to_date("retrieved_at").alias("day")).agg(F.count("*").alias("versions"), F.count_distinct("document_id").alias("documents")),
        "processing_outcomes": manifest_rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("failure_type").isNotNull()).alias("failed")),
        "stage_latency": timed.groupBy("stage").agg(F.avg("s").alias("avg_seconds"), F.sum(F.when(F.col("event_type") == "failed", 1).otherwise(0)).alias("failures")),
        "content": section_rows.groupBy("document_type").agg(F.count("*").alias("sections"), F.avg("content_length_chars").alias("avg_chars")),
    }
    parts = [d.select(F.lit(n).alias("metric_set"), F.to_json(F.struct("*")).alias("payload")) for n, d in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
