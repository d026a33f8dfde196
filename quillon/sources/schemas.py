"""Declared schemas: bronze landing tables, published surfaces, seeds and JSON payloads (section 1.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

# Columns of the tables.
_BRONZE = {
    "landing_envelopes": "ingestion_id crawl_run_id source_system source_uri retrieved_at content_type raw_object_uri checksum http_status artifact_type title language source_document_id country jurisdiction document_class authority_name authority_type court_name court_level parent_uri discovery_depth source_metadata envelope_schema_version adapter_version",
    "document_processing_events": "event_id document_version_id ingestion_id stage event_type attempt_number event_timestamp error_type error_message artifact_uri event_metadata",
    "raw_docling_output": "document_version_id file_id processed_at policy_set_id docling_json",
    "raw_nlp_annotations": "document_version_id file_id section_idx model_name nlp_policy_id processed_at entities_json relations_json",
    "raw_metadata": "document_version_id file_id source metadata_json processed_at",
    "raw_documents": "document_version_id file_id source_url mime_type payload content_type",
}
_PROVENANCE = "provenance STRUCT<source_id STRING, run_id STRING, artifact_id STRING, captured_at TIMESTAMP>"
_SURFACES = {
    "published_documents": f"document_id STRING, document_revision INT, processing_manifest_id STRING, {_PROVENANCE}, primary_artifact_id STRING, jurisdiction_id STRING, authority_id STRING, title STRING, document_type STRING, effective_date DATE, processed_at TIMESTAMP, processing_version STRING, lifecycle_status STRING, full_text STRING, body_text STRING, metadata MAP<STRING, STRING>, extensions MAP<STRING, STRING>",
    "published_sections": f"section_id STRING, document_id STRING, document_revision INT, processing_manifest_id STRING, {_PROVENANCE}, parent_section_id STRING, ordinal INT, depth INT, title STRING, content STRING, section_type STRING, metadata MAP<STRING, STRING>",
    "processing_manifests": f"processing_manifest_id STRING, manifest_version INT, document_id STRING, document_revision INT, processing_version STRING, status STRING, {_PROVENANCE}, input_bundle_manifest_ref STRUCT<manifest_id STRING, manifest_version INT>, selected_profiles MAP<STRING, STRING>, reference_snapshot_set_ref STRING, published_document_ref STRUCT<record_key STRING>, published_sections_ref STRUCT<record_filter STRING>, canonical_ready_at TIMESTAMP, supersedes_processing_manifest_id STRING, document_count INT, section_count INT, citation_count INT, failure STRUCT<failure_type STRING, message STRING>, quarantine STRUCT<reason STRING, detail STRING, extracted_chars INT, min_extracted_chars INT, legal_marker_count INT, min_legal_markers INT>",
    "published_commentary_insights": "insight_id STRING, document_id STRING, document_revision BIGINT, processing_manifest_id STRING, section_id STRING, citation_id STRING, insight_type STRING, claim STRING, display_text STRING, support ARRAY<STRUCT<passage STRING, attributes MAP<STRING, STRING>>>, referenced_authorities ARRAY<STRUCT<type STRING, key STRING>>, language STRING, jurisdiction_id STRING, confidence DOUBLE, review_state STRING, generator STRUCT<name STRING, version STRING>, scores STRUCT<confidence DOUBLE>, metadata MAP<STRING, STRING>",
    "canonical_retractions": "retraction_id STRING, document_id STRING, retracted_revisions ARRAY<INT>, reason_code STRING, reason STRING, superseded_by_document_id STRING, retracted_by STRING, retracted_at TIMESTAMP, surfaces ARRAY<STRUCT<surface STRING, rows INT>>",
}
DOCLING = "STRUCT<title: STRING, document_type: STRING, source_uri: STRING, sections: ARRAY<STRUCT<heading: STRING, level: INT, content: STRING, page_number: INT>>, tables: ARRAY<STRING>, metadata: MAP<STRING, STRING>, schema_version: STRING>"
ENTITIES = "ARRAY<STRUCT<text: STRING, label: STRING, start_char: INT, end_char: INT, confidence: DOUBLE>>"
RELATIONS = "ARRAY<STRUCT<head_text: STRING, head_idx: INT, dep_text: STRING, dep_idx: INT, relation: STRING>>"
#: Columns that appear only when a batch has a value for them.
CONDITIONAL = ("extensions", "failure", "quarantine")

BRONZE = {t: StructType([*[StructField(c, StringType()) for c in columns.split()], StructField("ingested_at", TimestampType()), StructField("_source_file", StringType())]) for t, columns in _BRONZE.items()}


def surface(name: str) -> StructType:
    """The schema of a published surface."""
    return StructType.fromDDL(_SURFACES[name])


def bronze(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A bronze table under its declared schema, never an inferred one."""
    return spark.read.schema(BRONZE[name]).format(fmt).load(path)


def seed(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A seed CSV with a header."""
    return spark.read.schema(ddl).option("header", True).csv(path)


def ddl(name: str, schema: StructType, location: str | None = None) -> str:
    """The statement that registers a table."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" LOCATION '{location}'" if location else "")


def contract(name: str, schema: StructType) -> dict:
    """A source contract with its column set, as a plain dictionary to write as YAML or JSON."""
    return {"name": name, "columns": [{"name": f.name, "data_type": f.dataType.simpleString()} for f in schema.fields], "tests": [{"column_set": [f.name for f in schema.fields]}]}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns in order, cast; missing ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
