"""Writers and point reads of Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from quillon.sources.schemas import CONDITIONAL, conform


class KeyLoss(ValueError):
    """A write would drop nested keys."""


def nested_keys(kind: DataType, path: str = "") -> set[str]:
    """Dotted names of all struct fields in a type."""
    if isinstance(kind, ArrayType):
        return nested_keys(kind.elementType, path)
    if not isinstance(kind, StructType):
        return set()
    out = set()
    for f in kind.fields:
        name = f"{path}.{f.name}" if path else f.name
        out |= {name} | nested_keys(f.dataType, name)
    return out


def refuse_key_loss(df: DataFrame, schema: StructType) -> None:
    """Raises where the frame has nested keys that the declared columns lack."""
    declared, top = nested_keys(schema), {f.name for f in schema.fields}
    lost = {k for k in nested_keys(df.schema) if "." in k and k.split(".")[0] in top} - declared
    if lost:
        raise KeyLoss(f"keys that would be dropped: {sorted(lost)}")


def projected(df: DataFrame, schema: StructType, conditional: Sequence[str] = CONDITIONAL) -> DataFrame:
    """Declared columns; conditional ones only if some row has a value."""
    refuse_key_loss(df, schema)
    out = conform(df, schema)
    there = [c for c in conditional if c in out.columns]
    if not there:
        return out
    seen = out.agg(*[F.count(c).alias(c) for c in there]).first()
    return out.drop(*[c for c in there if not seen[c]])


def append(df: DataFrame, path: str, schema: StructType | None = None) -> None:
    """Appends rows (S14, S15, S18); an empty frame writes nothing."""
    rows = df if schema is None else projected(df, schema)
    if rows.limit(1).count():
        rows.write.mode("append").parquet(path)


def persist(documents: DataFrame, sections: DataFrame, manifest: DataFrame, root: str) -> None:
    """Documents, then sections, then the manifest, which makes them visible."""
    for name, df in (("published_documents", documents), ("published_sections", sections), ("processing_manifests", manifest)):
        append(df, f"{root}/{name}")


def surface_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A surface that may not be there yet is empty; any other failure is raised."""
    try:
        return conform(spark.read.option("mergeSchema", True).parquet(path), schema)
    except AnalysisException as x:
        if x.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_keyed(df: DataFrame, path: str, key: str, partitions: int | None = None, row_group_bytes: int = 16 << 20) -> None:
    """Writes rows in order of ``key``, with Bloom filters and page indexes over it, so that a read of one key touches one row
    group, whatever the table's size (S5, S7): other files and row groups are ruled out by their bounds, and where keys
    of a range are missing by the filters. A key with very many rows lies in neighbouring row groups of one file."""
    ranged = df.repartitionByRange(key) if partitions is None else df.repartitionByRange(partitions, key)
    options = {"parquet.block.size": row_group_bytes, f"parquet.bloom.filter.enabled#{key}": "true", "parquet.page.row.count.limit": 2000}
    ranged.sortWithinPartitions(key).write.options(**options).parquet(path)


# What readers of the published surfaces rely on.
PUBLISHED = {
    "published_documents": ("document_id", "document_revision", "processing_manifest_id", "processed_at"),
    "published_sections": ("document_id", "document_revision", "processing_manifest_id", "section_id", "ordinal"),
}


def published(spark: SparkSession, root: str, surface: str, schema: StructType) -> DataFrame:
    """A published surface under its contract (S3): it is there, has the columns that its readers rely on, and these are typed as
    declared; anything else is an error, never an empty table."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{root}/{surface}")
    lacking = [c for c in PUBLISHED[surface] if c not in rows.columns]
    if lacking:
        raise KeyLoss(f"{surface} lacks {lacking}")
    declared = {f.name: f.dataType for f in schema.fields}
    wrong = [c for c in PUBLISHED[surface] if c in declared and rows.schema[c].dataType != declared[c]]
    if wrong:
        raise KeyLoss(f"{surface} has other types in {wrong}")
    return conform(rows, schema)


#: The declared columns of commentary insights.
INSIGHTS = "insight_id string, document_id string, passage string, citation_keys array<string>, confidence double, created_at timestamp"


def write_insights(insights: DataFrame, path: str | None) -> int:
    """Appends insights with their declared columns and types (S21) and returns how many; an empty batch writes nothing, a missing target is an error."""
    if not path:
        raise ValueError("no target for insights")
    schema = StructType.fromDDL(INSIGHTS)
    rows = projected(insights, schema, ())
    seen = Observation("insights")
    if rows.isEmpty():
        return 0
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return seen.get["rows"]


def latest_documents(documents: DataFrame, columns: Sequence[str], after: str | None = None) -> DataFrame:
    """The newest row of each document, of these columns only, in order of id (S6, M11); unread columns stay on disk."""
    rows = documents.select("document_id", "document_revision", "processed_at", *[c for c in columns if c not in ("document_id", "document_revision", "processed_at")])
    rows = rows if after is None else rows.where(F.col("document_id") > after)
    newest = rows.groupBy("document_id").agg(F.max_by(F.struct(*rows.columns), F.struct("document_revision", "processed_at")).alias("r"))
    return newest.select("r.*").select(*columns).orderBy("document_id")


def document(documents: DataFrame, document_id: str, revision: int | None = None, manifest: str | None = None) -> DataFrame:
    """One document's newest row under the given predicates, which reach the scan."""
    rows = documents.where(F.col("document_id") == document_id)
    rows = rows if revision is None else rows.where(F.col("document_revision") == revision)
    rows = rows if manifest is None else rows.where(F.col("processing_manifest_id") == manifest)
    return rows.orderBy(F.desc("document_revision"), F.desc("processed_at")).limit(1)


def sections_of(sections: DataFrame, document_id: str, revision: int, manifest: str, most: int | None = None) -> DataFrame:
    """The sections of one processed document, in order (S7), the first ``most`` where a reader asks for so many (R19: 200)."""
    rows = sections.where((F.col("document_id") == document_id) & (F.col("document_revision") == revision) & (F.col("processing_manifest_id") == manifest)).orderBy("ordinal", "section_id")
    return rows if most is None else rows.limit(most)


class VersionedTable:
    """A table whose writes make a new folder; readers see the newest finished one, so a table may be read while its successor is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self, finished: bool = True) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and (not finished or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))))

    def read(self) -> DataFrame | None:
        """The newest finished version, or nothing."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]:09d}") if versions else None

    def write(self, df: DataFrame) -> int:
        """Writes the next version; it counts once its success marker is there."""
        n = (self._versions(finished=False) or [0])[-1] + 1
        df.write.mode("errorifexists").parquet(f"{self.path}/v={n:09d}")  # two writers cannot take one number
        return n


# Content types of a bundle's primary artifact, best first.
PREFERRED_TYPES = ("application/xml", "text/xml", "text/html", "application/xhtml+xml", "application/pdf", "text/plain")


def primary_artifact(artifacts: DataFrame, preferred_roles: Sequence[str] = ()) -> DataFrame:
    """One artifact of each bundle: the primary document, else by preferred role, else by content type."""
    rank = F.when(F.col("role") == "primary_document", F.lit(0))
    for i, role in enumerate(preferred_roles, 1):
        rank = rank.when(F.col("role") == role, F.lit(i))
    for i, kind in enumerate(PREFERRED_TYPES, 1000):
        rank = rank.when(F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1)))) == kind, F.lit(i))
    ranked = artifacts.withColumn("__rank", rank)
    best = ranked.where("__rank IS NOT NULL").groupBy("bundle_id").agg(F.min_by(F.struct(*artifacts.columns), F.struct("__rank", "artifact_id")).alias("a"))
    return best.select("a.*")


def verified(files: DataFrame, checksum: Column) -> DataFrame:
    """Adds ``intact``: do the bytes have the checksum."""
    return files.withColumn("intact", F.coalesce(F.sha2("content", 256) == F.lower(checksum), F.lit(False)))


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as rows, from any file system that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def unwrapped(body: Column) -> Column:
    """The body inside an acquisition envelope, or the bytes themselves."""
    text = body.cast("string")
    inner = F.get_json_object(text, "$.body_base64")
    return F.when(text.startswith("{") & inner.isNotNull(), F.unbase64(inner)).otherwise(body)


def push_message(data: Column, schema: str) -> Column:
    """The JSON inside a base64 push message."""
    return F.from_json(F.unbase64(data).cast("string"), schema)


def analytics_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, counts of what was skipped) of JSON lines: malformed, nameless or badly timed ones; a missing time is kept."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", "name STRING, timestamp STRING, sessionId STRING, correlationId STRING, userId STRING, properties MAP<STRING, STRING>, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).select("e.*")
    ts = F.try_to_timestamp("timestamp")
    problem = F.when(F.col("_bad").isNotNull(), "malformed").when(F.coalesce(F.trim("name"), F.lit("")) == "", "no_name").when(F.col("timestamp").isNotNull() & ts.isNull(), "bad_timestamp")
    marked = parsed.withColumn("ts", ts).withColumn("problem", problem)
    return marked.where("problem IS NULL").drop("problem", "_bad"), marked.where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


def sparql_rows(bindings: DataFrame, column: str, variables: Sequence[str]) -> DataFrame:
    """A result set's JSON bindings as columns."""
    schema = "struct<results:struct<bindings:array<map<string,struct<type:string,value:string>>>>>"
    rows = bindings.select(F.explode(F.from_json(column, schema)["results"]["bindings"]).alias("b"))
    return rows.select(*[F.col("b")[v]["value"].alias(v) for v in variables])


def unreplayed(outbox: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Outbox files without a marker."""
    return outbox.join(markers.select(key).distinct(), key, "left_anti")


def withdrawals(outbox: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Withdrawn events for published documents of which the outbox has nothing any more (S27): one row per document, one revision on."""
    gone = published.join(outbox.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.max("document_revision").alias("document_revision"))
    return gone.select(key, (F.col("document_revision") + 1).alias("document_revision"), F.lit("withdrawn").alias("kind"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON documents, of each ``document_id`` the one of the file that was changed last, by name where times are equal."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__at", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p")))
    return rows.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "__at"]), "__at").alias("d")).select("d.*")
