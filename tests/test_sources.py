"""Schemas, stores, the marts plan and streams."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from quillon.plans import marts
from quillon.sources import schemas, stores
from quillon.streaming import projection


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def bronze(spark, name, *rows):
    names = schemas.BRONZE[name].fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.BRONZE[name])


def test_surfaces_parse_and_conform(spark):
    for name in schemas._SURFACES:
        assert schemas.surface(name).fields
    df = schemas.conform(spark.createDataFrame([("d1", "3")], "document_id string, document_revision string"), schemas.surface("published_documents"))
    assert df.first().document_revision == 3 and df.columns == schemas.surface("published_documents").fieldNames()
    assert "USING parquet" in schemas.ddl("t", schemas.BRONZE["raw_metadata"])
    assert schemas.contract("t", schemas.BRONZE["raw_metadata"])["tests"][0]["column_set"][0] == "document_version_id"


def test_projection_drops_empty_conditionals_and_refuses_key_loss(spark):
    schema = schemas.surface("processing_manifests")
    bare = spark.createDataFrame([("m1",)], "processing_manifest_id string")
    assert not {"failure", "quarantine"} & set(stores.projected(bare, schema).columns)
    failed = bare.withColumn("failure", F.struct(F.lit("t").alias("failure_type"), F.lit("m").alias("message")))
    assert "failure" in stores.projected(failed, schema).columns
    with pytest.raises(stores.KeyLoss):
        stores.projected(bare.withColumn("failure", F.struct(F.lit("t").alias("unheard_of"))), schema)


def test_append_read_latest(spark, tmp_path):
    path, schema = str(tmp_path / "docs"), "document_id string, document_revision int, processing_manifest_id string, processed_at timestamp, full_text string"
    at = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    assert stores.surface_or_empty(spark, path, spark.createDataFrame([], schema).schema).count() == 0
    for d, (i, r) in enumerate([("a", 1), ("a", 2), ("b", 1)], 1):
        stores.append(spark.createDataFrame([(i, r, f"m{d}", None, f"text {d}")], schema).withColumn("processed_at", at(d)), path)
    stores.append(spark.createDataFrame([], schema), path)
    docs = stores.surface_or_empty(spark, path, spark.createDataFrame([], schema).schema)
    assert [tuple(r) for r in stores.latest_documents(docs, ["document_id", "document_revision"]).collect()] == [("a", 2), ("b", 1)]
    assert values(stores.latest_documents(docs, ["document_id"], after="a"), "document_id") == [("b",)]
    assert stores.document(docs, "a").first().full_text == "text 2" and stores.document(docs, "a", revision=1).first().full_text == "text 1"
    plan = stores.latest_documents(docs, ["document_id"])._jdf.queryExecution().executedPlan().toString()
    assert "full_text" not in plan.split("ReadSchema")[-1]
    with pytest.raises(Exception, match="CANNOT_READ|FAILED_READ|not a Parquet|Could not read"):
        (tmp_path / "docs" / "part-bad.parquet").write_text("junk")
        stores.surface_or_empty(spark, path, spark.createDataFrame([], schema).schema).count()


def test_versioned_table(spark, tmp_path):
    t = stores.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.write(spark.createDataFrame([(1,)], "k int"))
    t.write(t.read().union(spark.createDataFrame([(2,)], "k int")))
    (tmp_path / "t" / "v=000000009").mkdir()
    assert values(t.read(), "k") == [(1,), (2,)]


def test_bundles(spark, tmp_path):
    a = spark.createDataFrame([("b1", "a2", "other", "text/html"), ("b1", "a1", "primary_document", "text/plain"), ("b2", "a3", "x", "application/pdf"), ("b2", "a4", "y", "text/xml; charset=u"), ("b3", "a5", "x", "image/png")], "bundle_id string, artifact_id string, role string, content_type string")
    assert values(stores.primary_artifact(a), "bundle_id", "artifact_id") == [("b1", "a1"), ("b2", "a4")]
    assert values(stores.primary_artifact(a, ["x"]), "artifact_id") == [("a1",), ("a3",), ("a5",)]
    (tmp_path / "f.html").write_bytes(b"<p>")
    files = stores.binary_files(spark, str(tmp_path), "*.html")
    assert stores.verified(files, F.sha2(F.lit(b"<p>"), 256)).first().intact and not stores.verified(files, F.lit("x")).first().intact
    wrapped = json.dumps({"body_base64": base64.b64encode(b"body").decode()}).encode()
    df = spark.createDataFrame([(wrapped,), (b"plain",)], "c binary").select(stores.unwrapped(F.col("c")).alias("b"))
    assert sorted(bytes(r.b) for r in df.collect()) == [b"body", b"plain"]


def test_event_lines(spark, tmp_path):
    lines = ['{"name": "a", "timestamp": "2024-01-01T00:00:00Z", "sessionId": "s"}', '{"name": "b"}', '{"timestamp": "2024-01-01"}', '{"name": "c", "timestamp": "soon"}', "{broken", ""]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    good, bad = stores.analytics_events(spark, str(tmp_path))
    assert values(good, "name") == [("a",), ("b",)]
    assert values(bad, "problem", "n") == [("bad_timestamp", 1), ("malformed", 1), ("no_name", 1)]


def test_sparql_bindings(spark):
    body = json.dumps({"results": {"bindings": [{"x": {"type": "uri", "value": "u"}}, {"x": {"type": "uri", "value": "v"}, "l": {"type": "literal", "value": "z"}}]}})
    assert values(stores.sparql_rows(spark.createDataFrame([(body,)], "b string"), "b", ["x", "l"]), "x", "l") == [("u", None), ("v", "z")]


@pytest.fixture(scope="module")
def built(spark):
    envelope = {"artifact_type": "document_candidate", "http_status": "200", "source_system": "fedlex", "language": "de", "authority_name": "Bund"}
    env = marts.landing(bronze(spark, "landing_envelopes",
        envelope | {"ingestion_id": "i1", "source_uri": "u1", "source_document_id": "s1", "checksum": "c1", "retrieved_at": "2024-01-01 00:00:00", "title": "Env"},
        envelope | {"ingestion_id": "i2", "source_uri": "u1", "source_document_id": "s1", "checksum": "c2", "retrieved_at": "2024-01-02 00:00:00", "country": "CH"},
        envelope | {"ingestion_id": "i3", "source_uri": "u2", "checksum": "c3", "retrieved_at": "2024-01-03 00:00:00"},
        envelope | {"ingestion_id": "i4", "http_status": "404"}, envelope | {"ingestion_id": "i5", "http_status": "teapot"},
    ))
    ids = marts.identity(env)
    version = {r.ingestion_id: r.document_version_id for r in ids.collect()}
    doc = lambda *parts: json.dumps({"title": "T", "document_type": "law", "sections": [{"heading": h, "level": 1, "content": c, "page_number": i} for i, (h, c) in enumerate(parts)]})
    parsed = marts.docling(bronze(spark, "raw_docling_output", {"document_version_id": version["i1"], "file_id": "i1", "processed_at": "2024-01-01", "docling_json": doc(("A", "x" * 60), ("B", " "))}, {"document_version_id": version["i2"], "file_id": "i2", "processed_at": "2024-01-02", "docling_json": doc(("A", "y" * 5000), ("C", "z" * 80))}))
    sections = marts.sections(parsed)
    nlp = bronze(spark, "raw_nlp_annotations", {"document_version_id": version["i2"], "file_id": "i2", "section_idx": "0", "entities_json": json.dumps([{"text": "Bund", "label": "ORG"}, {"text": "Art. 1", "label": "LAW"}, {"text": "?", "label": "X"}]), "relations_json": json.dumps([{"head_text": "a", "relation": "nsubj"}, {"head_text": "b", "relation": "zzz"}])})
    events = marts.events(bronze(spark, "document_processing_events", *[{"event_id": f"e{i}", "document_version_id": version[v], "stage": s, "event_type": t, "attempt_number": "1", "event_timestamp": f"2024-01-01 00:00:{i:02d}"} for i, (v, s, t) in enumerate([("i1", "parse", "started"), ("i1", "publish", "completed"), ("i2", "parse", "started"), ("i2", "publish", "succeeded"), ("i3", "parse", "started")])]))
    return {"env": env, "ids": ids, "version": version, "parsed": parsed, "sections": sections, "entities": marts.entities(nlp), "relations": marts.relations(nlp), "events": events, "chunks": marts.chunk_rows(sections)}


def test_identity(spark, built):
    ids = {r.ingestion_id: r for r in built["ids"].collect()}
    assert set(ids) == {"i1", "i2", "i3"} and ids["i1"].document_id == ids["i2"].document_id != ids["i3"].document_id
    assert ids["i1"].country == "UNKNOWN" and ids["i2"].country == "CH"
    later = marts.identity(built["env"], built["ids"].where("ingestion_id = 'i1'"))
    assert values(later, "ingestion_id", "is_new_version") == [("i1", False), ("i2", True), ("i3", True)]


def test_serving_marts(spark, built):
    docs = marts.search_documents(built["ids"], marts.control(built["events"]), built["env"], built["parsed"], built["sections"], built["entities"])
    got = {r.document_version_id: r for r in docs.collect()}
    v = built["version"]
    assert set(got) == {v["i1"], v["i2"]} and [got[v[i]].is_current_version for i in ("i1", "i2")] == [False, True]
    assert got[v["i2"]].headings == ["A", "C"] and got[v["i2"]].orgs == ["Bund"] and got[v["i2"]].legal_refs == ["Art. 1"] and got[v["i2"]].section_count == 2
    chunks = marts.search_chunks(built["chunks"], docs, built["sections"])
    assert {r.document_version_id for r in chunks.collect()} == {v["i2"]} and chunks.count() == 4
    raw = bronze(spark, "raw_documents", {"file_id": "i2", "source_url": "u"})
    kb = marts.knowledge_base(built["parsed"], raw, bronze(spark, "raw_metadata"), built["sections"], built["entities"])
    assert values(kb, "file_id", "section_count", "entity_count", "source_url") == [("i1", 1, None, None), ("i2", 2, 2, "u")]


def test_fact(spark, built):
    document_id = built["ids"].where("ingestion_id = 'i1'").first().document_id
    schema = schemas.surface("processing_manifests")
    m = marts.manifests(schemas.conform(spark.createDataFrame([("m1", document_id, "failed", None), ("m2", document_id, "canonical_ready", "m1")], "processing_manifest_id string, document_id string, status string, supersedes_processing_manifest_id string").withColumn("failure", F.when(F.col("status") == "failed", F.struct(F.lit("parse").alias("failure_type"), F.lit("bad").alias("message")))), schema))
    history = spark.createDataFrame([(document_id, "active")], "document_id string, lifecycle_status string").withColumn("valid_from", F.lit("2024-01-01").cast("timestamp")).withColumn("valid_to", F.lit(None).cast("timestamp"))
    dim = marts.dim_document(built["ids"], history)
    published = schemas.conform(spark.createDataFrame([("m2", "active")], "processing_manifest_id string, lifecycle_status string"), schemas.surface("published_documents"))
    f = marts.fact(m, published, built["ids"], built["env"], built["entities"], built["relations"], built["chunks"], built["events"], dim, spark.createDataFrame([("fedlex",)], "source_system_code string"), spark.createDataFrame([("ZH",)], "jurisdiction_code string"))
    got = values(f, "processing_manifest_id", "is_success", "is_superseded", "has_failure", "source_system_code", "jurisdiction_code", "entities_count", "relations_count", "chunk_count", "event_count", "total_latency_s")
    assert got == [("m1", False, True, True, "fedlex", "UNKNOWN", 2, 1, 4, 2, 1.0), ("m2", True, False, False, "fedlex", "UNKNOWN", 2, 1, 4, 2, 1.0)]
    assert f.where("document_sk IS NULL").count() == 0
    sets = marts.analytics(built["ids"], m, built["events"], built["sections"]).groupBy("metric_set").count()
    assert {r.metric_set for r in sets.collect()} == {"ingestion_by_day", "processing_outcomes", "stage_latency", "content"}


def test_outcomes_and_routes(spark):
    e = spark.createDataFrame([("e1", "k", 1, 1), ("e2", "k", 3, 2), ("e3", "k", 2, 3), ("e2", "k", 3, 4), ("e4", "k", 3, 5), ("e5", "j", 1, 6)], "id string, k string, r int, a int")
    assert values(projection.outcomes(e, "id", "k", "r", "a"), "a", "outcome") == [(1, "applied"), (2, "applied"), (3, "stale"), (4, "ignored_duplicate"), (5, "applied"), (6, "applied")]
    m = spark.createDataFrame([("ok", False, 1), ("quarantined", False, 1), ("bad", False, 1), ("bad", True, 1), ("bad", True, 5)], "s string, t boolean, d int")
    assert [r.x for r in m.select(projection.route(F.col("s"), F.col("t"), F.col("d"), 5).alias("x")).collect()] == ["processed", "quarantined", "rejected_permanent", "transient_retry", "dead_lettered"]
    s = spark.createDataFrame([("u", 1, "accepted"), ("u", 2, "processing"), ("u", 3, "quarantined"), ("v", 1, "accepted")], "u string, o int, k string")
    assert values(projection.status_sequence(s, "u", "o", "k"), "u", "complete") == [("u", True), ("v", False)]


def test_stream_applies_events_once_and_in_order_of_revision(spark, tmp_path):
    drop, table = tmp_path / "drop", stores.VersionedTable(spark, str(tmp_path / "table"))
    drop.mkdir()
    schema = spark.createDataFrame([], "event_id string, k string, revision long, kind string").schema
    put = lambda name, *rows: (drop / name).write_text("\n".join(json.dumps(dict(zip(schema.fieldNames(), r, strict=True))) for r in rows))

    def drain():
        stream = projection.deduplicated(projection.read_drop(spark, schema, str(drop)).select(*schema.fieldNames()), "event_id")
        projection.apply_batches(stream, str(tmp_path / "state"), projection.apply_to_table(table.read, table.write, "k", "revision")).awaitTermination()

    put("1.json", ("e1", "a", 1, "x"), ("e2", "a", 3, "y"), ("e3", "b", 1, "x"))
    drain()
    put("2.json", ("e4", "a", 2, "stale"), ("e2", "a", 3, "again"), ("e5", "b", 1, "same"))
    drain()
    assert values(table.read(), "k", "revision", "kind") == [("a", 3, "y"), ("b", 1, "same")]


def test_stateful_guard(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for i, r in enumerate([1, 3, 2, 3]):
        (drop / f"{i}.json").write_text(json.dumps({"k": "a", "r": r}))
    stream = spark.readStream.schema("k string, r long").option("maxFilesPerTrigger", 1).json(str(drop))
    q = projection.guarded(stream, "k", "r").writeStream.format("memory").queryName("guarded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r.outcome for r in spark.table("guarded").where("r = 2").collect()]
    assert got == ["stale"] and spark.table("guarded").count() == 4
