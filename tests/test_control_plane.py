"""The ledger, its queue, previews and retention on a small control plane."""

import pytest
from pyspark.sql import functions as F

from quillon.plans import control_plane as C


@pytest.fixture(scope="module")
def plane(spark):
    f = spark.createDataFrame
    return {
        "jurisdictions": f([("zh", "Zürich", "cantonal", "p1"), ("be", "Bern", "cantonal", "p1"), ("ag", "Aargau", "cantonal", None)], "jurisdiction_id string, name string, level string, compliance_policy_id string"),
        "sources": f([("s1", "zh", "ZH"), ("s2", "be", "BE")], "source_id string, jurisdiction_id string, name string"),
        "runs": f([("r1", "s1", "v1", "completed", None, 2), ("r2", "s1", "v1", "failed", '{"refused": true}', 1), ("r3", "s2", "v2", "failed", "{}", None)], "run_id string, source_id string, source_version_id string, status string, run_metadata string, started_at int"),
        "versions": f([("v1", "one"), ("v2", "two")], "source_version_id string, version_label string"),
        "captured": f([("c1", "r1", "s1", "u1", "u1", "A decision", "text/html", "h1", "2020-01-01"), ("c2", "r1", "s1", "u1", "u1", None, "application/pdf", "h1", "2024-01-01"), ("c3", "r1", "s1", "u2", "u2", "Impressum contact", None, None, "2020-01-01")], "captured_resource_id string, run_id string, source_id string, source_url string, final_url string, title string, content_type string, checksum string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")),
        "lifecycle": f([("d1", "r1", "document.processed"), ("d1", "r1", "document.processed"), ("d2", "r1", "document.withdrawn"), ("d3", None, "document.processed")], "document_id string, run_id string, event_type string"),
        "statuses": f([("d9", "r1", "quarantined"), ("d9", "r1", "quarantined"), ("d1", "r1", "canonical_ready")], "document_id string, run_id string, status string"),
        "reconciliations": f([("zh", "ATTRIBUTED", 9, "PUBLISHED", False, 1, "r0"), ("zh", "ATTRIBUTED", 5, "PUBLISHED", False, 2, "r1"), (None, "AMBIGUOUS", None, "PUBLISHED", False, 3, "r1")], "jurisdiction_id string, attribution_status string, expected int, denominator_tier string, truncated boolean, as_of int, run_id string"),
    }


def test_ledger_and_queue(spark, plane):
    ledger = C.acquisition_ledger(*[plane[k] for k in ("jurisdictions", "sources", "runs", "captured", "lifecycle", "statuses", "reconciliations")])
    zh = ledger.where("jurisdiction_id = 'zh'").first()
    assert (zh.acquired, zh.acquired_urls, zh.processed, zh.withdrawn, zh.refused, zh.quarantined, zh.expected, zh.acquired_gap, zh.processed_gap, zh.reconciliations) == (3, 2, 1, 1, 1, 1, 5, 3, 4, 2)
    be = ledger.where("jurisdiction_id = 'be'").first()
    assert (be.acquired, be.refused, be.expected, be.denominator_tier, be.acquired_gap) == (0, 0, None, "NONE", None)
    templated = spark.createDataFrame([("ag",)], "jurisdiction_id string")
    queue = [(r.name, r.reasons) for r in C.acquisition_queue(ledger, plane["sources"], templated).collect()]
    assert queue == [("Aargau", ["NO_SOURCE_TEMPLATE_AVAILABLE"]), ("Bern", ["NO_DENOMINATOR", "NEVER_ACQUIRED"]), ("Zürich", ["ACQUISITION_GAP", "PROCESSING_GAP", "REFUSALS_OUTSTANDING"])]


def test_listing_preview_and_retention(spark, plane):
    assert [(r.run_id, r.source_name, r.version_label) for r in C.run_listing(plane["runs"], plane["sources"], plane["versions"]).collect()] == [("r1", "ZH", "one"), ("r2", "ZH", "one"), ("r3", "BE", "two")]
    p = C.run_preview(plane["captured"]).first()
    assert (p.resources, p.pdfs, p.decisions, p.boilerplate, p.checksums, p.duplicates, p["sample"]) == (3, 1, 1, 1, 1, 1, ["u1", "u2"])
    policies = spark.createDataFrame([("p1", 365)], "policy_id string, retention_days int")
    old = C.expired_artifacts(plane["captured"], plane["sources"], plane["jurisdictions"], policies, F.lit("2024-06-01").cast("timestamp"))
    assert sorted(r.captured_resource_id for r in old.collect()) == ["c1", "c3"]
