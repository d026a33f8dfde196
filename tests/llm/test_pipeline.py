"""The registered queries and the pipeline against plain versions."""

import importlib
import os
import subprocess
import sys

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__
from quillon.llm.queries import ORACLE, QUERIES
from tests.conftest import ROOT, SMALL
from tests.llm.test_dedup import contaminated_by_brute_force, similar_plainly, spans_by_brute_force

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_all_numbers_are_registered():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    cursor = con.execute(ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(c[0] for c in cursor.description)
    want = [dict(zip([c[0] for c in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(tuple(r[n] for n in names) for r in want)


def test_every_query_runs_where_workers_lack_the_package(tmp_path):
    """The driver alone finds the package; workers start in another folder and have no path to it."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
from quillon.llm.queries import QUERIES
import corpus_pipeline
def found(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"n": [int(importlib.util.find_spec("quillon") is not None)]}})
assert spark.range(1).mapInArrow(found, "n long").collect()[0].n == 0
for name, f in [*QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
    assert f(spark, {SMALL!r}).count() > 0 or name == "op2_license_scan", name
print("ALL", len(QUERIES) + 1)
"""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and os.path.realpath(p) != os.path.realpath(ROOT)]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": ":".join(paths)} if paths else {})
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert "ALL 14" in out.stdout, out.stderr[-3000:]


def plain_pipeline(rows, items):
    """Ids with the final text, by brute force; languages reject only texts without letters."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    least = similar_plainly(rows)
    rows = [(i, t) for i, t in rows if least[i] == i]
    rows = [(i, t if not gone else kept) for (i, t), (_, kept, _, gone) in zip(rows, spans_by_brute_force(rows, 13), strict=True)]
    clean = contaminated_by_brute_force(rows, items, 10)
    return {i: t for i, t in rows if not clean[i][3]}


def test_pipeline_equals_the_plain_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    short = docs.where("n_chars < 2500 AND doc_id < 150").unionByName(spark.createDataFrame([(1000, None, None, "s", 0), (1001, "12 34 !", "en", "s", 7)], docs.schema))
    short.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [tuple(r) for r in short.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain_pipeline(rows, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tokenizer = importlib.import_module("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got.doc_id) == set(want)
    for i, t in want.items():
        mine = got[got.doc_id == i].sort_values("start")
        assert np.concatenate([np.frombuffer(b, "<u4") for b in mine.ids]).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_near_dedup_stage_treats_rows_without_an_id_like_others(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(80)) for k in "abcd"}
    rows = [(1, text["a"]), (None, text["a"]), (None, text["a"] + " more"), (None, text["b"]), (None, text["b"]), (None, text["c"]), (5, text["d"]), (5, text["d"]), (6, text["d"])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SMALL).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, text["a"]), (None, text["b"]), (None, text["c"]), (5, text["d"]), (5, text["d"])], key=str)


def test_near_dedup_stage_has_a_rule_for_ties_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, lang, "s", i % 3) for i, lang in enumerate(["en", "de", "fr", "en", "de", "fr"])] + [(2**63 - 5, "last id", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = [sorted(stage(spark, docs.repartition(n), SMALL).collect(), key=str) for n in (1, 3, 5)]
    assert len(got[0]) == 2 and got[0] == got[1] == got[2]


def test_substring_stage_cuts_passages_of_rows_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, f"{passage} own a"), (7, passage), (None, f"{passage} own b"), (None, f"{passage} own b"), (None, None), (None, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id int, text string, lang string, `a.b` string, n_chars int").repartition(3)
    got = dict(corpus_pipeline.STAGES)["substring_dedup"](spark, docs, SMALL)
    assert got.schema == docs.schema
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id is not None) == [(7, passage)]
    rest = sorted(r.text or "" for r in got.collect() if r.doc_id is None)
    # Of the two equal rows the first loses what stands in others' texts, the second also what it shares with the first.
    assert rest[0] == "" and rest[-1] == "short" and sum(passage in t for t in rest) == 0 and sum(len(t) for t in rest) < 40


def test_language_stage_without_labels_still_drops_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "ab", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SMALL).collect()] == [1]


def test_decontamination_stage_rejects_rows_without_an_id(spark):
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 80").limit(2).collect()]
    docs = spark.createDataFrame([(None, items[0]), (None, "clean text"), (2, items[1])], "doc_id long, text string")
    assert [r.text for r in dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, SMALL).collect()] == ["clean text"]
