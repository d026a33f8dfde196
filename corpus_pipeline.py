"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept and returns documents with the same columns, the last one
packed pieces. The driver of a run may write each stage's result as Parquet and read it again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.columns import column, identified, small_batches
from quillon.llm.components import ensure_checkpoint_dir
from quillon.llm.decontamination import contamination
from quillon.llm.language_id import identify, learn_profiles
from quillon.llm.near_dedup import similar_documents
from quillon.llm.packing import pack
from quillon.llm.substring_dedup import remove_repeated_spans


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: those whose text is null or has no letter, or, where languages were learned, is in none."""
    small_batches(spark)
    profiles = learn_profiles(docs.select("doc_id", "text", "lang"))
    if not profiles.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(docs, profiles).where("lang_pred <> 'und'").select(*docs.columns)


def _as_before(df: DataFrame, made: Column, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, made ids null again."""
    own = F.when(~made, F.col("doc_id")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return df.select(*[own if c == "doc_id" else column(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents of similar shingle sets the one with the least id stays; rows that share an id are one document.

    A row without an id is a document of its own that gives way to any with an id, and to one whose hash of all columns
    is less; of equal rows without an id one stays.
    """
    small_batches(spark)
    ids, made = identified(docs)
    stay = similar_documents(ids.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    return _as_before(ids.join(stay, "doc_id", "left_semi"), made, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages from all but the first document that has them; documents stay, perhaps with empty text.

    Rows without an id come after all others, by a hash of all columns; of equal ones the first keeps its passages.
    """
    small_batches(spark)
    ids, made = identified(docs)
    out = remove_repeated_spans(ids, normalise=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _as_before(out, made, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of every document into sequences of 4096."""
    import public_tokenizers

    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(f.__name__, f) for f in (language_id, simhash_near_dedup, substring_dedup, benchmark_decontamination, packing)]

#: The stages that learn, hash and tokenize have no SQL; the tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what a stage kept is checkpointed for the next."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
