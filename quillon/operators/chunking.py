"""Cutting texts into overlapping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def token_chars(tokens: int) -> int:
    """Characters that so many tokens take, at four each."""
    return tokens * 4


def chunks(df: DataFrame, text: str, tokens: int = 512, overlap: int = 64, lossless: bool = True, least: int = 50) -> DataFrame:
    """One row per window, ``chunk_idx`` and ``chunk_text``; windows of at most ``least`` trimmed characters are dropped.

    ``lossless`` covers every character; otherwise starts and counts are as the reference has them, which loses tails
    of long texts (its first window counts from 0, and the number of windows ignores the overlap).
    """
    width, stride = token_chars(tokens), token_chars(tokens - overlap)
    n = F.length(text)
    if lossless:
        last, start = F.greatest(F.lit(0), F.ceil((n - width) / F.lit(stride))), F.col("chunk_idx") * stride + 1
        piece = F.substring(F.col(text), start, F.lit(width))
    else:
        # A start of 0 counts as 1, so the first two windows share one character more than others do.
        last, start = F.greatest(F.lit(0), F.ceil(n / F.lit(width)) - 1), F.col("chunk_idx") * stride
        piece = F.when(F.col("chunk_idx") == 0, F.substring(F.col(text), F.lit(1), F.lit(width))).otherwise(F.substring(F.col(text), start, F.lit(width)))
    out = df.where(F.col(text).isNotNull()).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return out.withColumn("chunk_text", piece).where(F.length(F.trim("chunk_text")) > least)


def windows(df: DataFrame, text: str, width: int = 6000, overlap: int = 400) -> DataFrame:
    """Windows of a stripped text, each ``overlap`` before the last one's end; a last one no longer than the overlap is dropped."""
    if not 0 <= overlap < width:
        raise ValueError("the overlap must be shorter than the window")
    step = width - overlap
    stripped = df.withColumn("__t", F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")).where("__t <> ''")
    n = F.length("__t")
    last = F.when(n <= width, F.lit(0)).otherwise(F.floor((n - 1) / F.lit(step)))
    last = F.when((last > 0) & (n - last * step <= overlap), last - 1).otherwise(last)
    out = stripped.withColumn("window_idx", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return out.withColumn("window_text", F.substring(F.col("__t"), F.col("window_idx") * step + 1, F.lit(width))).drop("__t")


def passages(df: DataFrame, text: str, most: int = 900) -> DataFrame:
    """Paragraphs between blank lines; a text of one paragraph longer than ``most`` is cut after sentences."""
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    sentences = F.filter(F.transform(F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), r"(?<=[.!?]) "), lambda x: F.trim(x)), lambda p: p != "")
    cut = df.withColumn("__p", paragraphs)
    return cut.select(*df.columns, F.posexplode(F.when((F.size("__p") == 1) & (F.length(F.col("__p")[0]) > most), sentences).otherwise(F.col("__p"))).alias("passage_idx", "passage"))
