"""Set operations and generators of rows and names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def union_by_id(frames: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Enumerations put together, each id once: the row of the first frame that has it, then of the least order."""
    marked = [f.withColumn("__i", F.lit(i)) for i, f in enumerate(frames)]
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__i", order)
    return out.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__i")


def first_occurrences(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of equal rows by the keys the first in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def preferred(df: DataFrame, keys: Sequence[str], language: str, wanted: Sequence[str], most: int, tie: str) -> DataFrame:
    """Rows in preferred languages, in that order, each language once, at most ``most``; a key without any keeps what it has (U8)."""
    rank = F.lit(None).cast("int")
    for i, code in reversed(list(enumerate(wanted))):
        rank = F.when(F.col(language) == code, i).otherwise(rank)
    w = Window.partitionBy(*keys)
    marked = df.withColumn("__rank", rank).withColumn("__any", F.count("__rank").over(w) > 0).where(F.col("__rank").isNotNull() | ~F.col("__any"))
    once = marked.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, language).orderBy(tie))).where("__n = 1")
    ranked = once.withColumn("place", F.row_number().over(w.orderBy(F.col("__rank").asc_nulls_last(), language, tie)))
    return ranked.where(F.col("place") <= most).drop("__rank", "__any", "__n")


def overlap_counts(a: Column, b: Column) -> Column:
    """Sizes of intersection and differences of two lists."""
    return F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_except(a, b)).alias("only_first"), F.size(F.array_except(b, a)).alias("only_second"))


def flattened(df: DataFrame, key: str, own: str, parts: str, inner: str) -> DataFrame:
    """A document's own records and those of its parts, as rows with where they come from."""
    top = df.select(key, F.lit(None).cast("int").alias("part"), F.explode(own).alias("record"))
    below = df.select(key, F.posexplode(parts).alias("part", "__p")).select(key, "part", F.explode(F.col("__p")[inner]).alias("record"))
    return top.unionByName(below)


def name_forms(name: Column) -> Column:
    """Ways a place's name may be spelled: without brackets, each side of a slash, without qualifiers, umlauts spelled out, as a slug."""
    plain = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    sides = F.transform(F.split(name, "/"), lambda s: F.trim(F.regexp_replace(s, r"\s*\([^)]*\)", "")))
    short = F.trim(F.regexp_replace(plain, r"(?i)\s+(bei|am|an der|im|in|ob|a\.A\.)\s.*$", ""))
    forms = F.concat(F.array(F.trim(name), plain, short), sides)
    spelled = F.transform(forms, lambda f: F.replace(F.replace(F.replace(F.lower(f), F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue")))
    slugs = F.transform(spelled, lambda f: F.regexp_replace(F.regexp_replace(f, r"[^a-z0-9]+", "-"), "^-+|-+$", ""))
    return F.array_distinct(F.filter(F.concat(forms, slugs), lambda f: f != ""))


def _dropped(json_texts: pd.Series, keys: pd.Series) -> pd.Series:
    import json

    def walk(v: object, gone: set[str]) -> object:
        if isinstance(v, dict):
            return {k: walk(x, gone) for k, x in v.items() if k not in gone}
        return [walk(x, gone) for x in v] if isinstance(v, list) else v

    def one(t: str | None, k: str) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(walk(json.loads(t), set(k.split("|"))), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return pd.Series([one(t, k) for t, k in zip(json_texts, keys, strict=True)])


def without_keys(json_text: Column, keys: Sequence[str]) -> Column:
    """JSON without these keys at any depth; text that is no JSON becomes null."""
    return F.pandas_udf(_dropped, StringType())(json_text, F.lit("|".join(keys)))


def plain_text(df: DataFrame, json_column: str) -> DataFrame:
    """Adds ``plain_text``: all strings of a JSON value in order, joined by line breaks (N7); in Arrow batches, as the depth is open."""
    import pyarrow as pa

    def strings(v: object) -> Iterator[str]:
        if isinstance(v, str):
            yield v
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            yield from strings(x)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            out = []
            for t in batch.column(json_column).to_pylist():
                try:
                    out.append(None if t is None else "\n".join(strings(json.loads(t))))
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "plain_text"])

    return df.mapInArrow(f, df.withColumn("plain_text", F.lit(None).cast("string")).schema)
