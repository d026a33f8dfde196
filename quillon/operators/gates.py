"""Gates that withhold documents or captures, each with the first cause that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import content_type as media_type
from quillon.functions.text import legal_markers

# Floors and media types.
MIN_CHARS, MIN_MARKERS, MIN_DENSITY_MARKERS = 200, 1, 3
MARKUP = ("text/html", "application/xhtml+xml", "application/xml", "text/xml")


def override(value: Column, default: int) -> Column:
    """A source's own floor: zero counts, anything that is no number from zero on does not."""
    n = value.cast("string").try_cast("int")
    return F.when(n >= 0, n).otherwise(F.lit(default))


def quarantine(df: DataFrame, text: str, sections: str, content_type: str, min_chars: Column | None = None, min_markers: Column | None = None) -> DataFrame:
    """Adds ``quarantine_reason`` (null: passes), ``extracted_chars`` and ``marker_count``."""
    chars, markers = F.length(F.coalesce(text, F.lit(""))), legal_markers(F.coalesce(text, F.lit("")))
    floor, least = min_chars if min_chars is not None else F.lit(MIN_CHARS), min_markers if min_markers is not None else F.lit(MIN_MARKERS)
    reason = (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "no_text_layer")
        .when(F.col(sections) == 0, "no_sections_extracted")
        .when(media_type(content_type).isin(*MARKUP), F.lit(None).cast("string"))
        .when(chars < floor, "below_content_floor")
        .when(markers < least, "below_content_floor")
    )
    return df.withColumn("extracted_chars", chars).withColumn("marker_count", markers).withColumn("quarantine_reason", reason)


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"<[^>]+>", " "), r"\s+", " "))


def legal_density(df: DataFrame, html: str, content_type: str | None = None, least: int = MIN_DENSITY_MARKERS) -> DataFrame:
    """Adds marker count, visible and script lengths, their ratio and ``is_legal_text``; abstains (true) on other media."""
    text = visible_text(F.col(html))
    script = F.aggregate(F.transform(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>"), F.lit(0)), F.length), F.lit(0), lambda a, x: a + x)
    out = df.withColumn("__t", text).withColumn("marker_count", legal_markers("__t")).withColumn("visible_chars", F.length("__t")).withColumn("script_chars", script).drop("__t")
    passes = F.col("marker_count") >= least
    if content_type is not None:
        passes = ~F.coalesce(media_type(content_type).isin(*MARKUP), F.lit(True)) | passes
    return out.withColumn("script_ratio", F.round(F.col("script_chars") / F.greatest(F.lit(1), F.col("visible_chars")), 2)).withColumn("is_legal_text", passes)


def capture(df: DataFrame, body: str, expected: str, declared: str, sniffed: str, least: int = 0) -> DataFrame:
    """Adds ``capture_reason`` (null: passes), the first of: empty_body, content_type_mismatch, html_where_binary_expected, format_signature_missing, below_size_floor.

    ``sniffed`` is what ``sniff_bytes`` makes of the body.
    """
    wants = F.when(F.lower(expected) == "application/pdf", "pdf").when(F.lower(expected) == "application/zip", "zip")
    size = F.coalesce(F.octet_length(body), F.lit(0))
    reason = (
        F.when(size == 0, "empty_body")
        .when((F.coalesce(declared, F.lit("")) != "") & (F.coalesce(expected, F.lit("")) != "") & (media_type(declared) != F.lower(expected)), "content_type_mismatch")
        .when(wants.isNotNull() & (F.col(sniffed) == "html"), "html_where_binary_expected")
        .when(wants.isNotNull() & (F.col(sniffed) != wants), "format_signature_missing")
        .when(size < least, "below_size_floor")
    )
    return df.withColumn("capture_reason", reason)


def insight(passages: DataFrame, cited: DataFrame, keys: list[str]) -> DataFrame:
    """Passages with citations, as insights: confidence 0.95 if any has a key, else 0.78."""
    per = cited.groupBy(*keys).agg(F.count("*").alias("n_citations"), F.count("citation_key").alias("n_keys"), F.array_sort(F.collect_set("citation_type")).alias("types"))
    kind = F.when(F.exists("types", lambda t: t.isin("bge", "de_bverfge", "de_bgh", "fr_cassation", "it_cassazione")), "case_law_reference").otherwise("statute_reference")
    return passages.join(per, keys).withColumn("confidence", F.when(F.col("n_keys") > 0, 0.95).otherwise(0.78)).withColumn("insight_type", kind).withColumn("claim", F.substring("passage", 1, 400))


def in_force_window(hint: Column, extracted: Column) -> Column:
    """A date with where it comes from; a hint beats what was extracted, missing stays missing."""
    h, e = F.nullif(F.trim(hint), F.lit("")), F.nullif(F.trim(extracted), F.lit(""))
    return F.struct(F.coalesce(h, e).alias("date"), F.when(h.isNotNull(), "manifest").when(e.isNotNull(), "extracted").alias("origin"))
