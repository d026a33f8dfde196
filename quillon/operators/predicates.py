"""Filters with a rule about nulls, empty lists or order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of decisions and of boilerplate pages.
DECISION = r"(?i)\b(decision|judg(?:e)?ment|order|case|ruling)\b"
BOILERPLATE = r"(?i)\b(privacy|terms|impressum|contact|about|help|faq|cookie|sitemap)\b"


def in_terms(df: DataFrame, field: str, values: Sequence[str] | None) -> Column:
    """Absent list: everything matches; empty list: nothing does; arrays match by any element."""
    if values is None:
        return F.lit(True)
    if not values:
        return F.lit(False)
    if df.schema[field].dataType.typeName() == "array":
        return F.coalesce(F.arrays_overlap(field, F.array(*[F.lit(v) for v in values])), F.lit(False))
    return F.coalesce(F.col(field).isin(*values), F.lit(False))


def refine(df: DataFrame, refinements: Sequence[Mapping[str, object]]) -> DataFrame:
    """Keeps rows that pass every refinement (P13, P14): kind terms, toggle, range, date_range or text, on one field each."""
    kept = df
    for r in refinements:
        kind, field = r["kind"], str(r["field"])
        if kind == "terms":
            kept = kept.where(in_terms(df, field, r.get("values")))
        elif kind == "toggle":
            kept = kept.where(F.col(field)) if r.get("value") is True else kept
        elif kind in ("range", "date_range"):
            value = F.to_date(field) if kind == "date_range" else F.col(field)
            kept = kept.where(value >= r["min"]) if r.get("min") is not None else kept
            kept = kept.where(value <= r["max"]) if r.get("max") is not None else kept
        elif kind == "text":
            for token in str(r["value"]).lower().split():
                kept = kept.where(F.array_contains(F.split(F.lower(F.col(field)), r"[^\p{L}\p{N}]+"), token))
        else:
            raise ValueError(f"unknown refinement {kind}")
    return kept


def parse_refinements(raw: Sequence[object]) -> list[dict[str, object]]:
    """Lower-cases fields and values and drops what is malformed."""
    out = []
    for r in raw if isinstance(raw, list | tuple) else ():
        if isinstance(r, Mapping) and isinstance(r.get("field"), str) and isinstance(r.get("kind"), str):
            clean = dict(r) | {"field": r["field"].lower()}
            if "values" in clean:
                if not isinstance(clean["values"], list | tuple):
                    continue
                clean["values"] = [str(v).lower() for v in clean["values"]]
            out.append(clean)
    return out


def valid_at(start: str, end: str, at: Column) -> Column:
    """Not ended before and not begun after; unknown bounds are kept."""
    return F.coalesce(F.col(end) >= at, F.lit(True)) & F.coalesce(F.col(start) <= at, F.lit(True))


def in_force_state(start: str, end: str, at: Column) -> Column:
    """repealed, not_yet_in_force, unknown or in_force; the last day counts."""
    return F.when(F.col(end) < at, "repealed").when(F.col(start) > at, "not_yet_in_force").when(F.col(start).isNull() & F.col(end).isNull(), "unknown").otherwise("in_force")


def not_kind(field: str, value: str) -> Column:
    """Other than the value; rows without one stay (P20)."""
    return ~F.col(field).eqNullSafe(value)


def json_flag(field: str, path: str, wanted: bool) -> Column:
    """A boolean inside JSON; an absent one counts as false."""
    return F.coalesce(F.get_json_object(field, path).try_cast("boolean"), F.lit(False)) == wanted


def expired(created: str, days: str, now: Column) -> Column:
    """Older than its policy keeps."""
    return F.col(created) < now - F.make_dt_interval(F.col(days))


def is_pdf(content_type: str, url: str) -> Column:
    """By media type or ending."""
    return F.coalesce(F.lower(F.col(content_type)).startswith("application/pdf"), F.lit(False)) | F.coalesce(F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".pdf"), F.lit(False))


def page_kind(*fields: str) -> Column:
    """decision, boilerplate or other, by words in address and title (P25)."""
    text = F.concat_ws(" ", *fields)
    return F.when(text.rlike(DECISION), "decision").when(text.rlike(BOILERPLATE), "boilerplate").otherwise("other")


def first_rule(rules: Sequence[tuple[Mapping[str, str], str]], default: str) -> Column:
    """The value of the first rule whose keys all equal; a rule without keys matches everything."""
    out = F.lit(None).cast("string")
    for spec, value in reversed(list(rules)):
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(v) for k, v in spec.items()], F.lit(True))
        out = F.when(match, F.lit(value)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def newer_than(df: DataFrame, ts: str, target: DataFrame, null_is: str | None = None) -> DataFrame:
    """Rows beyond the target's high-water mark (P10); with ``null_is``, unknown times count as that."""
    mark = target.agg(F.max(ts).alias("m")).scalar()
    floor = F.coalesce(mark, F.lit("0001-01-01").cast(df.schema[ts].dataType))
    value = F.col(ts) if null_is is None else F.coalesce(ts, F.lit(null_is).cast(df.schema[ts].dataType))
    return df.where(value > floor)


def starts_with(field: str, prefix: str) -> Column:
    """Begins with the prefix; null does not."""
    return F.coalesce(F.startswith(F.col(field), F.lit(prefix)), F.lit(False))
