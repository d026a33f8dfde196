"""Scalar text functions (F8 to F35) as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles and file endings that are no titles, markers of legal text, letters that fold.
PLACEHOLDER_TITLES = ("untitled document", "ris dokument", "fedlex", "input-de", "input-en", "input-fr", "input-it", "input-rm")
FILENAME_TITLE = r"(?i)^[\w.]+(?:[-_.][\w.]+)*[-_.](?:docx?|pdf|html?|xhtml|xml|rtf|odt|odf|txt|md)$"
LEGAL_MARKERS = r"(?i)art\.|artikel|§|abs\.|ziff\.|\bcomma\b|\blett\.|\blit\.|\balinéa\b|cpv\.|\bcapoverso\b|\blet\."
LEGAL_ABBREVIATION = r"^(?=(?:.*[A-ZÄÖÜ]){2})[A-ZÄÖÜ][A-Za-zÄÖÜäöü]*$"
FOLD_FROM, FOLD_TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def content_type(c: Column | str) -> Column:
    """The media type without parameters, lower-cased."""
    return F.lower(F.trim(F.split_part(_c(c), F.lit(";"), F.lit(1))))


def language(c: Column | str) -> Column:
    """The primary language of a tag."""
    return F.lower(F.trim(F.split_part(_c(c), F.lit("-"), F.lit(1))))


def fold(c: Column | str) -> Column:
    """Lower-cases, folds Latin diacritics, then ae, oe and ue to a, o and u; sharp s is ss."""
    plain = F.replace(F.translate(F.lower(_c(c)), FOLD_FROM, FOLD_TO), F.lit("ß"), F.lit("ss"))
    for pair in ("ae", "oe", "ue"):
        plain = F.replace(plain, F.lit(pair), F.lit(pair[0]))
    return plain


def letters(c: Column | str) -> Column:
    """Runs of a-z of folded text."""
    return F.array_remove(F.split(fold(c), "[^a-z]+"), "")


def zero_fill(c: Column | str, width: int) -> Column:
    """Pads with zeros and, unlike a plain pad, never cuts."""
    return F.lpad(_c(c), F.greatest(F.lit(width), F.length(_c(c))), F.lit("0"))


def preview(c: Column | str, size: int = 400) -> Column:
    return F.substring(_c(c), 1, size)


def is_placeholder_title(c: Column | str) -> Column:
    return F.lower(F.trim(_c(c))).isin(*PLACEHOLDER_TITLES)


def is_filename(c: Column | str) -> Column:
    """Looks like a file name: no white space, two or more separators, a document's ending."""
    t = F.trim(_c(c))
    separators = F.length(t) - F.length(F.translate(t, "-_.", ""))
    return (t != "") & ~t.rlike(r"\s") & (separators >= 2) & t.rlike(FILENAME_TITLE)


def title(hint: Column, structured: Column, heading: Column) -> Column:
    """The first real title of hint, structured title and first heading."""
    real = lambda c: F.when((F.trim(c) != "") & ~is_placeholder_title(c) & ~is_filename(c), F.trim(c))
    return F.coalesce(real(hint), real(structured), real(heading), F.lit("Untitled document"))


def is_abbreviation(c: Column | str) -> Column:
    """Shaped like a statute's short title: two capitals or more, letters only."""
    return _c(c).rlike(LEGAL_ABBREVIATION)


def legal_markers(c: Column | str) -> Column:
    return F.regexp_count(_c(c), F.lit(LEGAL_MARKERS))


def iso_from_dotted(c: Column | str) -> Column:
    """``DD.MM.YYYY`` as an ISO date; anything else is null."""
    ok = _c(c).rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$")
    return F.date_format(F.try_to_timestamp(F.when(ok, _c(c)), F.lit("d.M.yyyy")), "yyyy-MM-dd")


def iso_date(c: Column | str) -> Column:
    """The date part of an ISO string, or null."""
    return F.when(_c(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(_c(c), 1, 10))


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """A rounded share; of nothing it is zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, places))


def positive_int(c: Column | str) -> Column:
    """A positive integer, or null: zero is no denominator."""
    n = F.trim(_c(c).cast("string")).try_cast("decimal(38,0)")
    return F.when(_c(c).cast("string").rlike(r"^\s*\d+\s*$") & (n > 0), n.try_cast("long"))


def modality(c: Column | str) -> Column:
    """html, xml or markdown, by the first 500 characters; else null."""
    head = F.lower(F.substring(F.regexp_replace(_c(c), r"^\s+", ""), 1, 500))
    return F.when(head.startswith("<!doctype html") | F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<body")), "html").when(head.startswith("<?xml") | head.startswith("<dokument") | head.startswith("<article"), "xml").when(head.startswith("#") | head.rlike("\n(#|- |\\* )"), "markdown")


def url_canonical(c: Column | str, drop: tuple[str, ...] = TRACKING, collapse_slash: bool = False) -> Column:
    """Without fragment and named parameters; an empty path becomes a slash."""
    u = F.regexp_replace(_c(c), "#.*$", "")
    base, query = F.regexp_extract(u, r"^([^?]*)", 1), F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*drop)), "&")
    base = F.when(base.rlike(r"^\w+://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(base)
    if collapse_slash:
        base = F.when(base.rlike(r"^\w+://[^/]+/.+/$"), F.regexp_replace(base, "/+$", "")).otherwise(base)
    return F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def sniff_bytes(c: Column | str) -> Column:
    """pdf, zip, html or unknown, by magic bytes and markers in the first 1024; a byte-order mark and white space are skipped."""
    raw = F.decode(F.substring(_c(c), 1, 1024), "ISO-8859-1")
    head = F.regexp_replace(raw, "^\\s*(\u00ef\u00bb\u00bf)?\\s*", "")
    return F.when(head.startswith("%PDF-"), "pdf").when(head.startswith("PK\x03\x04") | head.startswith("PK\x05\x06"), "zip").when(F.lower(head).rlike("<!doctype html|<html|<script|<meta http-equiv"), "html").otherwise("unknown")


def is_official(origin: Column | str) -> Column:
    """Official source kinds (F32)."""
    return F.coalesce(_c(origin).isin("official_primary", "official_mirror"), F.lit(False))


def corpus_token(c: Column | str, tokens: dict[str, str]) -> Column:
    """The value of the first token, in the given order, that the id holds as a whole word."""
    parts = F.split(F.lower(_c(c)), "[^a-z0-9]+")
    return F.coalesce(*[F.when(F.array_contains(parts, t), F.lit(v)) for t, v in tokens.items()])


def json_text(c: Column | str, path: str) -> Column:
    """A string at a path, or null where it is absent, null or not scalar."""
    v = F.get_json_object(_c(c), path)
    return F.when(~F.substring(v, 1, 1).isin("{", "["), v)


# Aliases of document types.
DOCUMENT_TYPES = {"gesetz": "law", "loi": "law", "legge": "law", "bundesgesetz": "law", "judgment": "decision", "ruling": "decision", "urteil": "decision", "arrêt": "decision", "sentenza": "decision", "entscheid": "decision", "beschluss": "decision", "kommentar": "commentary"}


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of a small fixed table, or null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def document_type(extracted: Column | str, hint: Column | str) -> Column:
    """The extracted type, else the hint; lower-cased, aliases resolved."""
    clean = F.coalesce(F.nullif(F.lower(F.trim(_c(extracted))), F.lit("")), F.nullif(F.lower(F.trim(_c(hint))), F.lit("")))
    return F.coalesce(lookup(clean, DOCUMENT_TYPES), clean)


def jurisdiction(aliases: dict[str, str], *hints: Column | str) -> Column:
    """The first hint that is an id, ``jur_`` and more, or an alias of one."""
    one = lambda h: F.when(h.rlike(r"^jur_[a-z0-9_]+$"), h).otherwise(lookup(h, aliases))
    return F.coalesce(*[one(F.lower(F.trim(_c(h)))) for h in hints])


def csv_list(c: Column | str) -> Column:
    """The distinct entries between commas, trimmed, in order of first appearance; null and blank give none."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


# Shapes of ids.
JURISDICTION_TOKEN, PLACE_ID, AUTHORITY_ID = r"^[A-Z]{2}(?:-[A-Z0-9]{1,3})?$", r"^jur_[a-z0-9_]+$", r"^auth_[a-z0-9_]+$"


def valid_places(tokens: Column) -> Column:
    """The entries of a list that are ISO tokens or ids of places or authorities; others are dropped."""
    return F.filter(tokens, lambda t: t.rlike(JURISDICTION_TOKEN) | t.rlike(PLACE_ID) | t.rlike(AUTHORITY_ID))
