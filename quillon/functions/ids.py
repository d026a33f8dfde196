"""Identity: hash ids, base-32 ids and key fallbacks (F1, section 1.3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base-32 alphabet of prefixed ids.
ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def hash_id(*parts: Column | str) -> Column:
    """SHA-256 in hex over the parts joined by ``||``; nulls are skipped, as ``concat_ws`` does."""
    return F.sha2(F.concat_ws("||", *[_text(p) for p in parts]), 256)


def null_safe_hash_id(*parts: Column | str) -> Column:
    """Like ``hash_id``, but a null part differs from a missing one and separators inside parts are escaped."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.concat(F.lit("="), F.replace(_text(p), F.lit("|"), F.lit("\\|"))), F.lit("~")) for p in parts]), 256)


def base32_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix_`` and 26 base-32 characters of the first 128 bits of the hash (two zero bits pad the front)."""
    bits = F.concat(F.lit("00"), *[F.lpad(F.conv(F.substring(hash_id(*parts), 1 + 4 * i, 4), 16, 2), 16, "0") for i in range(8)])
    spelled = [F.substring(F.lit(ALPHABET), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(26)]
    return F.concat(F.lit(prefix + "_"), *spelled)


def first_text(*candidates: Column | str) -> Column:
    """The first candidate that is not null or blank."""
    return F.coalesce(*[F.nullif(F.trim(_text(c)), F.lit("")) for c in candidates])


def document_id(source: str, source_document_id: str, language: str, uri: str) -> Column:
    """Hash of source, id and language where the source has its own id, else of source and address."""
    return F.when(F.col(source_document_id).isNotNull(), hash_id(source, source_document_id, F.coalesce(_text(language), F.lit("")))).otherwise(hash_id(source, uri))


def edge_id(prefix: str, parent: str, position: str) -> Column:
    """Positional fallback id: prefix, parent and place joined by underscores."""
    return F.concat_ws("_", F.lit(prefix), _text(parent), _text(position))
