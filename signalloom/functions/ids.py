"""Deterministic identifiers and hashes as native expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from signalloom.functions.text import as_col, canonical_url

# The URL namespace of RFC 9562 name-based UUIDs, and the prefixes of canonical ids below.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID (version 5) of a string column."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(as_col(name), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def job_uuid(organization_key, source_id, external_id, prefix: str = "job:v1:") -> Column:
    """Canonical job id of a source-scoped posting."""
    return uuid5(F.concat(F.lit(prefix), F.concat_ws("|", as_col(organization_key), as_col(source_id), as_col(external_id))))


def evidence_uuid(organization_key, source_id, external_id, prefix: str = "evidence:v1:") -> Column:
    """Canonical evidence id of a source-scoped posting."""
    return uuid5(F.concat(F.lit(prefix), F.concat_ws("|", as_col(organization_key), as_col(source_id), as_col(external_id))))


def collector_uuid(collector: str, kind: str, raw_reference) -> Column:
    """Id minted by a named collector for a raw reference."""
    return uuid5(F.concat(F.lit(f"{collector}:{kind}:"), as_col(raw_reference)))


def canonical_json(columns: Iterable[str]) -> Column:
    """Compact JSON object of the columns with keys in sorted order and control escapes in lower case."""
    names = sorted(columns)
    text = F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in names]), {"ignoreNullFields": "false"})
    # Spark writes control characters as \\u001F; lower-case the hex letter where such an escape occurs.
    fixed = text
    for upper in "ABCDEF":
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*\\u00[01]){upper}", f"$1{upper.lower()}")
    return F.when(F.contains(text, F.lit("\\u00")), fixed).otherwise(text)


def content_hash(columns: Iterable[str] = ("title", "description", "location", "country", "posted_date", "source_url")) -> Column:
    """SHA-256 of the canonical JSON of the source fields."""
    return F.sha2(canonical_json(columns), 256)


def hash_key(url) -> Column:
    """Cache key of a page: SHA-256 of its canonical URL."""
    return F.sha2(canonical_url(url), 256)


def stable_id(prefix, record_json) -> Column:
    """Short id of a record that carries none: twelve hex digits of its sorted JSON."""
    return F.concat(F.upper(as_col(prefix)), F.lit("_LOCAL_"), F.upper(F.substring(F.sha2(as_col(record_json), 256), 1, 12)))
