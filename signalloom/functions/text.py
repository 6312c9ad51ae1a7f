"""Cleansing, keys and normalisation of text columns."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The characters Python's str.strip removes.
WHITESPACE = " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085  " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
NON_ASCII = r"[^\x00-\x7F]"
# Latin letters whose case folding is more than lower-casing.
FOLD_EXPANSIONS = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": "ʼn"}
MOJIBAKE_MARKERS = ("â€", "Ã", "Â")


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value) -> Column:
    """Trim every Unicode whitespace character from both ends."""
    return F.btrim(as_col(value), F.lit(WHITESPACE))


def rstrip(value) -> Column:
    return F.rtrim(as_col(value), F.lit(WHITESPACE))


def bound(value, use) -> Column:
    """``use`` of a value that is worked out once; written out, Spark works it out wherever it occurs inside a lambda."""
    return F.transform(F.array(value), use)[0]


def chained(*arrays) -> Column:
    """The arrays one after the other, null if one is null; ``concat`` of arrays is slow wherever Spark does not compile it, as around lambdas."""
    return F.flatten(F.array(*[as_col(a) for a in arrays]))


def squash(value) -> Column:
    """Collapse runs of whitespace to one space and trim."""
    return F.btrim(F.regexp_replace(as_col(value), r"[\s\u001c-\u001f\u0085   -     　\u000b]+", " "), F.lit(" "))


def nonblank(value) -> Column:
    """The trimmed text, or null where nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def casefold(value) -> Column:
    """Lower case with the Latin letters that fold to several characters expanded."""
    out = F.translate(F.lower(as_col(value)), "ſς", "sσ")
    for letter, expansion in FOLD_EXPANSIONS.items():
        out = F.replace(out, F.lit(letter), F.lit(expansion))
    return out


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if unicodedata.is_normalized("NFKC", v) else unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _cp1252_to_utf8(values: pd.Series) -> pd.Series:
    def repair(text: str) -> str:
        try:
            return text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return text

    return values.map(repair, na_action="ignore")


@lru_cache(maxsize=1)
def _ascii_forms() -> tuple[str, str, dict[str, str]]:
    """Every character whose compatibility decomposition holds ASCII: single letters and longer forms."""
    single: dict[str, str] = {}
    longer: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if plain:
            (single if len(plain) == 1 else longer)[char] = plain
    return "".join(single), "".join(single.values()), longer


def ascii_fold(value) -> Column:
    """Drop accents and other non-ASCII without leaving the JVM.

    Decomposition is per character, so a character table is exact; plain ASCII rows skip it.
    """
    text = as_col(value)
    letters, plain, longer = _ascii_forms()
    table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    expanded = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    spelled = F.when(text.rlike("[" + "".join(rf"\x{{{ord(c):x}}}" for c in longer) + "]"), expanded).otherwise(text)
    return F.when(text.rlike(NON_ASCII), F.regexp_replace(F.translate(spelled, letters, plain), NON_ASCII, "")).otherwise(text)


def nfkc(value) -> Column:
    """Compatibility-composed text; plain ASCII rows do not reach Python."""
    text = as_col(value)
    return F.coalesce(_nfkc(F.when(text.rlike(NON_ASCII), text)), text)


def repair_text(value) -> Column:
    """Undo UTF-8 read as windows-1252 where its markers occur; unchanged when it does not decode."""
    text = as_col(value)
    marked = text.rlike("|".join(MOJIBAKE_MARKERS))
    return F.coalesce(_cp1252_to_utf8(F.when(marked, text)), text)


def slug(value, sep: str = "_", fold_accents: bool = True) -> Column:
    """Lower-case key of letters and digits; other runs become ``sep``; empty stays empty."""
    text = F.lower(ascii_fold(value)) if fold_accents else casefold(value)
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", sep), F.lit(sep))


def lookup(mapping: Mapping[str, str], key) -> Column:
    """Value of a small fixed map, null when absent."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), as_col(key))


def display_name(value, overrides: Mapping[str, str]) -> Column:
    """Readable organization name of an upper-case token."""
    token = F.upper(strip(value))
    runs = F.regexp_extract_all(F.lower(F.replace(token, F.lit("_"), F.lit(" "))), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.coalesce(lookup(overrides, token), F.array_join(F.transform(runs, F.initcap), ""))


def map_value(value, mapping: Mapping[str, str]) -> Column:
    """Known phrase of the trimmed, folded text, else null."""
    return lookup(mapping, casefold(strip(value)))


def normalize_label(value, aliases: Mapping[str, str]) -> Column:
    """Whitespace-collapsed label with aliases resolved; blank becomes null."""
    return bound(F.nullif(squash(value), F.lit("")), lambda clean: F.coalesce(lookup(aliases, casefold(clean)), clean))


def enum_key(value) -> Column:
    """Comparison key of enumeration labels: folded, ``&`` spelled out, slashes as spaces."""
    text = F.replace(casefold(value), F.lit("&"), F.lit(" and "))
    return squash(F.replace(text, F.lit("/"), F.lit(" ")))


def normalize_enum_array(values, aliases: Mapping[str, str]) -> Column:
    """Known labels of the array in first-seen order; unknown ones dropped."""
    known = F.transform(as_col(values), lambda v: lookup(aliases, enum_key(v)))
    return F.array_distinct(F.filter(known, lambda v: v.isNotNull()))


def normalize_enum(value, aliases: Mapping[str, str], default: str) -> Column:
    return F.coalesce(lookup(aliases, enum_key(value)), F.lit(default))


def leadership_flag(flag, seniority, levels: Sequence[str] = ("director", "executive")) -> Column:
    """A leadership claim holds only for the given seniority levels."""
    return F.coalesce(as_col(flag) & as_col(seniority).isin(*levels), F.lit(False))


def clean_array(values, ordered: bool = False) -> Column:
    """Trimmed non-blank distinct entries, first-seen order or sorted."""
    kept = F.array_distinct(F.filter(F.transform(as_col(values), strip), lambda v: F.coalesce(v != "", F.lit(False))))
    return F.array_sort(kept) if ordered else kept


# --- URLs -----------------------------------------------------------------------------------


def _url_part(value, part: str) -> Column:
    return F.coalesce(F.try_parse_url(strip(value), F.lit(part)), F.lit(""))


def canonical_url(value, strip_www: bool = False, keep_scheme: bool = True) -> Column:
    """Lower-case scheme and host, path without trailing slash, no query or fragment.

    An address that does not parse keeps its trimmed text without query and fragment.
    """
    host = F.lower(_url_part(value, "AUTHORITY"))
    if strip_www:
        host = F.regexp_replace(host, r"^www\.", "")
    path = F.rtrim(_url_part(value, "PATH"), F.lit("/"))
    scheme = F.lower(_url_part(value, "PROTOCOL"))
    whole = F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(F.lit("")), host, path) if keep_scheme else F.concat(host, path)
    bare = F.rtrim(F.regexp_replace(strip(value), r"[?#].*$", ""), F.lit("/"))
    return F.when(host != "", whole).otherwise(bare)


def publisher(value) -> Column:
    """Host of the address without a leading www, null when there is none."""
    return F.nullif(F.regexp_replace(_url_part(value, "AUTHORITY"), r"^www\.", ""), F.lit(""))


# --- locations ------------------------------------------------------------------------------


def compose_location(city, state, default: str = "Unknown") -> Column:
    joined = F.concat_ws(", ", nonblank(city), nonblank(state))
    return F.when(joined != "", joined).otherwise(F.lit(default))


def join_locations(primary, additional) -> Column:
    """Distinct trimmed places in order joined by `` / ``; null when none is left."""
    places = clean_array(F.concat(F.array(as_col(primary)), F.coalesce(as_col(additional), F.array().cast("array<string>"))))
    return F.nullif(F.array_join(places, " / "), F.lit(""))


REGION_COUNTRIES = ("US", "CA", "AU")


def location_parts(location) -> Column:
    """Array of places, each an array of its non-blank comma parts."""
    places = F.split(as_col(location), " / ")
    return F.transform(places, lambda p: F.filter(F.transform(F.split(p, ","), strip), lambda x: x != ""))


def cities(location) -> Column:
    """Distinct cities: the first part of every place."""
    return F.array_distinct(F.transform(F.filter(location_parts(location), lambda p: F.size(p) > 0), lambda p: F.element_at(p, 1)))


def regions(location, country) -> Column:
    """Distinct regions: second-to-last of three or more parts, or the second of two in countries that write states."""
    coded = F.upper(strip(country)).isin(*REGION_COUNTRIES)
    return F.array_distinct(
        F.filter(
            F.transform(
                location_parts(location),
                lambda p: F.when(F.size(p) >= 3, F.try_element_at(p, F.lit(-2))).when((F.size(p) == 2) & coded, F.try_element_at(p, F.lit(2))),
            ),
            lambda r: r.isNotNull(),
        )
    )


def resolve_country(nested, top_level) -> Column:
    """Two-letter code of the nested value, else the top-level one; null when neither is one."""
    code = strip(F.coalesce(F.nullif(as_col(nested), F.lit("")), as_col(top_level)))
    return F.when(code.rlike("^[A-Za-z]{2}$"), F.upper(code))


# --- cutting --------------------------------------------------------------------------------


def strip_tail(value, markers: Sequence[str]) -> Column:
    """Text before the first marker, right-trimmed; unchanged when no marker occurs."""
    text = as_col(value)
    hits = [F.nullif(F.locate(m, text), F.lit(0)) for m in markers]
    first = F.least(*hits) if len(hits) > 1 else hits[0]
    return F.when(first.isNotNull(), rstrip(F.substring(text, F.lit(1), first - 1))).otherwise(text)


def excerpt(value, size: int) -> Column:
    """The first ``size`` characters."""
    return F.substring(as_col(value), 1, size)


def excerpt_ellipsis(value, limit: int = 500) -> Column:
    """Short texts whole; longer ones cut three characters early, right-trimmed, with dots."""
    text = as_col(value)
    return F.when(F.length(text) > limit, F.concat(rstrip(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def preview(value, limit: int = 280) -> Column:
    """Whitespace-collapsed text cut to ``limit`` with dots."""
    text = squash(value)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


# --- records --------------------------------------------------------------------------------


def first_text(columns: Sequence) -> Column:
    """First non-blank trimmed text among the columns."""
    return F.coalesce(*[nonblank(c) for c in columns])


def infer_type(agent, columns: Sequence, kinds: Sequence[str] = ("leadership", "financial", "technology", "news", "strategy")) -> Column:
    """Evidence type: hiring for the hiring agent, else the first kind named in the texts."""
    text = casefold(F.concat_ws(" ", *[F.coalesce(as_col(c).cast("string"), F.lit("")) for c in columns]))
    out = F.when(as_col(agent) == "hiring", F.lit("hiring"))
    for kind in kinds:
        out = out.when(F.contains(text, F.lit(kind)), F.lit(kind))
    return out.otherwise(F.lit("strategy"))


def question_key(value) -> Column:
    return squash(casefold(value))


def any_term(value, terms: Sequence[str]) -> Column:
    """True where the folded text contains one of the terms."""
    text = casefold(value)
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(text, F.lit(term))
    return hit


def detect_mode(value, terms: Sequence[str]) -> Column:
    return F.when(any_term(value, terms), F.lit("report")).otherwise(F.lit("qa"))
