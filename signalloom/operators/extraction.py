"""Text extraction, grounding, rule classification and lints."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from signalloom.functions import lexicons as L
from signalloom.functions.numbers import half_even, unit
from signalloom.functions.text import as_col, casefold, clean_array, lookup, nfkc, normalize_label, squash
from signalloom.operators.terms import find_terms, listed, term_excerpts, term_names


def _joined(text_cols: Sequence) -> Column:
    return F.concat_ws(" ", *[F.nullif(as_col(c), F.lit("")) for c in text_cols])


def extract_terms(text_cols: Sequence, terms: Mapping[str, Sequence[str]] = L.TECHNOLOGY_TERMS, cased_terms: Mapping[str, Sequence[str]] = L.CASED_TECHNOLOGY_TERMS) -> Column:
    """Sorted canonical names found in any of the text columns, between edges that are no ASCII letter or digit."""
    return term_names(_joined(text_cols), listed(terms, cased_terms))


def extract_terms_dim(df: DataFrame, id_col: str, text_cols: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """``id, name`` for a dictionary table ``(name, form)`` of any size; the words of a form match in sequence."""
    joined = df.select(id_col, _joined(text_cols).alias("_text"))
    return find_terms(joined, [id_col], ["_text"], dictionary, literal=False).select(id_col, "name").distinct()


def term_excerpt(name: str, text_cols: Sequence, terms: Mapping[str, Sequence[str]] = L.TECHNOLOGY_TERMS, cased_terms: Mapping[str, Sequence[str]] = L.CASED_TECHNOLOGY_TERMS, window: int = 60) -> Column:
    """Text around the first match of a name in the first column that has one."""
    own = [t for t in listed(terms, cased_terms) if t[0] == name and (t[2] or name not in cased_terms)]
    return term_excerpts(F.array(F.lit(name)), text_cols, own, window)[0]


# --- grounding ------------------------------------------------------------------------------

TOKEN = r"[^\W_]+|[&+#]+"
# Java's word class counts combining marks, Python's does not; letters and numbers are what both sides mean.
JAVA_TOKEN = r"[\p{L}\p{N}]+|[&+#]+"


def tokens(value, normalize: bool = True) -> Column:
    """Folded word and symbol tokens of a text; a lone ampersand reads as ``and``."""
    text = casefold(nfkc(value) if normalize else value)
    found = F.regexp_extract_all(text, F.lit(JAVA_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.when(t == "&", F.lit("and")).otherwise(t))


def token_line(value, normalize: bool = True) -> Column:
    """Tokens on one line between blanks; containment of lines is contiguity of tokens."""
    return F.concat(F.lit(" "), F.array_join(tokens(value, normalize), " "), F.lit(" "))


def ground_values(values, source_line) -> Column:
    """Array of values whose tokens occur contiguously in the token line of the source."""
    line = as_col(source_line)

    def kept(value):
        own = token_line(value, normalize=False)
        return (own != "  ") & F.contains(line, own)

    # The second reference keeps Catalyst from moving the line's tokenisation into the per-value lambda.
    return F.when(F.length(line) > 0, F.filter(as_col(values), kept))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spans(sources: pd.Series, values: pd.Series) -> pd.Series:
    def cut(source, wanted):
        if wanted is None:
            return None
        text = unicodedata.normalize("NFKC", source)
        marks = [(m.group().casefold() if m.group() != "&" else "and", m.span()) for m in re.finditer(TOKEN, text)]
        words = [w for w, _ in marks]
        out = []
        for value in wanted:
            needle = [m.casefold() if m != "&" else "and" for m in re.findall(TOKEN, unicodedata.normalize("NFKC", value))]
            size = len(needle)
            at = next((i for i in range(len(words) - size + 1) if words[i] == needle[0] and words[i : i + size] == needle), None) if size else None
            out.append(None if at is None else text[marks[at][1][0] : marks[at + size - 1][1][1]])
        return out

    return pd.Series([cut(s, v) for s, v in zip(sources, values)])


def grounded_spans(source, grounded) -> Column:
    """Source wording of each grounded value; rows without grounded values skip the parser."""
    some = F.size(as_col(grounded)) > 0
    return F.coalesce(_spans(F.when(some, as_col(source)), F.when(some, as_col(grounded))), F.array().cast("array<string>"))


def support_rows(df: DataFrame, id_cols: Sequence[str], source_col: str) -> DataFrame:
    """One row per grounded skill, technology, business unit and seniority with its excerpt.

    Reads array columns ``skills`` and ``technologies`` and text columns ``business_unit`` and
    ``seniority_level``; seniority ``unknown`` cites nothing.
    """
    def tagged(field, values):
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    def single(field, condition, column):
        return F.when(condition, F.array(F.struct(F.lit(field).alias("field"), F.col(column).alias("value")))).otherwise(
            F.array().cast("array<struct<field:string,value:string>>")
        )

    wanted = F.concat(
        tagged("skills", F.col("skills")),
        tagged("technologies", F.col("technologies")),
        single("business_unit", F.coalesce(F.col("business_unit") != "", F.lit(False)), "business_unit"),
        single("seniority_level", F.coalesce(F.col("seniority_level") != "unknown", F.lit(False)), "seniority_level"),
    )
    lined = df.select(*id_cols, F.col(source_col).alias("_source"), token_line(source_col).alias("_line"), wanted.alias("_wanted"))
    rows = lined.withColumn("w", F.explode_outer("_wanted")).withColumn("_own", token_line("w.value", normalize=False))
    kept = rows.filter((F.col("_own") != "  ") & F.contains("_line", "_own"))
    return kept.select(*id_cols, F.col("w.field").alias("field"), F.col("w.value").alias("value"), grounded_spans("_source", F.array("w.value"))[0].alias("excerpt"))


def enrichment_confidence(capabilities, skills, technologies, seniority, leadership, business_unit, themes, supported_explicit, removed, has_description, has_excerpt) -> Column:
    """Mean of availability, support coverage and completeness, discounted for removed values.

    ``supported_explicit`` counts the distinct folded skills and technologies that are supported,
    ``removed`` the extracted values that grounding dropped.
    """
    distinct = lambda a: F.size(F.array_distinct(F.transform(as_col(a), casefold)))
    explicit = distinct(skills) + distinct(technologies)
    availability = F.when(has_description & has_excerpt, 1.0).otherwise(0.75)
    coverage = F.when(explicit > 0, as_col(supported_explicit) / explicit).otherwise(1.0)
    filled = [
        F.size(as_col(capabilities)) > 0,
        F.size(as_col(skills)) > 0,
        F.size(as_col(technologies)) > 0,
        as_col(seniority) != "unknown",
        as_col(leadership),
        F.coalesce(as_col(business_unit), F.lit("")) != "",
        F.size(as_col(themes)) > 0,
    ]
    completeness = sum((F.when(f, 1).otherwise(0) for f in filled), F.lit(0)) / len(L.ENRICHMENT_FIELDS)
    base = unit(half_even((availability + coverage + completeness) / 3, 4))
    retained = F.size(as_col(skills)) + F.size(as_col(technologies))
    gone = as_col(removed)
    return F.when(gone > 0, unit(half_even(base * (0.75 + 0.25 * retained / (retained + gone)), 4))).otherwise(base)


def field_confidences(extracted_fields, supported_fields) -> Column:
    """Map of each extracted field to 1.0 when supported, else 0.65."""
    fields = F.array_sort(F.array_distinct(as_col(extracted_fields)))
    return F.map_from_arrays(fields, F.transform(fields, lambda f: F.when(F.array_contains(as_col(supported_fields), f), 1.0).otherwise(0.65)))


def grounding_limitations(has_labels, removed_skills, removed_technologies) -> Column:
    """Notes attached to an enrichment."""
    gone = (as_col(removed_skills) > 0) | (as_col(removed_technologies) > 0)
    note = F.format_string(
        "Unsupported provider extractions were excluded after deterministic grounding validation (%d skills, %d technologies).",
        as_col(removed_skills), as_col(removed_technologies),
    )
    return F.array_compact(
        F.array(
            F.lit("Enrichment uses only the supplied job posting evidence."),
            F.when(has_labels, F.lit("Capability and theme labels are semantic classifications, not strategic claims.")),
            F.when(gone, note),
        )
    )


# --- rule classification --------------------------------------------------------------------


def classify_rules(text, rules: Sequence[tuple[str, Sequence[str]]], default) -> Column:
    """First label whose needle occurs in the folded text padded with blanks."""
    line = casefold(F.concat(F.lit(" "), as_col(text), F.lit(" ")))
    out = None
    for label, needles in rules:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(line, F.lit(needle))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(as_col(default) if not isinstance(default, str) else F.lit(default))


def posting_text(title, role_family, description) -> Column:
    return F.concat_ws(" ", as_col(title), F.coalesce(as_col(role_family), F.lit("")), F.coalesce(as_col(description), F.lit("")))


def rule_classification(jobs: DataFrame, capability_rules=L.CAPABILITY_RULES, seniority_rules=L.SENIORITY_RULES, labels=L.CAPABILITY_LABELS) -> DataFrame:
    """Fallback capability, seniority and confidence of every snapshot job."""
    text = posting_text("title", "role_family", "description")
    return jobs.withColumns(
        {
            "rule_capability": classify_rules(text, capability_rules, F.coalesce(normalize_label("role_family", labels), F.lit("Other"))),
            "rule_seniority": classify_rules(text, seniority_rules, "Unknown"),
            "rule_confidence": F.lit(0.4),
        }
    )


def classification_input(jobs: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Text to classify: page text, else description, whole unless a ``limit`` is asked for; empty becomes null."""
    text = F.coalesce(F.nullif(F.col("page_text"), F.lit("")), F.col("description"), F.lit(""))
    return jobs.join(pages, "source_job_id", "left").withColumn("classifier_text", F.nullif(text if limit is None else F.substring(text, 1, limit), F.lit("")))


def merge_classifications(jobs: DataFrame, supplied: DataFrame, labels: Mapping[str, str] = L.CAPABILITY_LABELS, order: str = "position", key: str = "source_job_id") -> DataFrame:
    """Supplied classifications over the rule fallback.

    Ids no job has are ignored, the first row of an id wins, jobs without one keep the fallback;
    ``classification_source`` says which.
    """
    first = Window.partitionBy(key).orderBy(F.col(order))
    chosen = supplied.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", order).withColumn("_given", F.lit(True))
    given = F.col("_given").isNotNull()
    none = F.array().cast("array<string>")
    return jobs.join(chosen, key, "left").withColumns(
        {
            "capability": F.coalesce(normalize_label("capability", labels), F.col("rule_capability")),
            "business_unit": normalize_label("business_unit", labels),
            "department": normalize_label("department", labels),
            "skills": F.when(given, clean_array("skills")).otherwise(none),
            "technologies": F.when(given, clean_array("technologies")).otherwise(none),
            "seniority": F.when(given, F.coalesce("seniority", F.lit("Unknown"))).otherwise(F.col("rule_seniority")),
            "classification_confidence": F.when(given, F.coalesce("confidence", F.lit(0.5))).otherwise(F.col("rule_confidence")),
            "classification_source": F.when(given, F.lit("llm")).otherwise(F.lit("heuristic")),
        }
    ).drop("_given", "confidence", "rule_capability", "rule_seniority", "rule_confidence")


def omitted_classifications(classified: DataFrame, by: Sequence[str]) -> DataFrame:
    """Jobs per batch the classifier left out, with the warning."""
    missing = F.count_if(F.col("classification_source") == "heuristic")
    return classified.groupBy(*by).agg(missing.alias("missing")).filter("missing > 0").withColumn(
        "warning", F.format_string("classification batch omitted %d jobs; heuristic fallback used", "missing")
    )


# --- lints ----------------------------------------------------------------------------------


def word_line(value) -> Column:
    """Compatibility-normalised, folded words of a text joined by blanks."""
    return F.array_join(F.regexp_extract_all(casefold(nfkc(value)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def excerpt_grounded(citations: DataFrame, catalog: DataFrame, citation_id: str, key: str, excerpt_col: str = "excerpt", source_col: str = "source_text") -> DataFrame:
    """Citations with ``grounded``: the excerpt's words occur in one of the cited item's texts.

    Each side is normalised once before the equi-join; hits are reduced per citation id.
    """
    cited = citations.withColumn("_needle", word_line(excerpt_col))
    sources = catalog.select(key, word_line(source_col).alias("_text")).distinct()
    hits = (
        cited.filter("_needle != ''").select(citation_id, key, "_needle")
        .join(sources, key).filter(F.contains("_text", "_needle"))
        .select(citation_id).distinct().withColumn("_hit", F.lit(True))
    )
    return cited.drop("_needle").join(hits, citation_id, "left").withColumn("grounded", F.col("_hit").isNotNull()).drop("_hit")


def folded_line(value) -> Column:
    return F.regexp_replace(casefold(value), r"\s+", " ")


def unsafe_claim(value, patterns: Sequence[str] = L.UNSAFE_CLAIMS) -> Column:
    """True where the text asserts intent the evidence cannot carry."""
    return folded_line(value).rlike("|".join(f"(?:{p})" for p in patterns))


def narrowing_kind(value, technology=L.TECHNOLOGY_SCOPE, hiring=L.HIRING_SCOPE, assertion=L.CROSS_DOMAIN_ASSERTION) -> Column:
    """``cross_domain``, ``technology_scope`` or null: what support the claim needs."""
    line = folded_line(value)
    return F.when(line.rlike(assertion), F.lit("cross_domain")).when(line.rlike(technology) & line.rlike(hiring), F.lit("technology_scope"))


def unsupported_narrowing(claims: DataFrame, supports: DataFrame, key: str, text_col: str, **patterns) -> DataFrame:
    """Claims whose narrowed scope no cited support carries.

    ``supports(key, domain, support_class, tool_name, signal_count)``; anti-join per needed kind.
    """
    signal = (F.col("tool_name") == "strategy.get_signals") & (F.col("signal_count") > 0)
    technology = (F.col("domain") == "technology") | (F.col("support_class") == "ai_enrichment") | signal
    kinds = F.array_compact(F.array(F.when(signal, F.lit("cross_domain")), F.when(technology, F.lit("technology_scope"))))
    carried = supports.select(key, F.explode(kinds).alias("needs")).distinct()
    return claims.withColumn("needs", narrowing_kind(text_col, **patterns)).filter("needs IS NOT NULL").join(carried, [key, "needs"], "left_anti")


def mention_terms(text, aliases: Mapping[str, Sequence[str]] = L.ORGANIZATION_ALIASES) -> Column:
    """Sorted organization names mentioned between word edges."""
    return term_names(text, listed(aliases), unicode=True)


def scope_mismatch(text, selected, aliases: Mapping[str, Sequence[str]] = L.ORGANIZATION_ALIASES) -> Column:
    """Mentioned organizations other than the selected one."""
    by_alias = {a: name for name, forms in aliases.items() for a in forms}
    own = F.coalesce(lookup(by_alias, squash(casefold(selected))), squash(selected))
    return F.array_except(mention_terms(text, aliases), F.array(own))


def year_conflict(title, url_path) -> Column:
    """True where the report year in the title and in the address differ."""
    year_title = F.regexp_extract(as_col(title), L.TITLE_REPORT_YEAR, 1)
    year_path = F.regexp_extract(as_col(url_path), L.PATH_REPORT_YEAR, 1)
    return F.coalesce((year_title != "") & (year_path != "") & (year_title != year_path), F.lit(False))
