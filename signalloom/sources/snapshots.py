"""File sources: CSV snapshots, nested payloads, fetched-page documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalloom.functions import dates, html, ids, lexicons as L, text as X
from signalloom.operators.extraction import extract_terms
from signalloom.operators.ordering import dedupe_either

REQUIRED_COLUMNS = ("company", "source_job_id", "title", "posting_url")
SNAPSHOT_COLUMNS = (
    "company source_job_id title role_family city state country workplace_type employment_type description_text "
    "qualifications_text responsibilities_text first_seen_at source_posted_at posting_url"
).split()


def read_snapshot(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """CSV snapshots with a header (a byte-order mark is allowed), every column text.

    Each path is read by its own header; a folder whose files differ in header raises, since its columns
    would mix. Rows carry file and position, which give the arrival
    order: files in the given order, then rows as written.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    frames = []
    for number, path in enumerate(listed):
        frame = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
        missing = sorted(set(required) - set(frame.columns))
        if missing:
            raise ValueError(f"{path} is missing required columns: {missing}")
        frames.append(with_row_origin(frame, number))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def with_row_origin(df: DataFrame, file_number: int = 0) -> DataFrame:
    """Add the source file and a sortable arrival position."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.struct(
            F.lit(file_number).alias("file"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("arrival"),
    )


def coalesce_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column per name from the first of its spellings that the frame has and that is set."""
    out = df
    for name, spellings in aliases.items():
        present = [F.col(s) for s in spellings if s in df.columns]
        out = out.withColumn(name, F.coalesce(*present) if present else F.lit(None).cast("string"))
    return out


def repair_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: X.repair_text(c) for c in columns if c in df.columns})


def company_names(contexts: DataFrame) -> DataFrame:
    """Slugs each company answers to.

    ``contexts(company_id, canonical_name, aliases, allowed_subsidiaries, excluded_entities)``
    gives one row per company and accepted name that is not excluded.
    """
    none = F.array().cast("array<string>")
    names = F.concat(F.array("company_id", "canonical_name"), *[F.coalesce(c, none) for c in ("aliases", "allowed_subsidiaries")])
    keys = lambda arr: F.transform(F.filter(arr, lambda n: n != ""), lambda n: X.slug(n, fold_accents=False))
    accepted = F.array_except(keys(names), keys(F.coalesce("excluded_entities", none)))
    return contexts.select("company_id", F.explode(accepted).alias("company_key")).distinct()


def filter_company(df: DataFrame, contexts: DataFrame, company_col: str = "company") -> DataFrame:
    """Rows of the companies in scope, with their ``company_id``."""
    keyed = df.withColumn("company_key", X.slug(F.coalesce(company_col, F.lit("")), fold_accents=False))
    return keyed.join(company_names(contexts), "company_key").drop("company_key")


def load_snapshot(df: DataFrame, contexts: DataFrame, order: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """Clean, scope, validate and dedupe snapshot rows; returns kept rows and one diagnostics row per company.

    Rows of other companies are only counted; rows without a required text are rejected; then the
    first row of a job id or a canonical address wins.
    """
    fixed = repair_columns(df, [c for c, t in df.dtypes if t == "string" and c != "source_file"])
    fixed = coalesce_aliases(fixed, {"description": ["description", "description_text"]})
    scoped = filter_company(fixed, contexts).withColumns(
        {
            "_valid": F.expr(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED_COLUMNS)),
            **{c: X.strip(c) for c in REQUIRED_COLUMNS},
        }
    )
    usable = scoped.filter("_valid").withColumns(
        {
            "_id": F.concat_ws("\u0001", "company_id", "source_job_id"),
            "_address": F.concat_ws("\u0001", F.col("company_id"), X.canonical_url("posting_url")),
        }
    )
    kept = dedupe_either(usable, "_id", "_address", order).drop("_valid", "_id", "_address")
    read = df.agg(F.count(F.lit(1))).scalar()
    counted = scoped.groupBy("company_id").agg(F.count(F.lit(1)).alias("own_rows"), F.count_if(~F.col("_valid")).alias("rows_rejected"))
    accepted = kept.groupBy("company_id").agg(F.count(F.lit(1)).alias("rows_accepted"))
    diagnostics = (
        contexts.select("company_id").join(counted, "company_id", "left").join(accepted, "company_id", "left")
        .na.fill(0, ["own_rows", "rows_rejected", "rows_accepted"])
        .select(
            "company_id", read.alias("rows_read"), "rows_accepted", "rows_rejected",
            F.expr("own_rows - rows_rejected - rows_accepted").alias("duplicates_removed"),
            (read - F.col("own_rows")).alias("other_company_rows"),
        )
    )
    return kept, diagnostics


def import_rows(df: DataFrame, as_of, source_id: str = "csv_import", names: Mapping[str, str] = L.DISPLAY_NAMES) -> DataFrame:
    """Snapshot rows as posting plus evidence columns; incomplete rows are dropped by the caller.

    ``reject_codes`` names what is missing; it is empty for rows to import.
    """
    blank = lambda c: F.coalesce(X.strip(c), F.lit(""))
    base = df.withColumns(
        {
            "title": blank("title"),
            "source_job_id": blank("source_job_id"),
            "description": X.strip_tail(blank("description_text"), L.RELATED_MARKERS),
            "source_url": blank("posting_url"),
            "country": blank("country"),
            "organization": X.display_name("company", names),
            "_role": blank("role_family"),
        }
    )
    key = X.slug("organization")
    return base.withColumns(
        {
            "organization_key": key,
            "job_id": ids.job_uuid(key, F.lit(source_id), "source_job_id"),
            "evidence_id": ids.evidence_uuid(key, F.lit(source_id), "source_job_id"),
            "location": X.compose_location("city", "state"),
            "posted_date": dates.parse_posted([F.col("source_posted_at"), F.col("first_seen_at")], as_of),
            "employment_type": X.map_value("employment_type", L.EMPLOYMENT_TYPES),
            "capability_classifications": F.filter(F.array("_role"), lambda r: r != ""),
            "technologies": extract_terms(["title", "description", "qualifications_text", "responsibilities_text"]),
            "source_type": F.lit("career_site"),
            "source_excerpt": F.col("description"),
            "raw_reference": F.concat_ws(":", F.lit(source_id), key, "source_job_id"),
            "collector_identity": F.lit("csv-import-script"),
            "provenance_metadata": F.to_json(F.struct(key.alias("organization_key"), F.lit(source_id).alias("source_id"), F.col("source_job_id").alias("external_job_id"))),
            "reject_codes": validate_required({"company": "company", "source_job_id": "source_job_id", "title": "title", "description": "description", "posting_url": "source_url", "country": "country"}),
        }
    ).drop("_role")


def validate_required(rules: Mapping[str, str]) -> Column:
    """Array of codes ``missing_<name>`` for columns that are null or blank."""
    return F.array_compact(F.array(*[F.when(X.nonblank(column).isNull(), F.lit(f"missing_{name}")) for name, column in rules.items()]))


def split_quarantine(df: DataFrame, codes: str = "reject_codes") -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows."""
    return df.filter(F.size(codes) == 0), df.filter(F.size(codes) > 0)


PAYLOAD_SCHEMA = (
    "search_summary struct<title string, externalPath string, bulletFields array<string>>, "
    "job_detail struct<jobPostingInfo struct<title string, jobDescription string, location string, additionalLocations array<string>, "
    "startDate string, timeType string, jobReqId string, externalUrl string, country struct<descriptor string, alpha2Code string>, "
    "jobRequisitionLocation struct<country struct<alpha2Code string>>>, hiringOrganization struct<name string>>"
)


def read_payloads(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Nested posting payloads with an explicit schema; unreadable records keep their text in ``_bad``."""
    schema = ", ".join([PAYLOAD_SCHEMA, *([extra] if extra else []), "_bad string"])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def normalize_payloads(df: DataFrame, organization: str, collector: str, reference_prefix: str) -> DataFrame:
    """Payloads as posting plus evidence columns with a ``reject_codes`` array."""
    info, summary = "job_detail.jobPostingInfo.", "search_summary."
    none = F.array().cast("array<string>")
    shaped = df.withColumns(
        {
            "organization": F.lit(organization),
            "source_job_id": X.strip(info + "jobReqId"),
            "title": X.first_text([F.nullif(F.col(info + "title"), F.lit("")), summary + "title"]),
            "posted_date": dates.strict_date(info + "startDate"),
            "description": html.html_to_text(info + "jobDescription"),
            "location": X.join_locations(info + "location", F.coalesce(info + "additionalLocations", none)),
            "country": X.resolve_country(info + "jobRequisitionLocation.country.alpha2Code", info + "country.alpha2Code"),
            "source_url": F.col(info + "externalUrl"),
            "closing_date": dates.parse_closing(F.coalesce(summary + "bulletFields", none)),
            "_bad_closing": dates.closing_rejected(F.coalesce(summary + "bulletFields", none)),
            "employment_type": X.map_value(info + "timeType", L.PAYLOAD_EMPLOYMENT_TYPES),
        }
    )
    reference = F.concat(F.lit(reference_prefix), F.col("source_job_id"))
    codes = F.array_compact(
        F.array(
            F.when(X.nonblank("source_job_id").isNull(), F.lit("missing_requisition_id")),
            F.when(X.nonblank("title").isNull(), F.lit("missing_title")),
            F.when(F.col("posted_date").isNull(), F.lit("invalid_posted_date")),
            F.when(F.col("description") == "", F.lit("missing_description")),
            F.when(F.col("location").isNull(), F.lit("missing_location")),
            F.when(F.col("country").isNull(), F.lit("missing_country")),
            F.when(F.col("_bad_closing"), F.lit("invalid_closing_date")),
            F.when(F.col("closing_date") < F.col("posted_date"), F.lit("invalid_normalized_record")),
        )
    )
    return shaped.withColumns(
        {
            "raw_reference": reference,
            "evidence_id": ids.collector_uuid(collector, "evidence", reference),
            "job_id": ids.collector_uuid(collector, "job", reference),
            "source_excerpt": X.excerpt_ellipsis("description"),
            "collector_identity": F.lit(collector),
            "reject_codes": codes,
        }
    ).drop("_bad_closing", "search_summary", "job_detail")


PAGE_SCHEMA = (
    "status string, source_url string, final_url string, http_status int, text string, "
    "structured_data struct<title string, datePosted string, employmentType string, hiringOrganization struct<name string>, "
    "jobLocation array<struct<address array<struct<addressLocality string, addressRegion string, addressCountry string>>>>>, warning string"
)


def read_page_cache(spark: SparkSession, path: str, per_file: bool = True) -> DataFrame:
    """Fetched-page documents with their URL hash, one per file or one per line.

    What is read has status ``cached``. A document that is no JSON object, or holds a field of another kind, is a
    row with status ``unreadable``, its place in ``warning`` and no address, so that no page is lost unseen.
    """
    lines = spark.read.text(path, wholetext=per_file).select("value", F.col("_metadata.file_name").alias("_file"))
    parsed = F.from_json("value", f"{PAGE_SCHEMA}, _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    rows = lines.filter(F.btrim("value") != "").select(parsed.alias("p"), "_file").select("p.*", "_file")
    good = F.col("_damaged").isNull()
    return rows.withColumns({
        "url_key": F.when(good, ids.hash_key("source_url")), "status": F.when(good, F.lit("cached")).otherwise(F.lit("unreadable")),
        "warning": F.when(good, F.col("warning")).otherwise(F.concat(F.lit("not a page document: "), "_file")),
    }).drop("_damaged", "_file")


def attach_pages(jobs: DataFrame, pages: DataFrame, url_col: str = "posting_url") -> DataFrame:
    """Jobs with the cached page of their canonical address."""
    chosen = pages.select("url_key", F.col("text").alias("page_text"), F.col("status").alias("page_status"), "structured_data", F.col("warning").alias("page_warning"))
    return jobs.withColumn("url_key", ids.hash_key(url_col)).join(chosen, "url_key", "left")


def validate_page_company(df: DataFrame, contexts: DataFrame, name_col="structured_data.hiringOrganization.name", text_col: str = "page_text", status_col: str = "page_status", warning_col: str = "page_warning") -> DataFrame:
    """Fail a page whose structured data names another company and null its text.

    The job's ``company_id`` decides which names are its own.
    """
    name = X.as_col(name_col)
    own = company_names(contexts).withColumn("_own", F.lit(True))
    keyed = df.withColumns({"_name": name, "company_key": X.slug(F.coalesce(name, F.lit("")), fold_accents=False)})
    joined = keyed.join(own, ["company_id", "company_key"], "left")
    foreign = F.coalesce(X.strip("_name") != "", F.lit(False)) & F.col("_own").isNull()
    return joined.withColumn("_foreign", foreign).withColumns(
        {
            status_col: F.when(F.col("_foreign"), F.lit("failed")).otherwise(F.col(status_col)),
            text_col: F.when(~F.col("_foreign"), F.col(text_col)),
            warning_col: F.when(F.col("_foreign"), F.concat(F.lit("structured page metadata identifies another company: "), F.col("_name"))).otherwise(F.col(warning_col)),
        }
    ).drop("_foreign", "_own", "_name", "company_key")


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
