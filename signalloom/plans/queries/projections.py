"""Cleansing, keys and normalisation over documents, pages, customers and orders."""

from pyspark.sql import functions as F

from signalloom.functions import dates as D, html as H, ids as I, lexicons as L, numbers as N, text as X
from signalloom.plans.registry import query
from signalloom.plans.views import uuid5
from signalloom.sources import snapshots as S


def project(name, table, columns, sql):
    """Register a projection of one table; ``columns`` builds the selected columns."""

    @query(name, sql)
    def _(b):
        return b.table(table).select(*columns())


_FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_')"
_PLAIN = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^a-z0-9]+', '{1}', 'g'), '{1}')"

project("prj1_slug", "documents", lambda: ["doc_id", X.slug("text").alias("slug")], f"SELECT doc_id, {_FOLD.format('text')} AS slug FROM documents")
project("prj2_company_slug", "documents", lambda: ["doc_id", X.slug("text", fold_accents=False).alias("slug")], f"SELECT doc_id, {_PLAIN.format('text', '_')} AS slug FROM documents")
project("prj3_name_key", "documents", lambda: ["doc_id", X.slug("text", " ", False).alias("name_key")], f"SELECT doc_id, {_PLAIN.format('text', ' ')} AS name_key FROM documents")
project(
    "prj4_display_name", "part", lambda: ["p_partkey", X.display_name(F.replace("p_name", F.lit(" "), F.lit("_")), {"RED_WIDGET": "RED Widget"}).alias("display_name")],
    """SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'RED Widget' ELSE upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' ||
       upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) END AS display_name FROM part""",
)
_BROKEN = {c: c.encode("utf-8").decode("cp1252") for c in "éóèñçêüäößÉÈÑÓÇÄÊÜÖ"}


def _broken():
    out = F.col("text")
    for letter, damage in _BROKEN.items():
        out = F.replace(out, F.lit(letter), F.lit(damage))
    return out


_damaged = "text"
for _letter, _damage in _BROKEN.items():
    _damaged = f"replace({_damaged}, '{_letter}', '{_damage}')"
project(
    "prj5_repair_text", "documents", lambda: ["doc_id", X.repair_text(_broken()).alias("repaired")],
    f"SELECT doc_id, CASE WHEN contains(text, 'í') OR contains(text, 'Í') THEN {_damaged} ELSE text END AS repaired FROM documents",
)
_URL = "regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', {0})"
_SCHEME, _HOST, _PATH = _URL.format(1), _URL.format(2), f"rtrim({_URL.format(3)}, '/')"
project("prj6_canonical_url", "pages", lambda: ["page_id", X.canonical_url("url").alias("canonical")], f"SELECT page_id, lower({_SCHEME}) || '://' || lower({_HOST}) || {_PATH} AS canonical FROM pages")
project(
    "prj7_canonical_url_variants", "pages",
    lambda: ["page_id", X.canonical_url("url", strip_www=True).alias("without_www"), X.canonical_url("url", strip_www=True, keep_scheme=False).alias("host_path")],
    f"SELECT page_id, {_SCHEME} || '://' || regexp_replace({_HOST}, '^www\\.', '') || {_PATH} AS without_www, regexp_replace({_HOST}, '^www\\.', '') || {_PATH} AS host_path FROM pages",
)
project("prj8_publisher", "pages", lambda: ["page_id", X.publisher("url").alias("publisher")], f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS publisher FROM pages")
project(
    "prj9_normalize_label", "customer",
    lambda: ["c_custkey", F.coalesce(X.normalize_label(F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("   Unit "))), {"machinery unit": "Heavy Industry"}), F.lit("none")).alias("label")],
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'none' WHEN c_mktsegment = 'MACHINERY' THEN 'Heavy Industry' ELSE c_mktsegment || ' Unit' END AS label FROM customer",
)


def _labels():
    pick = F.when(F.col("p_size") % 3 == 0, F.lit("Payments")).when(F.col("p_size") % 3 == 1, F.lit("data and  AI")).otherwise(F.lit("something else"))
    return F.array(pick, F.lit("AI/ML"), F.lit("Risk & Compliance"), F.col("p_type"))


project(
    "prj12_enum_arrays", "part",
    lambda: ["p_partkey", F.array_join(X.normalize_enum_array(_labels(), L.CAPABILITIES), "; ").alias("capabilities"), X.normalize_enum(F.when(F.col("p_size") % 2 == 0, F.lit("Vice President")).otherwise(F.col("p_type")), L.SENIORITIES, "unknown").alias("seniority")],
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Payments; ' ELSE '' END || 'Artificial Intelligence / Machine Learning; Risk & Compliance' AS capabilities,
       CASE WHEN p_size % 2 = 0 THEN 'director' ELSE 'unknown' END AS seniority FROM part""",
)
project(
    "prj13_leadership_flag", "part",
    lambda: ["p_partkey", X.leadership_flag(F.col("p_size") % 2 == 0, F.when(F.col("p_size") % 3 == 0, F.lit("director")).otherwise(F.lit("senior"))).alias("is_leadership")],
    "SELECT p_partkey, p_size % 6 = 0 AS is_leadership FROM part",
)
project(
    "prj14_employment_type", "orders",
    lambda: ["o_orderkey", F.coalesce(X.map_value(F.when(F.col("o_orderstatus") == "F", " Full Time ").when(F.col("o_orderstatus") == "O", "CONTRACTOR").otherwise("gig"), L.EMPLOYMENT_TYPES), F.lit("none")).alias("employment_type")],
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'full_time' WHEN 'O' THEN 'contract' ELSE 'none' END AS employment_type FROM orders",
)
project(
    "prj15_compose_location", "customer",
    lambda: ["c_custkey", X.compose_location(F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.lit(" NY "))).alias("location")],
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN c_mktsegment || ', NY' WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'NY' ELSE 'Unknown' END AS location FROM customer""",
)
project(
    "prj16_join_locations", "customer",
    lambda: ["c_custkey", F.coalesce(X.join_locations(F.when(F.col("c_custkey") % 4 != 0, F.concat(F.col("c_mktsegment"), F.lit(" "))), F.array(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 5 == 0, F.lit(" Pune")))), F.lit("reject")).alias("location")],
    """SELECT c_custkey, coalesce(nullif(concat_ws(' / ', CASE WHEN c_custkey % 4 <> 0 OR c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN 'Pune' END), ''), 'reject') AS location FROM customer""",
)


@query("prj17_location_parse", """
SELECT job_id, coalesce((SELECT string_agg(DISTINCT parts[1], '|' ORDER BY parts[1]) FROM b_places p WHERE p.job_id = j.job_id AND len(parts) > 0), '') AS cities,
  coalesce((SELECT string_agg(DISTINCT CASE WHEN len(parts) >= 3 THEN parts[-2] WHEN len(parts) = 2 AND country IN ('US', 'CA', 'AU') THEN parts[2] END, '|' ORDER BY CASE WHEN len(parts) >= 3 THEN parts[-2] WHEN len(parts) = 2 AND country IN ('US', 'CA', 'AU') THEN parts[2] END) FROM b_places p WHERE p.job_id = j.job_id), '') AS regions
FROM b_jobs j""")
def _(b):
    return b.postings.select("job_id", F.array_join(F.array_sort(X.cities("location")), "|").alias("cities"), F.array_join(F.array_sort(X.regions("location", "country")), "|").alias("regions"))


project(
    "prj18_resolve_country", "nation",
    lambda: ["n_nationkey", F.coalesce(X.resolve_country(F.when(F.col("n_nationkey") % 2 == 0, F.lit(" gb ")).when(F.col("n_nationkey") % 3 == 0, F.lit("")), F.when(F.col("n_nationkey") % 5 == 0, F.lit("USA")).otherwise(F.lit("in"))), F.lit("reject")).alias("country")],
    "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'GB' WHEN n_nationkey % 5 = 0 THEN 'reject' ELSE 'IN' END AS country FROM nation",
)


def _raw_date():
    shown = F.date_format("o_orderdate", "yyyy-MM-dd")
    return F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).when(F.col("o_orderkey") % 4 == 1, F.concat(shown, F.lit("T08:00:00Z"))).when(F.col("o_orderkey") % 4 == 2, F.lit("2024-02-31")).otherwise(shown)


project(
    "prj19_posted_date", "orders",
    lambda: ["o_orderkey", D.parse_posted([_raw_date(), F.when(F.col("o_orderkey") % 8 == 0, F.lit("2001-09-09 x"))], "2026-08-31").cast("string").alias("posted_date")],
    """SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN '2001-09-09' WHEN o_orderkey % 4 IN (0, 2) THEN '2026-08-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS posted_date FROM orders""",
)
project(
    "prj20_iso_date", "orders",
    lambda: ["o_orderkey", F.coalesce(D.iso_date(_raw_date()).cast("string"), F.lit("none")).alias("head"), F.coalesce(D.iso_date(_raw_date(), exact=True).cast("string"), F.lit("none")).alias("exact")],
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 3) THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'none' END AS head, CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'none' END AS exact FROM orders""",
)


def _bullets():
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yy"))
    return F.array(F.lit("R-1"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit(" posting end DATE : "), F.when(F.col("o_orderkey") % 11 == 0, F.lit("soon")).otherwise(shown), F.lit(" "))).otherwise(F.lit("Full time")))


project(
    "prj21_closing_date", "orders", lambda: ["o_orderkey", F.coalesce(D.parse_closing(_bullets()).cast("string"), F.lit("none")).alias("closing_date"), D.closing_rejected(_bullets()).alias("rejected")],
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS closing_date, o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AS rejected FROM orders""",
)
project(
    "prj22_strip_tail", "documents", lambda: ["doc_id", X.strip_tail("text", ["Of", "Der"]).alias("head")],
    """SELECT doc_id, CASE WHEN cut > 0 THEN rtrim(substr(text, 1, cut - 1), e' \\n\\t\\r') ELSE text END AS head
       FROM (SELECT *, coalesce(least(nullif(strpos(text, 'Of'), 0), nullif(strpos(text, 'Der'), 0)), 0) AS cut FROM documents)""",
)
project(
    "prj23_excerpts", "documents", lambda: ["doc_id", X.excerpt("text", 500).alias("first"), X.excerpt_ellipsis("text").alias("dotted"), X.preview("text").alias("preview")],
    """SELECT doc_id, substr(text, 1, 500) AS "first", CASE WHEN length(text) > 500 THEN rtrim(substr(text, 1, 497), e' \\n\\t\\r') || '...' ELSE text END AS dotted,
       CASE WHEN length(flat) <= 280 THEN flat ELSE substr(flat, 1, 277) || '...' END AS preview FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)""",
)
_NO_SCRIPT = "regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis')"
_VISIBLE = f"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace({_NO_SCRIPT}, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))"""
project(
    "prj24_html_to_text", "pages", lambda: ["page_id", H.html_to_text("html").alias("text")],
    """SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, '"</p>"', '"~P~"'), '<!--.*?-->', '', 'gs'), '<!DOCTYPE[^>]*>', '', 'g'),
       '</?(?:br|div|li|ol|p|ul|h1|h2|h3|h4)(?:\\s[^>]*)?/?>', chr(10), 'gi'), '<[^>]*>', '', 'g'), '~P~', '</p>'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\f\\v]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'), e' \\n') AS text FROM pages""",
)
project("prj25_visible_text", "pages", lambda: ["page_id", H.visible_text("html").alias("text")], f"SELECT page_id, {_VISIBLE} AS text FROM pages")


def _with_json_ld():
    item = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("url").alias("title"), F.lit("2026-08-01").alias("datePosted"), F.lit("x").alias("other")))
    graph = F.concat(F.lit('{"@graph":[{"@type":"WebPage","title":"no"},'), item, F.lit("]}"))
    return F.concat(F.lit('<script type="application/ld+json">'), F.when(F.col("page_id") % 3 == 0, graph).when(F.col("page_id") % 3 == 1, item).otherwise(F.lit("{broken")), F.lit("</script>"), F.col("html"))


project(
    "prj26_json_ld", "pages", lambda: ["page_id", F.coalesce(F.get_json_object(H.extract_json_ld(_with_json_ld()), "$.title"), F.lit("none")).alias("title"), F.coalesce(F.get_json_object(H.extract_json_ld(_with_json_ld()), "$.datePosted"), F.lit("none")).alias("posted")],
    "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN url ELSE 'none' END AS title, CASE WHEN page_id % 3 < 2 THEN '2026-08-01' ELSE 'none' END AS posted FROM pages",
)


@query("prj27_clean_pages", f"SELECT page_id, CASE WHEN length(t) >= 1000 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN length(t) >= 1000 THEN length(t) ELSE 0 END AS chars FROM (SELECT page_id, {_VISIBLE} AS t FROM pages)")
def _(b):
    clean = H.clean_pages(b.table("pages"), "page_id", "html", minimum=1000)
    return clean.select("page_id", "status", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))


project(
    "prj28_validate_required", "customer",
    lambda: ["c_custkey", F.array_join(S.validate_required({"title": F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), "location": F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.lit(" "))}), ",").alias("codes")],
    "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 <> 0 THEN 'missing_title' END, CASE WHEN c_custkey % 3 <> 0 THEN 'missing_location' END) AS codes FROM customer",
)


@query("prj28_quarantine_counts", "SELECT codes, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN c_custkey % 2 <> 0 THEN 'missing_title' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'missing_location' END) AS codes FROM customer) WHERE codes <> '' GROUP BY 1")
def _(b):
    rows = b.table("customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(F.lit(" ")).alias("location"))
    _, bad = S.split_quarantine(rows.withColumn("reject_codes", S.validate_required({"title": "title", "location": "location"})))
    return bad.groupBy(F.array_join("reject_codes", ",").alias("codes")).agg(F.count(F.lit(1)).alias("n"))


project(
    "prj29_name_uuids", "customer", lambda: [I.job_uuid(X.slug("c_mktsegment"), F.lit("csv_import"), "c_name").alias("job_id"), I.evidence_uuid(X.slug("c_mktsegment"), F.lit("csv_import"), "c_name").alias("evidence_id"), I.collector_uuid("feed-v1", "job", "c_name").alias("feed_id")],
    "SELECT " + uuid5("'job:v1:' || lower(c_mktsegment) || '|csv_import|' || c_name") + " AS job_id, " + uuid5("'evidence:v1:' || lower(c_mktsegment) || '|csv_import|' || c_name") + " AS evidence_id, " + uuid5("'feed-v1:job:' || c_name") + " AS feed_id FROM customer",
)


@query("prj30_content_hash", """
SELECT job_id, sha256('{"country":"' || country || '","description":"' || description || '","location":"' || location || '","posted_date":"' || strftime(posted_date, '%Y-%m-%d') || '","source_url":"' || source_url || '","title":"' || title || '"}') AS content_hash FROM b_jobs""")
def _(b):
    return b.postings.select("job_id", I.content_hash().alias("content_hash"))


project(
    "prj31_hash_keys", "pages", lambda: ["page_id", I.hash_key("url").alias("url_key"), I.stable_id(F.lit("hiring"), F.concat(F.lit('{"url":"'), "url", F.lit('"}'))).alias("local_id")],
    f"""SELECT page_id, sha256({_SCHEME} || '://' || lower({_HOST}) || {_PATH}) AS url_key, 'HIRING_LOCAL_' || upper(substr(sha256('{{"url":"' || url || '"}}'), 1, 12)) AS local_id FROM pages""",
)
project(
    "prj32_clean_array", "documents", lambda: ["doc_id", F.array_join(X.clean_array(F.split("text", r"\.")), "|").alias("sentences"), F.size(X.clean_array(F.split("text", " "), ordered=True)).alias("words")],
    """SELECT doc_id, array_to_string(list_filter(x, lambda v, i: v <> '' AND list_position(x, v) = i), '|') AS sentences,
       len(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda v: trim(v, e' \\n\\t\\r')), lambda v: v <> ''))) AS words
       FROM (SELECT *, list_transform(string_split(text, '.'), lambda v: trim(v, e' \\n\\t\\r')) AS x FROM documents)""",
)
project("prj33_question_key", "conversations", lambda: ["conv_id", "turn", X.question_key("text").alias("question_key")], "SELECT conv_id, turn, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS question_key FROM conversations")
project(
    "prj34_first_text", "customer", lambda: ["c_custkey", X.first_text([F.when(F.col("c_custkey") % 2 == 0, F.lit("  ")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.col("c_name")]).alias("label")],
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS label FROM customer",
)
project(
    "prj35_infer_type", "customer",
    lambda: ["c_custkey", X.infer_type(F.when(F.col("c_custkey") % 4 == 0, F.lit("hiring")).otherwise(F.lit("strategy")), [F.lit(None), F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("New Technology")).otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, F.lit("Financial news"))]).alias("evidence_type")],
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'hiring' WHEN c_custkey % 3 = 0 THEN 'financial' WHEN c_mktsegment = 'MACHINERY' THEN 'technology' ELSE 'strategy' END AS evidence_type FROM customer""",
)
project(
    "prj37_detect_mode", "conversations", lambda: ["conv_id", "turn", X.detect_mode("text", ["th the", "und der", "quel"]).alias("mode")],
    "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'th the') OR contains(lower(text), 'und der') OR contains(lower(text), 'quel') THEN 'report' ELSE 'qa' END AS mode FROM conversations",
)


@query("num_general_format", "SELECT o_orderkey, format('{:g}', o_orderkey / 7) AS sevenths, format('{:g}', o_orderkey / 700000) AS millionths FROM orders")
def _(b):
    return b.table("orders").select("o_orderkey", N.general_format(F.col("o_orderkey") / 7).alias("sevenths"), N.general_format(F.col("o_orderkey") / 700000).alias("millionths"))
