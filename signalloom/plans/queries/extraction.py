"""Term extraction, grounding, classification and lints over documents and conversations.

Scores are compared after rounding the exact binary value, which in DuckDB is what ``printf`` does;
its ``round_even`` rounds the product with the power of ten and turns 0.0375 into 0.038.
"""

from pyspark.sql import functions as F

from signalloom.operators import extraction as T
from signalloom.operators.terms import find_terms
from signalloom.plans.registry import query, view

# Dictionary of words that occur in the texts; forms nest and differ in case on purpose.
TERMS = {"Article": ["the", "der", "le"], "Conjunction": ["and", "und"], "Phrase": ["of the", "is the"], "Suffix": ["tion", "&&&"], "Verb": ["is"]}
CASED = {"Opening": ["The", "Of", "Der"]}


def _regex(forms, cased=False):
    body = "|".join(sorted((f.replace("&", "\\&") for f in forms), key=len, reverse=True))
    return f"regexp_matches(text, '{'' if cased else '(?i)'}(^|[^A-Za-z0-9])({body})([^A-Za-z0-9]|$)')"


_FOUND = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {_regex(forms, name in CASED)} THEN '{name}' END" for name, forms in sorted({**TERMS, **CASED}.items())
) + ")"


@query("txt1_extract_terms", f"SELECT doc_id, {_FOUND} AS terms FROM documents")
def _(b):
    return b.table("documents").select("doc_id", F.array_join(T.extract_terms(["text"], TERMS, CASED), "|").alias("terms"))


@query("txt2_cased_terms", f"SELECT doc_id, CASE WHEN {_regex(CASED['Opening'], True)} THEN 'Opening' ELSE '' END AS terms FROM documents")
def _(b):
    return b.table("documents").select("doc_id", F.array_join(T.extract_terms(["text"], {}, CASED), "|").alias("terms"))


@query("txt1_extract_terms_dictionary", """
SELECT doc_id, name FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS line FROM documents)
JOIN (VALUES ('Article', 'the'), ('Article', 'der'), ('Phrase', 'of the'), ('Phrase', 'is the'), ('Verb', 'is')) d(name, form) ON contains(line, ' ' || form || ' ') GROUP BY ALL""")
def _(b):
    forms = [("Article", "the"), ("Article", "der"), ("Phrase", "of the"), ("Phrase", "is the"), ("Verb", "is")]
    return T.extract_terms_dim(b.table("documents"), "doc_id", ["text"], b.spark.createDataFrame(forms, "name string, form string"))


@query("txt3_term_places", """
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w))
SELECT doc_id, name, count(*) AS n FROM (
  SELECT doc_id, 'Article' AS name FROM p WHERE a IN ('the', 'der') UNION ALL SELECT doc_id, 'Phrase' FROM p WHERE (a = 'of' OR a = 'is') AND b = 'the'
  UNION ALL SELECT doc_id, 'Verb' FROM p WHERE a = 'is') GROUP BY ALL""")
def _(b):
    forms = [("Article", "the"), ("Article", "der"), ("Phrase", "of the"), ("Phrase", "is the"), ("Verb", "is")]
    found = find_terms(b.table("documents"), ["doc_id"], ["text"], b.spark.createDataFrame(forms, "name string, form string"), literal=False)
    return found.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("txt3_term_excerpt", """
SELECT doc_id, CASE WHEN m = '' THEN '' ELSE trim(substr(text, greatest(1, p - 60), p + len(m) + 60 - greatest(1, p - 60)), e' \\n\\t\\r') END AS excerpt
FROM (SELECT doc_id, text, m, length(regexp_extract(text, '(?s)^(.*?(?:^|[^A-Za-z0-9]))(?:und|and)(?:[^A-Za-z0-9]|$)', 1)) + 1 AS p FROM (SELECT doc_id, text, regexp_extract(text, '(?:^|[^A-Za-z0-9])(und|and)(?:[^A-Za-z0-9]|$)', 1) AS m FROM documents))""")
def _(b):
    excerpt = T.term_excerpt("Conjunction", ["text"], {}, {"Conjunction": ["and", "und"]})
    return b.table("documents").select("doc_id", F.coalesce(excerpt, F.lit("")).alias("excerpt"))


view("x_tokens", """
SELECT doc_id, lang, source, list_transform(regexp_extract_all(text, '[\\pL\\pN]+|[&+#]+'), lambda t: CASE WHEN t = '&' THEN 'and' ELSE replace(lower(t), 'ß', 'ss') END) AS toks FROM documents
""")
view("x_lines", "SELECT *, ' ' || array_to_string(toks, ' ') || ' ' AS line FROM x_tokens")


def _candidates():
    words = F.split("text", " ")
    take = lambda i, n: F.array_join(F.slice(words, i, n), " ")
    return F.array(take(2, 2), take(5, 3), F.lit("Of The"), F.lit("Tion IS"), F.lit("!!"))


def _wanted():
    """Values an extractor might claim: passages of the text itself and phrases that may be missing."""
    return F.when(F.size(F.split("text", " ")) >= 8, _candidates()).otherwise(F.array(F.lit("of the"), F.lit("tion is"), F.lit("!!")))


_VALUES = """CASE WHEN len(w) >= 8 THEN [w[2] || ' ' || w[3], w[5] || ' ' || w[6] || ' ' || w[7], 'Of The', 'Tion IS', '!!'] ELSE ['of the', 'tion is', '!!'] END"""
view("x_values", f"""
SELECT doc_id, lang, source, line, v, ' ' || array_to_string(list_transform(regexp_extract_all(v, '[\\pL\\pN]+|[&+#]+'), lambda t: CASE WHEN t = '&' THEN 'and' ELSE replace(lower(t), 'ß', 'ss') END), ' ') || ' ' AS own
FROM (SELECT doc_id, lang, source, line, unnest({_VALUES}) AS v FROM (SELECT x.*, string_split(d.text, ' ') AS w FROM x_lines x JOIN documents d USING (doc_id)))
""")


@query("txt4_ground_values", "SELECT doc_id, v AS value FROM x_values WHERE own <> '  ' AND contains(line, own)")
def _(b):
    docs = b.table("documents").select("doc_id", T.token_line("text").alias("line"), _wanted().alias("wanted"))
    return docs.select("doc_id", F.explode_outer(T.ground_values("wanted", "line")).alias("value")).filter("value IS NOT NULL")


def _claims(b):
    """Extractions per document as an enrichment would report them."""
    docs = b.table("documents")
    return docs.select(
        "doc_id", "text", F.col("source").alias("business_unit"), F.when(F.col("lang") == "en", F.lit("the")).otherwise(F.lit("unknown")).alias("seniority_level"),
        F.slice(_wanted(), 1, 2).alias("skills"), F.array(F.lit("Of The"), F.lit("kubernetes")).alias("technologies"),
    )


view("x_claims", f"""
SELECT doc_id, line, 'skills' AS field, unnest(list_slice({_VALUES}, 1, 2)) AS v FROM (SELECT x.*, string_split(d.text, ' ') AS w FROM x_lines x JOIN documents d USING (doc_id))
UNION ALL SELECT doc_id, line, 'technologies', unnest(['Of The', 'kubernetes']) FROM x_lines UNION ALL SELECT doc_id, line, 'business_unit', source FROM x_lines UNION ALL SELECT doc_id, line, 'seniority_level', 'the' FROM x_lines WHERE lang = 'en'
""")
view("x_support", """
SELECT doc_id, field, v FROM (SELECT *, ' ' || array_to_string(list_transform(regexp_extract_all(v, '[\\pL\\pN]+|[&+#]+'), lambda t: CASE WHEN t = '&' THEN 'and' ELSE replace(lower(t), 'ß', 'ss') END), ' ') || ' ' AS own FROM x_claims)
WHERE own <> '  ' AND contains(line, own)
""")


@query("txt5_support_rows", "SELECT doc_id, field, v AS value FROM x_support")
def _(b):
    rows = T.support_rows(_claims(b), ["doc_id"], "text")
    return rows.filter("excerpt IS NOT NULL").select("doc_id", "field", "value")


@query("txt5_support_excerpts", """
SELECT doc_id, field, count(*) AS n FROM x_support GROUP BY ALL""")
def _(b):
    # The excerpt's own tokens must equal the value's tokens.
    rows = T.support_rows(_claims(b), ["doc_id"], "text")
    return rows.filter(T.token_line("excerpt") == T.token_line("value")).groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("n"))


@query("txt6_enrichment_confidence", """
SELECT doc_id, CASE WHEN removed > 0 THEN CAST(printf('%.4f', CAST(base * (0.75 + 0.25 * kept / (kept + removed)) AS DOUBLE)) AS DOUBLE) ELSE base END AS confidence FROM (
  SELECT c.doc_id, c.n - coalesce(s.n, 0) AS removed, coalesce(s.n, 0) AS kept,
    CAST(printf('%.4f', CAST((CASE WHEN d.lang = 'en' THEN 1.0 ELSE 0.75 END + 1.0 + (CASE WHEN coalesce(s.sk, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(s.te, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END + 1)::DOUBLE / 7)::DOUBLE / 3 AS DOUBLE)) AS DOUBLE) AS base
  FROM (SELECT doc_id, count(*) AS n FROM x_claims WHERE field IN ('skills', 'technologies') GROUP BY 1) c JOIN documents d USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (field = 'skills') AS sk, count(*) FILTER (field = 'technologies') AS te FROM x_support WHERE field IN ('skills', 'technologies') GROUP BY 1) s USING (doc_id))""")
def _(b):
    claims = _claims(b).withColumn("_line", T.token_line("text"))
    kept = claims.withColumns({"k_skills": T.ground_values("skills", "_line"), "k_tech": T.ground_values("technologies", "_line")})
    none = F.array().cast("array<string>")
    removed = F.size("skills") + F.size("technologies") - F.size("k_skills") - F.size("k_tech")
    distinct = F.size(F.array_distinct(F.transform("k_skills", F.lower))) + F.size(F.array_distinct(F.transform("k_tech", F.lower)))
    score = T.enrichment_confidence(none, "k_skills", "k_tech", "seniority_level", F.lit(False), "business_unit", none, distinct, removed, F.lit(True), F.col("seniority_level") != "unknown")
    return kept.select("doc_id", score.alias("confidence"))


@query("txt7_field_confidences", """
SELECT doc_id, field, CASE WHEN (doc_id, field) IN (SELECT doc_id, field FROM x_support) THEN 1.0 ELSE 0.65 END::DOUBLE AS confidence FROM (SELECT DISTINCT doc_id, field FROM x_claims)""")
def _(b):
    claims = _claims(b)
    supported = T.support_rows(claims, ["doc_id"], "text").groupBy("doc_id").agg(F.collect_set("field").alias("supported"))  # four field names at most
    fields = F.array_compact(F.array(F.lit("skills"), F.lit("technologies"), F.lit("business_unit"), F.when(F.col("seniority_level") != "unknown", F.lit("seniority_level"))))
    joined = claims.join(supported, "doc_id", "left").withColumn("supported", F.coalesce("supported", F.array().cast("array<string>")))
    return joined.select("doc_id", F.explode(T.field_confidences(fields, "supported")).alias("field", "confidence"))


RULES = [("Alpha", ["&&&", " ouel"]), ("Beta", [" und die", "entint"]), ("Gamma", ["tion "])]
_RULE_SQL = "CASE WHEN contains(t, '&&&') OR contains(t, ' ouel') THEN 'Alpha' WHEN contains(t, ' und die') OR contains(t, 'entint') THEN 'Beta' WHEN contains(t, 'tion ') THEN 'Gamma' ELSE {0} END"


@query("txt8_rule_classifier", f"SELECT doc_id, {_RULE_SQL.format('source')} AS label FROM (SELECT *, ' ' || replace(lower(text), 'ß', 'ss') || ' ' AS t FROM documents)")
def _(b):
    return b.table("documents").select("doc_id", T.classify_rules("text", RULES, F.col("source")).alias("label"))


@query("txt9_seniority_rules", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'Executive' WHEN contains(p_name, 'red') THEN 'Senior' ELSE 'Unknown' END AS seniority, 0.4::DOUBLE AS confidence FROM part")
def _(b):
    part = b.table("part").select("p_partkey", F.col("p_name").alias("title"), F.lit(None).cast("string").alias("role_family"), F.lit(None).cast("string").alias("description"))
    out = T.rule_classification(part, seniority_rules=[("Executive", ["ring"]), ("Senior", ["red"])])
    return out.select("p_partkey", F.col("rule_seniority").alias("seniority"), F.col("rule_confidence").alias("confidence"))


@query("txt6_grounding_limitations", """
SELECT d.doc_id, concat_ws(' ', 'Enrichment uses only the supplied job posting evidence.', CASE WHEN d.lang = 'en' THEN 'Capability and theme labels are semantic classifications, not strategic claims.' END,
  CASE WHEN c.sk > coalesce(s.sk, 0) OR c.te > coalesce(s.te, 0) THEN 'Unsupported provider extractions were excluded after deterministic grounding validation (' || (c.sk - coalesce(s.sk, 0)) || ' skills, ' || (c.te - coalesce(s.te, 0)) || ' technologies).' END) AS limitations
FROM documents d JOIN (SELECT doc_id, count(*) FILTER (field = 'skills') AS sk, count(*) FILTER (field = 'technologies') AS te FROM x_claims GROUP BY 1) c USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) FILTER (field = 'skills') AS sk, count(*) FILTER (field = 'technologies') AS te FROM x_support GROUP BY 1) s USING (doc_id)""")
def _(b):
    claims = _claims(b).withColumn("_line", T.token_line("text"))
    gone = lambda values: F.size(values) - F.size(T.ground_values(values, "_line"))
    notes = T.grounding_limitations(F.col("seniority_level") != "unknown", gone("skills"), gone("technologies"))
    return claims.select("doc_id", F.array_join(notes, " ").alias("limitations"))


@query("txt10_omitted_classifications", """
SELECT CAST(o_orderkey % 9 AS BIGINT) AS batch, count(*) AS missing, 'classification batch omitted ' || count(*) || ' jobs; heuristic fallback used' AS warning
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) GROUP BY 1""")
def _(b):
    return T.omitted_classifications(_merged(b).withColumn("batch", F.col("source_job_id").cast("long") % 9), ["batch"])


@query("txt10_merge_classifications", """
SELECT CAST(o_orderkey AS VARCHAR) AS source_job_id, CASE WHEN s.cap IS NULL THEN 'Other' WHEN s.cap = 'PROMO' THEN 'Promotion' ELSE s.cap END AS capability, s.cap IS NOT NULL AS supplied
FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(p_type, l_linenumber::BIGINT * 1000000000 + l_partkey) AS cap FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 30 GROUP BY 1) s ON l_orderkey = o_orderkey""")
def _(b):
    return _merged(b).select("source_job_id", "capability", (F.col("classification_source") == "llm").alias("supplied"))


def _merged(b):
    """Rule classifications of orders, replaced by supplied ones where a large line has some."""
    jobs = b.table("orders").select(F.col("o_orderkey").cast("string").alias("source_job_id"), F.lit("Other").alias("rule_capability"), F.lit("Unknown").alias("rule_seniority"), F.lit(0.4).alias("rule_confidence"))
    lines = b.table("lineitem").filter("l_quantity > 30").join(b.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    none = F.lit(None).cast("string")
    supplied = lines.select(
        F.col("l_orderkey").cast("string").alias("source_job_id"), (F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey")).alias("position"), F.col("p_type").alias("capability"),
        none.alias("business_unit"), none.alias("department"), F.split("p_name", " ").alias("skills"), F.array("p_brand").alias("technologies"), none.alias("seniority"), F.lit(0.8).alias("confidence"),
    )
    return T.merge_classifications(jobs, supplied, {"promo": "Promotion"})


view("x_words", "SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\pL\\pN_]+'), ' ') AS words FROM documents")


@query("txt11_excerpt_grounding", """
SELECT c.doc_id, c.kind, CASE WHEN c.kind = 'own' THEN length(w.words) > 0 ELSE contains(w.words, 'the and of') END AS grounded FROM (SELECT doc_id, unnest(['own', 'phrase']) AS kind FROM documents) c JOIN x_words w USING (doc_id)""")
def _(b):
    docs = b.table("documents")
    own = docs.select("doc_id", F.lit("own").alias("kind"), F.upper(F.substring("text", 1, 200)).alias("excerpt"))
    phrase = docs.select("doc_id", F.lit("phrase").alias("kind"), F.lit("The, AND -- of").alias("excerpt"))
    cited = own.unionByName(phrase).withColumn("citation_id", F.concat_ws("-", "doc_id", "kind"))
    return T.excerpt_grounded(cited, docs.select("doc_id", F.col("text").alias("source_text")), "citation_id", "doc_id").select("doc_id", "kind", "grounded")


@query("txt12_unsafe_claims", "SELECT conv_id, turn, regexp_matches(regexp_replace(lower(text), '\\s+', ' ', 'g'), '(?:^|[^\\pL\\pN_])(?:of the|que la|und[^\\pL\\pN_](?:.{0,78}[^\\pL\\pN_])?(?:der|die))(?:[^\\pL\\pN_]|$)') AS unsafe FROM conversations")
def _(b):
    return b.table("conversations").select("conv_id", "turn", T.unsafe_claim("text", [r"\bof the\b", r"\bque la\b", r"\bund\b.{0,80}\b(?:der|die)\b"]).alias("unsafe"))


@query("txt13_unsupported_narrowing", """
SELECT conv_id, turn, needs FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?:^|[^\\pL\\pN_])the[^\\pL\\pN_](?:.{0,118}[^\\pL\\pN_])?in(?:[^\\pL\\pN_]|$)') THEN 'cross_domain' WHEN regexp_matches(t, '(?:^|[^\\pL\\pN_])of(?:[^\\pL\\pN_]|$)') AND regexp_matches(t, '(?:^|[^\\pL\\pN_])and(?:[^\\pL\\pN_]|$)') THEN 'technology_scope' END AS needs
  FROM (SELECT *, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM conversations))
WHERE needs IS NOT NULL AND NOT (conv_id % 3 = 0 OR (conv_id % 3 = 1 AND needs = 'technology_scope'))""")
def _(b):
    talk = b.table("conversations")
    supports = talk.select("conv_id").distinct().filter("conv_id % 3 < 2").select(
        "conv_id", F.when(F.col("conv_id") % 3 == 1, F.lit("technology")).otherwise(F.lit("strategy")).alias("domain"), F.lit("derived_analytics").alias("support_class"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("strategy.get_signals")).otherwise(F.lit("technology.get_summary")).alias("tool_name"), F.when(F.col("conv_id") % 3 == 0, 2).otherwise(0).alias("signal_count"),
    )
    found = T.unsupported_narrowing(talk, supports, "conv_id", "text", technology=r"\bof\b", hiring=r"\band\b", assertion=r"\bthe\b.{0,120}\bin\b")
    return found.select("conv_id", "turn", "needs")


@query("txt14_mentions", """
SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(of the|der)([^\\pL\\pN_]|$)') THEN 'Alpha' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(die)([^\\pL\\pN_]|$)') THEN 'Beta' END) AS mentions,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(die)([^\\pL\\pN_]|$)') THEN 'Beta' ELSE '' END AS mismatch FROM conversations""")
def _(b):
    aliases = {"Alpha": ["of the", "der"], "Beta": ["die"]}
    return b.table("conversations").select("conv_id", "turn", F.array_join(T.mention_terms("text", aliases), ",").alias("mentions"), F.array_join(T.scope_mismatch("text", F.lit(" DER "), aliases), ",").alias("mismatch"))


@query("txt15_year_conflict", "SELECT o_orderkey, year(o_orderdate) % 2 = 0 AND o_orderkey % 2 = 0 AND year(o_orderdate) > 1999 AS conflict FROM orders")
def _(b):
    year = F.year("o_orderdate")
    title = F.concat(F.lit("Our "), year.cast("string"), F.lit(" Annual  Report"))
    path = F.concat(F.lit("/"), (year + F.when((year % 2 == 0) & (F.col("o_orderkey") % 2 == 0), 1).otherwise(0)).cast("string"), F.lit("/ir/annual-report.pdf"))
    return b.table("orders").select("o_orderkey", T.year_conflict(title, path).alias("conflict"))


@query("joi21_classification_input", """
SELECT CAST(page_id AS VARCHAR) AS source_job_id, CASE WHEN page_id % 3 = 0 THEN length(html) WHEN page_id % 3 = 1 THEN length(url) ELSE 0 END AS chars FROM pages""")
def _(b):
    pages = b.table("pages")
    jobs = pages.select(F.col("page_id").cast("string").alias("source_job_id"), F.when(F.col("page_id") % 3 < 2, F.col("url")).alias("description"))
    texts = pages.filter("page_id % 3 = 0").select(F.col("page_id").cast("string").alias("source_job_id"), F.col("html").alias("page_text"))
    return T.classification_input(jobs, texts).select("source_job_id", F.coalesce(F.length("classifier_text"), F.lit(0)).alias("chars"))
