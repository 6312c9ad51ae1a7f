import datetime
import hashlib
import json
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from signalloom.functions import dates as D, html as H, ids as I, lexicons as L, numbers as N, text as X


def one(spark, value, expression, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(expression).first()[0]


@pytest.mark.parametrize("value,want", [("  Wells Fargo & Co. ", "wells_fargo_co"), ("Crédit Agricole", "credit_agricole"), ("ﬁn ½ Straße", "fin_12_strae"), ("!!", "")])
def test_slug_folds_accents(spark, value, want):
    assert one(spark, value, X.slug("v")) == want


def test_ascii_fold_equals_decomposition(spark):
    text = "".join(chr(c) for c in range(0x20, 0x3100) if not 0xD800 <= c <= 0xDFFF)
    want = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    assert one(spark, text, X.ascii_fold("v")) == want


def test_nfkc_matches_python(spark):
    for text in ["plain", "é", "é", "ﬁ ① Å", "ｆｕｌｌ"]:
        assert one(spark, text, X.nfkc("v")) == unicodedata.normalize("NFKC", text)


def test_slug_without_folding_keeps_separators(spark):
    assert one(spark, "Société É Straße", X.slug("v", fold_accents=False)) == "soci_t_strasse"


def test_strip_equals_python(spark):
    text = " \x1f\xa0 a b 　\t\n"
    assert one(spark, text, X.strip("v")) == text.strip()
    assert one(spark, "a \xa0b\n\nc ", X.squash("v")) == "a b c"


def test_display_name(spark):
    assert one(spark, " wells_fargo ", X.display_name("v", L.DISPLAY_NAMES)) == "Wells Fargo"
    assert one(spark, "o'neil_3m_bank", X.display_name("v", {})) == "O'NEIL 3M BANK".title()


def test_repair_text(spark):
    assert one(spark, "CafÃ© â€“ x", X.repair_text("v")) == "Café – x"
    assert one(spark, "Âé broken", X.repair_text("v")) == "Âé broken"


def test_canonical_urls(spark):
    assert one(spark, "HTTPS://WWW.Example.com/Jobs/1/?a=b#c", X.canonical_url("v")) == "https://www.example.com/Jobs/1"
    assert one(spark, "HTTPS://WWW.Example.com/Jobs/1/?a=b#c", X.canonical_url("v", strip_www=True)) == "https://example.com/Jobs/1"
    assert one(spark, "https://www.x.com/a/", X.canonical_url("v", True, False)) == "x.com/a"
    assert one(spark, "not a url?x", X.canonical_url("v")) == "not a url"


def test_uuid5_and_hashes(spark):
    for text in ["abc", "job:v1:wells_fargo|csv_import|R-1", "ü"]:
        assert one(spark, text, I.uuid5("v")) == str(uuid.uuid5(uuid.NAMESPACE_URL, text))
    row = {"title": 'a "q"', "description": "x\u001f\n/é\\u001F", "location": "l", "country": "US", "posted_date": "2026-01-01", "source_url": "u"}
    want = hashlib.sha256(json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    assert frame.select(I.content_hash()).first()[0] == want


@pytest.mark.parametrize("value", [66.67, 100.0, 37.3333333333, 1234567.0, 0.000123456, 999999.7, 0.0, 2.5, 12.0])
def test_general_format(spark, value):
    assert one(spark, value, N.general_format("v"), "v double") == f"{value:g}"


def test_percentage_matches_python_rounding(spark):
    frame = spark.range(1, 200).selectExpr("id AS a").crossJoin(spark.range(1, 60).selectExpr("id AS b"))
    for a, b, got in frame.select("a", "b", N.pct("a", "b")).collect():
        assert got == round(a / b * 100, 2)
    assert one(spark, 3, N.pct("v", F.lit(0)), "v int") == 0.0


def test_half_even_matches_python(spark):
    values = [0.545, 2.675, 1.005, 0.125, 0.375, -0.545, -2.5, 12.345, 1e-9, 99.995, 0.285, 1234.5675] + [i / 1000 + 0.0005 for i in range(400)]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    for value, two, three, none in frame.select("v", N.half_even("v", 2), N.half_even("v", 3), N.half_even("v", 0)).collect():
        assert (two, three, none) == (round(value, 2), round(value, 3), round(value))


def test_dates(spark):
    assert one(spark, "2026-08-03T10:00", D.iso_date("v")) == datetime.date(2026, 8, 3)
    assert one(spark, "2026", D.iso_date("v")) is None
    assert one(spark, "2026-02-30", D.iso_date("v")) is None
    assert one(spark, "2026-08-03 ", D.iso_date("v", exact=True)) == datetime.date(2026, 8, 3)
    for text, want in (("Posting End Date: 2026-09-01", datetime.date(2026, 9, 1)), ("posting end date : 9/1/2026", datetime.date(2026, 9, 1)), ("Posting End Date: 09/01/26", datetime.date(2026, 9, 1)), ("Posting End Date: soon", None)):
        assert one(spark, text, D.parse_closing(F.array("v"))) == want
    assert one(spark, "Posting End Date: soon", D.closing_rejected(F.array("v"))) is True
    assert one(spark, "2026-08-05", D.week_start(F.to_date("v"))) == datetime.date(2026, 8, 3)


def test_locations(spark):
    assert one(spark, "Austin, TX / Charlotte, NC", X.cities("v")) == ["Austin", "Charlotte"]
    assert one(spark, "Bengaluru, Karnataka, India", X.regions("v", F.lit("IN"))) == ["Karnataka"]
    assert one(spark, "London, United Kingdom", X.regions("v", F.lit("GB"))) == []
    assert one(spark, "Toronto", X.join_locations("v", F.array(F.lit(" Toronto "), F.lit("Paris")))) == "Toronto / Paris"


def test_tail_excerpt_preview(spark):
    assert one(spark, "Build things. \nExplore More Jobs A B", X.strip_tail("v", L.RELATED_MARKERS)) == "Build things."
    assert one(spark, "x" * 600, X.excerpt_ellipsis("v")) == "x" * 497 + "..."
    assert one(spark, "a  b " * 100, X.preview("v")) == ("a b " * 100).strip()[:277] + "..."


def test_enums(spark):
    values = F.array(F.lit("AI/ML"), F.lit("data & analytics"), F.lit("nonsense"), F.lit("machine learning"))
    assert one(spark, "x", X.normalize_enum_array(values, L.CAPABILITIES)) == ["Artificial Intelligence / Machine Learning", "Data & Analytics"]
    assert one(spark, "Vice  President", X.normalize_enum("v", L.SENIORITIES, "unknown")) == "director"


PAGE = """<html><head><style>p{}</style><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Thing","JobPosting"],"title":"Engineer",
"description":"<p>Build &amp; run</p>","datePosted":"2026-08-01","other":1}]}</script><script>var a="</p>";</script></head><body><p>Hello&nbsp;there</p><svg>no</svg><div>World</div></body></html>"""


def test_html(spark):
    assert one(spark, PAGE, H.visible_text("v")) == "Hello there World"
    assert json.loads(one(spark, PAGE, H.extract_json_ld("v"))) == {"title": "Engineer", "datePosted": "2026-08-01"}
    assert one(spark, "<p>A &amp; B</p><br><div>  C\t\tD </div>", H.html_to_text("v")) == "A & B\n C D"
    clean = H.clean_pages(spark.createDataFrame([(1, PAGE), (2, "<p>short</p>")], "id long, html string"), "id", "html", minimum=8).orderBy("id").collect()
    assert (clean[0]["text"], clean[0]["status"]) == ("Build & run", "completed")
    assert (clean[1]["text"], clean[1]["status"]) == (None, "failed")
