"""Text rules with literal expected values."""

import html

import pytest
from pyspark.sql import functions as F

from kinmatch.functions import page as P
from kinmatch.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_join_items_keeps_blank_but_not_empty(spark):
    items = F.array(F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit(" "), F.lit("b"))
    assert one(spark, T.join_items(items)) == "a,  , b"


def test_preview(spark):
    assert one(spark, T.preview(F.lit("x" * 100))) == "x" * 100
    assert one(spark, T.preview(F.lit("x" * 101))) == "x" * 100 + "..."


def test_placeholders(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, T.or_placeholder(empty, True)) == "[Not enough information]"
    assert one(spark, T.or_placeholder(F.array(F.lit("a"), F.lit("b")), True)) == "a, b"
    assert one(spark, T.or_placeholder(F.lit(""))) == "[Not enough information]"
    assert one(spark, T.or_placeholder(F.lit(" "))) == " "
    assert one(spark, T.or_placeholder(F.lit(None).cast("array<string>"), True, T.NO_SOURCES)) == "No sources provided"


def test_dates(spark):
    assert one(spark, T.format_date(T.parse_date(F.lit("2024-02-29")))) == "2024-02-29"
    assert one(spark, T.parse_date(F.lit("no date"), on_error="null")) is None
    with pytest.raises(Exception, match="CANNOT_PARSE|could not be parsed"):
        one(spark, T.parse_date(F.concat(F.lit("no "), F.col("id").cast("string"))))


def test_names(spark):
    assert one(spark, T.name_slug(F.lit("Café & Co-Op_1, Inc."))) == "caféco" + "op_1inc"
    kinds = {"PulseAI": "tech", "DevStack": "developer", "Cloudy": "modern", "Ripple": "standard", "MetaDataOps": "tech"}
    for name, kind in kinds.items():
        assert one(spark, T.name_kind(F.lit(name))) == kind
    site = T.website_from_name(F.lit("Acme Technologies"), F.lit("tech"), F.lit(5), F.lit(4))
    assert one(spark, site) == "acmetech.tech"
    assert one(spark, T.website_from_name(F.lit("Acme"), F.lit("standard"), F.lit(1), F.lit(9))) == "getacme.com"


def test_padded_never_cuts(spark):
    assert one(spark, T.padded("org_", F.lit(42))) == "org_00042"
    assert one(spark, T.padded("org_", F.lit(1234567))) == "org_1234567"


def test_html_text(spark):
    page = """<html><head><title>T</title></head><body><script>var a="<b>";</script><!-- no -->
    <p>a&amp;b &lt;i&gt;<br>c</p><STYLE>x{}</STYLE></body></html>"""
    assert one(spark, T.html_text(F.lit(page))) == "a&b <i> c"
    assert one(spark, T.html_element(F.lit("<h1 class='x'>A &amp; <b>B</b></h1>"), "h1")) == "A & B"


def test_references_as_browsers_decode_them(spark):
    texts = [
        "a &amp;lt; b &#65;&#x1F600; &eacute;&hellip;&apos;", "&#150;&#8211;&#x2019;", "&nosuch; &amp &;", "no reference", "", "&", "&#0;&#xD800;",
        "&lt;&gt;&quot;&nbsp;|" * 300,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in rows.select("i", P.decode_references(F.col("t")).alias("d")).collect()}
    for i, t in enumerate(texts[:6] + texts[7:]):
        i = i if i < 6 else i + 1
        # A name without its semicolon is left alone here.
        want = html.unescape(t) if i != 2 else t.replace("&amp;", "&")
        assert got[i] == want
    assert got[6] == "��"


LONG = "one two three four five six seven eight nine ten eleven <b>twelve</b>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<nav><a href=x>Home</a> <a>About us</a></nav><h1>Title</h1><p>{LONG}<p>short tail</p><footer>&copy; 2024</footer>",
         "Title\none two three four five six seven eight nine ten eleven twelve\nshort tail"),
        (f"<div><a href='y'>{LONG}</a></div><p>menu</p>", "menu"),
        (f"<ul><li>a<li>b</ul><table><tr><td>{LONG}", "b\none two three four five six seven eight nine ten eleven twelve"),
        ("<p>only</p><p>short &mdash; blocks</p>", "only\nshort — blocks"),
        (f"<p>x<!-- {LONG} --></p><script>{LONG}</script>", "x"),
        ("<a>open link <p>then text", "then text"),
        ("<div <p>>< a", ">< a"),
        ("\x01\x02\x03", ""),
        ("", ""),
        (None, None),
    ],
)
def test_main_text(spark, page, text):
    rows = spark.createDataFrame([(page,)], "html string")
    assert rows.select(P.main_text(F.col("html"))).first()[0] == text
