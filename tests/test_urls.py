"""Website rules against plain Python, on edge cases and generated text."""

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.functions import urls as U


def apply(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string").repartition(4)
    return [r.v for r in rows.select("i", column(F.col("u")).alias("v")).orderBy("i").collect()]


# Addresses that name a host, and texts that do not.
ACCEPTED = [
    "example.com", " Example.COM/ ", "not a url", "HTTPS://A.b", "ftp://a", "a:b", "[::1]", "http://[::1]:80/x",
    "http://[v1.a]", "http://[::ffff:1.2.3.4]", "http://[::1%eth]", "ht\ttps:///x", "x\ny", "\x1fa.com\x1f",
    "http://[1:2:3:4:5:6:7::]", "http://[1:2:3:4:5:6:7:8]", "http://u@[::1]", "café.fr", "😀.io", "https://a b/c",
]
REJECTED = [
    None, "", "   ", " \u3000", "https://", "http://", "https:///x", "/x", "?q", "#t", "http:// ", "[abc", "x]y.com",
    "http://[1:2:3]", "http://[]", "http://[1.2.3.4]", "℀.com", "a／b", "：", "http://\t/x", "http://[1::2::3]",
    "http://[12345::]", "http://]x[",
]


def test_written_out_answers(spark):
    rows = [(u, True) for u in ACCEPTED] + [(u, False) for u in REJECTED]
    assert list(zip([u for u, _ in rows], apply(spark, U.is_valid_website, [u for u, _ in rows]))) == rows


# Each example is a whole table of texts, so a failing one is not shrunk.
GENERATED = settings(
    max_examples=4, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck)
)
PIECES = ["http://", "https://", "www.", "a", "B.com", "/", "?", "#", ":", "@", "[", "]", "::1", " ", "\t", "\n", " ", "℀", "é", "%", "1.2.3.4"]


TEXTS = st.lists(st.lists(st.sampled_from(PIECES), max_size=7).map("".join), min_size=200, max_size=300)


@GENERATED
@given(TEXTS)
def test_scheme_and_outer_space_do_not_matter(spark, values):
    bare = [v.strip() for v in values if not v.strip().lower().startswith(("http:", "https:"))]
    forms = [bare, [f" {b}\t" for b in bare], [b.upper() if b.isascii() else b for b in bare]]
    answers = [apply(spark, U.is_valid_website, f) for f in forms]
    assert answers[0] == answers[1] == answers[2]
    filled = [b for b in bare if b]
    assert apply(spark, U.is_valid_website, [f"https://{b}" for b in filled]) == apply(spark, U.is_valid_website, filled)


@GENERATED
@given(TEXTS)
def test_what_follows_the_host_does_not_matter(spark, values):
    """A host ends at the first delimiter, so any tail may follow it, and none may stand for it."""
    hosts = [v for v in values if v.strip() == v != "" and not set(v) & set("/?#")]
    plain = apply(spark, U.is_valid_website, [f"https://{h}" for h in hosts])
    for tail in ("/", "/a]b", "?x=[", "#℀"):
        assert apply(spark, U.is_valid_website, [f"https://{h}{tail}" for h in hosts]) == plain
        assert not any(apply(spark, U.is_valid_website, [f"https://{tail}{h}" for h in hosts]))


def test_scheme_is_case_sensitive_and_untrimmed(spark):
    values = ["a.com", "http://a", "https://a", "HTTP://a", " http://a", ""]
    wanted = ["https://a.com", "http://a", "https://a", "https://HTTP://a", "https:// http://a", "https://"]
    assert apply(spark, U.with_scheme, values) == wanted


def test_domain(spark):
    values = ["https://www.a.com/", "http://a.com//", "awww.x", "a.com/p/", "https://http://a", "www.www.a", "ahttps://b"]
    wanted = ["a.com", "a.com", "ax", "a.com/p", "a", "a", "ab"]
    assert apply(spark, U.domain, values) == wanted


@GENERATED
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=7).map("".join), min_size=200, max_size=300))
def test_domain_generated(spark, values):
    wanted = [u.replace("https://", "").replace("http://", "").replace("www.", "").rstrip("/") for u in values]
    assert apply(spark, U.domain, values) == wanted


def test_blank_and_strip(spark):
    values = ["", " ", "  a \x1f", " ", "a"]
    assert apply(spark, U.is_blank, values) == [not v.strip() for v in values]
    assert apply(spark, U.strip, values) == [v.strip() for v in values]
