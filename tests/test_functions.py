"""Column functions against plain Python."""

import math
from collections import Counter
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webrisk.functions import text as T
from webrisk.functions import urls as U
from webrisk.operators.url_features import url_features_16, url_features_40

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
URL_CHARS = "abzAZ09-._~:/?#[]@!$&'()*+,;=%é"


def entropy(s):
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if s else 0.0


@SLOW
@given(st.lists(st.text(alphabet=URL_CHARS, max_size=40), min_size=40, max_size=40))
def test_entropy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string").withColumn("e", T.shannon_entropy(F.col("s")))
    for r in df.collect():
        assert r.e == pytest.approx(entropy(r.s), abs=1e-9)


@SLOW
@given(st.lists(
    st.tuples(st.sampled_from(["http://", "https://", "//", "ftp:", ""]), st.text(alphabet=URL_CHARS, max_size=30)),
    min_size=40, max_size=40))
def test_split_matches_urllib(spark, parts):
    urls = [a + b for a, b in parts]
    df = U.split_url(spark.createDataFrame([(u,) for u in urls], "url string"))
    for r in df.collect():
        try:
            p = urlparse(r.url)
        except ValueError:
            continue
        assert (r.scheme, r.netloc, r.path, r.query, r.fragment) == (
            p.scheme, p.netloc, p.path, p.query, p.fragment), r.url
        if "[" in p.netloc or "%" in p.netloc:
            continue
        assert r.hostname == (p.hostname or ""), r.url
        try:
            assert (r.port, r.bad_port) == (p.port, False), r.url
        except ValueError:
            assert r.bad_port, r.url


@SLOW
@given(st.lists(st.floats(min_value=-50, max_value=50), min_size=50, max_size=50))
def test_py_round(spark, values):
    values = values + [0.125, 2.675, 0.615, -0.375, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", T.py_round(F.col("x"), 2).alias("two"), T.py_round(F.col("x"), 3).alias("three"))
    for r in df.collect():
        assert r.two == round(r.x, 2) and r.three == round(r.x, 3)


@pytest.mark.parametrize("url,name,want", [
    ("https://x.y.z.example.org", "subdomain_count", 3.0),
    ("https://example.com", "subdomain_count", 0.0),
    ("https://www.example.com", "subdomain_count", 1.0),
    ("https://example.com?a=1&b=2&c=3", "query_param_count", 3.0),
    ("https://example.com/", "path_depth", 0.0),
    ("https://example.com/a/b/c", "path_depth", 3.0),
    ("https://example.tk", "tld_category", 2.0),
    ("https://example.com", "tld_category", 0.0),
    ("https://example.uk", "tld_category", 1.0),
    ("https://g00gle.com", "homoglyph_risk_score", 3.0),
    ("https://bcdfg.com", "vowel_consonant_ratio", 0.0),
    ("http://192.168.1.1/x", "ip_address_usage", 1.0),
    ("http://[2001:db8::1]/x", "ip_address_usage", 1.0),
    ("https://example.com:8080", "port_specification", 1.0),
    ("https://example.com:443", "port_specification", 0.0),
    ("https://my-long-token.example.com", "domain_token_count", 1.0),
    ("https://pay-pal-login.com", "domain_token_count", 3.0),
    ("https://example.com:99999/x", "url_length", 0.0),
    ("https://example.com:99999/x", "https_usage", 1.0),
])
def test_features_16(spark, url, name, want):
    row = url_features_16(spark.createDataFrame([(url,)], "url string")).first()
    assert row[name] == want


@pytest.mark.parametrize("url,name,want", [
    ("https://example.com", "query_param_count", 1.0),
    ("https://example.com?a=1", "query_param_count", 2.0),
    ("https://example.com?a=1&b=2", "query_param_count", 2.0),
    ("https://example.com", "path_depth", 1.0),
    ("https://EXAMPLE.com", "hostname_mixed_case", 0.0),
    ("https://login-verify.example.com", "phishing_keyword_count", 2.0),
    ("https://example.co.uk", "tld_length", 5.0),
    ("https://a/" + "b" * 20, "has_base64_like", 1.0),
    ("https://bit.ly/x", "uses_url_shortener", 1.0),
    ("https://h:81/x:443", "has_uncommon_port", 1.0),
    ("mailto:x", "host_dot_count", 0.0),
])
def test_features_40(spark, url, name, want):
    row = url_features_40(spark.createDataFrame([(url,)], "url string")).first()
    assert row[name] == want


@pytest.mark.parametrize("url,want", [
    ("https://www.google.com", "google.com"), ("http://stock.example.net:8081/list", "stock.example.net"),
    ("HTTPS://WWW.Example.COM/a", "example.com"), ("example.com/path", "example.com"),
])
def test_normalize_domain(spark, url, want):
    row = spark.createDataFrame([(url,)], "u string").select(U.normalize_domain(F.col("u"))).first()
    assert row[0] == want


def test_malformed_filter_keeps_ftp(spark):
    urls = ["https://valid.com", "http://also.valid/x", "no-scheme.com", "http://", "://x", "ftp://f.example.com"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").filter(U.is_well_formed(F.col("url")))
    assert sorted(r.url for r in df.collect()) == ["ftp://f.example.com", "http://also.valid/x", "https://valid.com"]


@pytest.mark.parametrize("before,after,want", [
    ("https://a.example/x", "https://a.example/x", False),
    ("https://a.example/x", "https://b.example/x", True),
    ("https://a.example/x", "https://accounts.google.com/x", False),
    ("https://a.example/x", "https://a.example/login", True),
    ("https://a.example/login", "https://a.example/login?next=1", False),
    ("https://a.example/x", "about:blank", True),
])
def test_suspicious_redirect(spark, before, after, want):
    row = spark.createDataFrame([(before, after)], "b string, a string").select(
        U.is_suspicious_redirect(F.col("b"), F.col("a"))).first()
    assert row[0] is want


def test_typosquat(spark):
    want = {"paypa1": "paypal", "paypal": None, "mypaypal": "paypal", "microsoftonline": None,
            "gogle": "google", "example": None, "metaapple": "apple"}
    df = spark.createDataFrame([(k,) for k in want], "d string").select("d", U.typosquat_brand(F.col("d")).alias("b"))
    assert {r.d: r.b for r in df.collect()} == want


def test_anchors_are_necessary():
    assert T.anchors(r"\b(urgent|within \d+ (hours?|minutes?))\b") == ["urgent", "within "]
    assert T.anchors(r"eval\s*\(|\\x[0-9a-f]{2}|window\.open") == ["eval", "\\x", "window.open"]
