"""URL evidence: thirteen rules over the pieces of a URL, one scan, one array per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.functions import urls as U
from webrisk.operators.signals import extracted, explode_signals, fired


def with_url_context(df: DataFrame, url: str = "url") -> DataFrame:
    """Add normalized_url, URL pieces, domain split and the URL metadata columns."""
    df = df.withColumn("normalized_url", U.with_scheme(F.coalesce(F.col(url), F.lit(""))))
    df = U.split_url(df, "normalized_url")
    df = df.withColumn("_sfx_host", U.suffix_source_host(F.col("normalized_url")))
    df = U.split_domain(df, "_sfx_host").drop("_sfx_host")
    host, path, query = F.col("hostname"), F.col("path"), F.col("query")
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.coalesce(
            F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)), F.regexp_extract(p, "^([^=]*)", 1)
        ),
    )
    df = df.withColumns({
        "tld": F.lower(F.regexp_extract(F.col("suffix"), r"([^.]*)$", 1)),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "subdomain_depth": U.subdomain_depth(F.col("subdomain")),
        "_host_entropy": T.shannon_entropy(host),
        "unicode_host": host.rlike(r"[^\x00-\x7F]"),
        "punycode_host": host.contains("xn--"),
        "typosquat_candidate": U.typosquat_brand(F.col("domain")),
        "suspicious_query_params": F.filter(keys, lambda k: F.lower(k).isin(K.SUSPICIOUS_QUERY_KEYS)),
        "encoded_octets": F.regexp_count(F.col("normalized_url"), F.lit("%[0-9a-fA-F]{2}")),
        "long_encoded_segment": F.exists(
            F.split(path, "/"), lambda s: (F.length(s) >= 24) & s.rlike(r"^[A-Za-z0-9_\-]+=*$")
        ),
        "path_depth": F.size(T.non_empty_parts(path, "/")),
        "is_ip": U.is_ip_host(host),
    })
    return df.withColumn("hostname_entropy", T.py_round(F.col("_host_entropy"), 3))


def with_url_signals(df: DataFrame) -> DataFrame:
    """Add ``url_signals`` to a table prepared by :func:`with_url_context`."""

    def rule(code, *, severity=None, impact=None, title=None, description=None, value=None):
        r = K.URL_RULES[code]
        return extracted(
            code, title if title is not None else r[0],
            description if description is not None else r[5],
            severity if severity is not None else r[1], "url", r[2],
            impact if impact is not None else r[3], r[4], value=value,
        )

    host, url, entropy = F.col("hostname"), F.col("normalized_url"), F.col("_host_entropy")
    depth, octets, params = F.col("subdomain_depth"), F.col("encoded_octets"), F.col("suspicious_query_params")
    deep = depth >= 5
    heavy = octets >= 14
    shown = F.array_join(F.slice(F.array_sort(F.array_distinct(params)), 1, 5), ", ")

    def text(code, *args):
        return F.format_string(K.URL_RULES[code][5], *args)

    rules = [
        (F.col("is_ip"), rule("url-ip-host")),
        (F.col("scheme") != "https", rule("url-non-https")),
        (url.contains("@"), rule("url-at-symbol")),
        (F.lower(F.col("base_domain")).isin(K.SHORTENER_DOMAINS) | host.isin(K.SHORTENER_DOMAINS),
         rule("url-shortener")),
        (depth >= 3, rule(
            "url-excessive-subdomains",
            severity=F.when(deep, "high").otherwise("medium"),
            impact=F.when(deep, K.SUBDOMAINS_HIGH_IMPACT).otherwise(K.URL_RULES["url-excessive-subdomains"][3]),
            description=text("url-excessive-subdomains", depth), value=depth)),
        (entropy >= 4.2, rule("url-high-entropy-host", value=F.col("hostname_entropy"))),
        ((entropy >= 3.7) & (entropy < 4.2), rule("url-medium-entropy-host", value=F.col("hostname_entropy"))),
        (F.col("tld").isin(K.RULE_SUSPICIOUS_TLDS), rule(
            "url-suspicious-tld", description=text("url-suspicious-tld", F.col("tld")), value=F.col("tld"))),
        (F.col("unicode_host") | F.col("punycode_host"), rule("url-idn-spoof-risk")),
        (F.col("typosquat_candidate").isNotNull(), rule(
            "url-typosquat-pattern",
            title=F.format_string(K.URL_RULES["url-typosquat-pattern"][0], F.col("typosquat_candidate")),
            value=F.col("typosquat_candidate"))),
        (F.size(params) >= 2, rule(
            "url-suspicious-query-params", description=text("url-suspicious-query-params", shown))),
        ((octets >= 8) | F.col("long_encoded_segment"), rule(
            "url-encoded-payload",
            severity=F.when(heavy, "high").otherwise("medium"),
            impact=F.when(heavy, K.ENCODED_HIGH_IMPACT).otherwise(K.URL_RULES["url-encoded-payload"][3]))),
        (F.col("path_depth") >= 6, rule(
            "url-deep-path", description=text("url-deep-path", F.col("path_depth")))),
    ]
    return df.withColumn("url_signals", fired(rules))


def url_evidence(df: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """Long table of URL evidence, one row per fired rule."""
    scored = with_url_signals(with_url_context(df, url))
    return explode_signals(scored, keys, ["url"])
