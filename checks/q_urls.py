"""URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.registry import register
from webrisk import catalogs as K
from webrisk.functions import urls as U
from webrisk.operators.typosquat import with_imitated_brand
from webrisk.operators.url_features import url_features_16, url_features_40
from webrisk.operators.url_rules import url_evidence, with_url_context

RAW = """
raw as (
  select page_id, case page_id % 7
    when 0 then '  ' || url || ' ' when 1 then regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)
    when 2 then '' when 3 then 'ftp://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/f'
    when 4 then 'http://User:Pw@WWW.' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || ':81/P?q=1'
    when 5 then 'https:///x' else url end as raw
  from pages)"""


def raw_urls(spark, sf):
    p = I.table(spark, sf, "pages")
    h = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return p.select("page_id", I.cases(F.col("page_id") % 7, {
        0: F.concat(F.lit("  "), F.col("url"), F.lit(" ")), 1: h, 2: "",
        3: F.concat(F.lit("ftp://"), h, F.lit("/f")),
        4: F.concat(F.lit("http://User:Pw@WWW."), h, F.lit(":81/P?q=1")), 5: "https:///x",
    }, F.col("url")).alias("raw"))


@register("url_normalize", f"""
with {RAW},
a as (select page_id, trim(raw) as t, raw from raw),
b as (select *, case when t = '' then null when regexp_matches(t, '^https?://') then t else 'https://' || t end as n from a),
c as (select *, case when regexp_extract(n, '^[a-z]+://([^/?#]*)', 1) <> '' then n end as url from b)
select page_id, url as lenient, url as strict,
  case when regexp_matches(raw, '^https?://') then raw else 'https://' || raw end as scan_form,
  regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^([^:]*)', 1) as domain,
  regexp_replace(lower(regexp_extract(case when regexp_extract(raw, '^ *[a-z]+://([^/?#]*)', 1) <> ''
      then regexp_extract(raw, '^ *[a-z]+://([^/?#]*)', 1)
      when contains(raw, '://') then '' else regexp_extract(raw, '^([^/]*)', 1) end, '^([^:]*)', 1)), '^www[.]', '') as dedupe_domain
from c""")
def url_normalize(spark, sf):
    raw = F.col("raw")
    url = U.normalize_url(raw)
    return raw_urls(spark, sf).select(
        "page_id", url.alias("lenient"), U.normalize_url_strict(raw).alias("strict"),
        U.with_scheme(raw).alias("scan_form"), U.extract_domain(url).alias("domain"),
        U.normalize_domain(raw).alias("dedupe_domain"))


@register("url_split", S.URLS + """
select page_id, scheme, netloc, host as hostname, port, path, query, fragment from u""")
def url_split(spark, sf):
    return U.split_url(I.planted_urls(spark, sf)).select(
        "page_id", "scheme", "netloc", "hostname", "port", "path", "query", "fragment")


@register("domain_split", S.URLS + """
select page_id, subdomain, domain, suffix,
  case when suffix = '' then domain else domain || '.' || suffix end as base_domain from u""")
def domain_split(spark, sf):
    df = I.planted_urls(spark, sf).withColumn("h", U.suffix_source_host(F.col("url")))
    return U.split_domain(df, "h").select("page_id", "subdomain", "domain", "suffix", "base_domain")


#: Host ending per page_id % 18, and how many of its labels are the suffix.
ENDINGS = [
    ("photography", 1), ("co.za", 2), ("nsw.edu.au", 3), ("museum", 1), ("k12.ma.us", 3), ("pvt.k12.ma.us", 4), ("gouv.fr", 2), ("berlin", 1),
    ("com.br", 2), ("travel", 1), ("oxford.sch.uk", 3), ("foo.ck", 2), ("www.ck", 1), ("city.kawasaki.jp", 2), ("ward.kawasaki.jp", 3),
    ("xn--55qx5d.cn", 2), ("intern", 0), ("Co.UK", 2),
]


@register("domain_split_rules", f"""
with e as (select * from (values {', '.join(f"({i}, '{e}', {w})" for i, (e, w) in enumerate(ENDINGS))}) t(k, ending, wide)),
h as (select page_id, wide, string_split('shop.example' || (page_id % 7) || '.' || ending, '.') as l from pages join e on page_id % {len(ENDINGS)} = k)
select page_id, array_to_string(l[:len(l) - wide - 1], '.') as subdomain, l[len(l) - wide] as domain,
  coalesce(array_to_string(l[len(l) - wide + 1:], '.'), '') as suffix, array_to_string(l[len(l) - wide:], '.') as base_domain from h""")
def domain_split_rules(spark, sf):
    ending = F.element_at(F.array(*(F.lit(e) for e, _ in ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    df = I.table(spark, sf, "pages").select("page_id", F.concat(F.lit("shop.example"), (F.col("page_id") % 7).cast("string"), F.lit("."), ending).alias("h"))
    return U.split_domain(df, "h").select("page_id", "subdomain", "domain", "suffix", "base_domain")


BRAND_WORDS = """
dw as (select doc_id, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) between 5 and 12), lambda w: lower(w)) as words from documents),
br as (select distinct unnest(words) as brand from dw)"""


@register("typosquat_table", f"""with {BRAND_WORDS},
l as (select page_id, words[1] as b from pages join dw on doc_id = page_id where len(words) > 0),
t as (select page_id, case page_id % 6 when 0 then b when 1 then b[:2] || b[4:] when 2 then b[:2] || '0' || b[4:] when 3 then b[:3] || '1' || b[4:]
  when 4 then 'my' || upper(b) || 'shop' else 'q' || page_id || 'z' end as label from l),
m as (select page_id, label, min(brand) as first from t join br on contains(lower(label), brand) or levenshtein(lower(label), brand) <= 1 group by all)
select t.page_id, t.label, case when first <> lower(t.label) then first end as imitated_brand from t left join m on m.page_id = t.page_id""")
def typosquat_table(spark, sf):
    """Every word of the corpus with five to twelve letters is a brand; each page asks for one in six spellings."""
    words = F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]+)")), lambda w: F.length(w).between(5, 12))
    docs = I.table(spark, sf, "documents").select("doc_id", F.transform(words, F.lower).alias("words"))
    brands = docs.select(F.explode("words").alias("brand")).distinct()
    asked = I.table(spark, sf, "pages").select("page_id").join(
        docs.where(F.size("words") > 0).select(F.col("doc_id").alias("page_id"), F.col("words")[0].alias("b")), "page_id")
    b, page, tail = F.col("b"), F.col("page_id"), F.expr("substring(b, 4)")
    label = I.cases(page % 6, {
        0: b, 1: F.concat(F.substring("b", 1, 2), tail), 2: F.concat(F.substring("b", 1, 2), F.lit("0"), tail),
        3: F.concat(F.substring("b", 1, 3), F.lit("1"), tail), 4: F.concat(F.lit("my"), F.upper("b"), F.lit("shop")),
    }, F.concat(F.lit("q"), page.cast("string"), F.lit("z")))
    return with_imitated_brand(asked.select("page_id", label.alias("label")), "label", brands)


@register("malformed_filter", f"""
with {RAW}, g as (
  select case when regexp_matches(trim(raw), '^[a-z]+:') and not
    (regexp_matches(trim(raw), '^https?:') and regexp_extract(trim(raw), '^[a-z]+://([^/?#]*)', 1) = '')
    then 1 else 0 end as ok from raw)
select sum(ok)::bigint as kept_rows, sum(1 - ok)::bigint as filtered_rows from g""")
def malformed_filter(spark, sf):
    from webrisk.operators.prep import malformed_counts

    return malformed_counts(raw_urls(spark, sf).withColumnRenamed("raw", "url"))


@register("external_destination", S.URLS + """, t as (
  select page_id, host, case page_id % 5 when 0 then '/local' when 1 then 'https://' || host || '/x'
    when 2 then 'https://sub.' || host || '/x' when 3 then 'https://other.example.org/x'
    else '//' || array_to_string(labels[2:], '.') || '/x' end as target from u)
select page_id, target, case when regexp_extract(target, '^(?:[a-z]+:)?//([^/]*)', 1) = '' then false else
  not (th = host or ends_with(th, '.' || host) or ends_with(host, '.' || th)) end as is_external
from (select *, regexp_extract(target, '^(?:[a-z]+:)?//([^/]*)', 1) as th from t)""")
def external_destination(spark, sf):
    df = U.split_url(I.planted_urls(spark, sf))
    h = F.col("hostname")
    target = I.cases(F.col("page_id") % 5, {
        0: "/local", 1: F.concat(F.lit("https://"), h, F.lit("/x")),
        2: F.concat(F.lit("https://sub."), h, F.lit("/x")), 3: "https://other.example.org/x",
    }, F.concat(F.lit("//"), F.regexp_replace(h, r"^[^.]*\.", ""), F.lit("/x")))
    return df.select("page_id", target.alias("target"), "hostname").select(
        "page_id", "target", U.is_external(F.col("target"), F.col("hostname")).alias("is_external"))


F16 = {
    "url_length": "length(url)", "character_entropy": S.entropy("url"),
    "digit_ratio": f"{S.hits('url', '[0-9]')}::double / length(url)",
    "special_char_count": S.chars_in("url", K.SPECIAL_CHARS), "subdomain_count": "sub_n",
    "path_depth": "case when path in ('', '/') then 0 else length(path) - length(replace(path, '/', '')) end",
    "query_param_count": "case when query = '' then 0 else length(query) - length(replace(query, '&', '')) + 1 end",
    "tld_category": f"case when suffix in {S.lst(K.FEATURES16_SUSPICIOUS_TLDS)} then 2 when suffix in {S.lst(K.FEATURES16_GENERIC_TLDS)} then 0 when length(suffix) = 2 then 1 else 0 end",
    "domain_token_count": "len(list_filter(regexp_split_to_array(domain, '[-.]'), lambda x: x <> ''))",
    "longest_token_length": "coalesce(list_max(list_transform(regexp_split_to_array(domain, '[-.]'), lambda x: length(x))), 0)",
    "vowel_consonant_ratio": f"case when {S.hits('domain', '[b-df-hj-np-tv-z]')} = 0 then 0 else {S.hits('domain', '[aeiou]')}::double / {S.hits('domain', '[b-df-hj-np-tv-z]')} end",
    "homoglyph_risk_score": S.chars_in("domain", K.HOMOGLYPH_CHARS),
    "https_usage": "(scheme = 'https')::int", "ip_address_usage": "ip::int",
    "port_specification": "(coalesce(port, 80) not in (80, 443))::int",
    "url_entropy_normalized": f"{S.entropy('url')} / 5",
}


def r6(name, expr):
    return f"round(({expr})::double, 6) as {name}"


@register("url_features_16", S.URLS + " select page_id, " + ", ".join(r6(k, v) for k, v in F16.items()) + " from u")
def features16(spark, sf):
    df = url_features_16(I.planted_urls(spark, sf))
    return df.select("page_id", *[F.round(c, 6).alias(c) for c in K.FEATURES16])


def _cnt(x, ch):
    return f"length({x}) - length(replace({x}, '{ch}', ''))"


KEYWORDS = " + ".join(f"contains(lower(url), '{w}')::int" for w in K.PHISHING_KEYWORDS)
F40 = {
    "url_length": "length(url)", "url_length_normalized": "length(url) / 255.0::double",
    "url_digit_ratio": f"{S.hits('url', '[0-9]')}::double / length(url)",
    "url_special_char_count": S.chars_in("url", K.SPECIAL_CHARS),
    "url_dot_count": _cnt("url", "."), "url_hyphen_count": _cnt("url", "-"),
    "url_slash_count": _cnt("url", "/"), "url_underscore_count": _cnt("url", "_"),
    "url_entropy": S.entropy("url"), "url_entropy_normalized": f"{S.entropy('url')} / 5",
    "has_ip_like": "regexp_matches(url, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')::int",
    "has_base64_like": "regexp_matches(url, '[A-Za-z0-9+/=_-]{20}.')::int",
    "has_hex_encoded": "regexp_matches(url, '%[0-9A-Fa-f]{2}')::int", "uses_https": "starts_with(url, 'https')::int",
    "domain_length": "length(domain)", "domain_length_normalized": "length(domain) / 63.0::double",
    "domain_digit_ratio": f"{S.hits('domain', '[0-9]')}::double / greatest(length(domain), 1)",
    "domain_hyphen_count": _cnt("domain", "-"), "subdomain_count": "sub_n", "tld_length": "length(suffix)",
    "tld_suspicious": f"(suffix in {S.lst(K.FEATURES40_SUSPICIOUS_TLDS)})::int",
    "tld_legitimate": f"(suffix in {S.lst(K.FEATURES40_LEGITIMATE_TLDS)})::int",
    "domain_entropy": S.entropy("domain"), "path_length": "length(path)",
    "path_depth": f"greatest(1, {_cnt('path', '/')})",
    "path_entropy": f"case when path = '' then 0 else {S.entropy('path')} end",
    "has_query": "(query <> '')::int", "query_length": "length(query)",
    "query_param_count": f"greatest(1, {_cnt('query', '&')}) + (query <> '')::int",
    "query_has_redirect": S.any_of("lower(query)", K.REDIRECT_WORDS) + "::int",
    "query_has_url_param": S.any_of("lower(query)", ["http", "www"]) + "::int",
    "phishing_keyword_count": KEYWORDS, "has_phishing_keyword": f"(({KEYWORDS}) > 0)::int",
    "impersonates_known_brand": S.any_of("lower(url)", K.BRAND_WORDS) + "::int",
    "uses_url_shortener": S.any_of("host", K.FEATURES40_SHORTENERS) + "::int",
    "looks_obfuscated": f"({S.entropy('url')} > 4 and {S.chars_in('url', K.SPECIAL_CHARS)} > 3)::int",
    "has_uncommon_port": "(coalesce(nullif(regexp_extract(url, ':([0-9]+)', 1), ''), '80') not in ('80', '443'))::int",
    "hostname_mixed_case": "0", "hostname_has_digit": "regexp_matches(host, '[0-9]')::int",
    "host_dot_count": _cnt("host", "."),
}


@register("url_features_40", S.URLS + " select page_id, " + ", ".join(r6(k, F40[k]) for k in K.FEATURES40) + " from u")
def features40(spark, sf):
    df = url_features_40(I.planted_urls(spark, sf))
    return df.select("page_id", *[F.round(c, 6).alias(c) for c in K.FEATURES40])


DEPTH = "len(list_filter(string_split(subdomain, '.'), lambda x: x <> '' and x <> 'www'))"
OCTETS = S.hits("url", "%[0-9a-fA-F]{2}")
PARAMS = f"len(list_filter(string_split(query, '&'), lambda x: regexp_extract(x, '^([^=]*)', 1) in {S.lst(K.SUSPICIOUS_QUERY_KEYS)}))"
BRAND_CASE = "case " + " ".join(
    f"when domain = '{b}' then null when contains(domain, '{b}') or levenshtein(domain, '{b}') = 1 then '{b}'" for b in K.BRANDS) + " end"
TYPO = f"(case when domain in {S.lst(K.LEGIT_BRAND_TOKENS)} then null else {BRAND_CASE} end)"
URL_CONDITIONS = {
    "url-ip-host": "ip", "url-non-https": "scheme <> 'https'", "url-at-symbol": "contains(url, '@')",
    "url-shortener": f"(domain || '.' || suffix) in {S.lst(K.SHORTENER_DOMAINS)} or host in {S.lst(K.SHORTENER_DOMAINS)}",
    "url-excessive-subdomains": f"{DEPTH} >= 3", "url-high-entropy-host": f"{S.entropy('host')} >= 4.2",
    "url-medium-entropy-host": f"{S.entropy('host')} >= 3.7 and {S.entropy('host')} < 4.2",
    "url-suspicious-tld": f"suffix in {S.lst(K.RULE_SUSPICIOUS_TLDS)}",
    "url-idn-spoof-risk": "contains(host, 'xn--')", "url-typosquat-pattern": f"{TYPO} is not null",
    "url-suspicious-query-params": f"{PARAMS} >= 2",
    "url-encoded-payload": f"{OCTETS} >= 8 or len(list_filter(string_split(path, '/'), lambda x: regexp_full_match(x, '[A-Za-z0-9_-]+=*') and length(x) >= 24)) > 0",
    "url-deep-path": "len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= 6",
}


def _url_rule(code, condition):
    _, sev, cat, impact, conf, _ = K.URL_RULES[code]
    s, i = f"'{sev}'", str(impact)
    if code == "url-excessive-subdomains":
        s, i = f"case when {DEPTH} >= 5 then 'high' else 'medium' end", f"case when {DEPTH} >= 5 then 20 else 13 end"
    if code == "url-encoded-payload":
        s, i = f"case when {OCTETS} >= 14 then 'high' else 'medium' end", f"case when {OCTETS} >= 14 then 17 else 11 end"
    return f"select page_id, '{code}' as code, {s} as severity, '{cat}' as category, {i} as score_impact, {conf}::double as confidence, 0.74::double as reliability from u where {condition}"


@register("url_evidence", S.URLS + " union all ".join(_url_rule(c, w) for c, w in URL_CONDITIONS.items()))
def url_rules(spark, sf):
    return url_evidence(I.planted_urls(spark, sf), ["page_id"]).select(
        "page_id", "code", "severity", "category", "score_impact", "confidence", "reliability")


@register("url_metadata", S.URLS + f"""
select page_id, case when suffix = '' then domain else domain || '.' || suffix end as base_domain, suffix as tld,
  length(path) as path_length, length(query) as query_length, {DEPTH} as subdomain_depth,
  round({S.entropy('host')}, 3) as hostname_entropy, contains(host, 'xn--') as punycode_host,
  {TYPO} as typosquat_candidate, {PARAMS} as suspicious_params, {OCTETS} as encoded_octets from u""")
def url_metadata(spark, sf):
    return with_url_context(I.planted_urls(spark, sf)).select(
        "page_id", "base_domain", "tld", "path_length", "query_length", "subdomain_depth",
        "hostname_entropy", "punycode_host", "typosquat_candidate",
        F.size("suspicious_query_params").alias("suspicious_params"), "encoded_octets")


TRUST_HOSTS = {0: "notgoogle.com", 1: "services.gov.pk", 2: "portal.university.edu", 3: "metro-bus.example.com",
               4: "accounts.google.com", 5: "login.okta.com.example.net", 6: "zoom.us", 7: "www.ox.ac.uk"}


@register("domain_trust", f"""
with h as (select page_id, {S.case('page_id % 9', {k: S.text(v) for k, v in TRUST_HOSTS.items()}, 'lower(' + S.H + ')')} as host from pages),
f as (select *,
  case when regexp_matches(host, '[.](gov[.]pk|gov[.]uk|edu[.]pk|ac[.]uk|mil[.]pk|gov|edu|mil)$') then 55 else 0 end as a,
  case when regexp_matches(host, '({'|'.join(d.replace('.', '[.]') for d in K.TRUSTED_ENTERPRISE_DOMAINS)})$') then 42 else 0 end as b,
  case when {S.any_of('host', K.TRANSPORT_WORDS)} then 18 else 0 end as c,
  case when {S.any_of("('https://' || host || '/')", K.OAUTH_URL_HINTS)} then 22 else 0 end as d from h)
select page_id, host, least(100, a + b + c + d) as trust_score, least(100, a + b + c + d) >= 45 as is_trusted,
  case when b > 0 then 'trusted-provider' when a > 0 then 'public-sector' when c > 0 then 'transport-portal'
    when d > 0 then 'trusted-auth' else 'untrusted' end as trust_category from f""")
def domain_trust(spark, sf):
    from webrisk.operators.evidence import with_domain_trust

    p = I.table(spark, sf, "pages")
    host = I.cases(F.col("page_id") % 9, TRUST_HOSTS, U.url_host(F.col("url")))
    df = p.select("page_id", host.alias("host")).withColumn(
        "url", F.concat(F.lit("https://"), F.col("host"), F.lit("/")))
    return with_domain_trust(with_url_context(df)).select(
        "page_id", "host", "trust_score", "is_trusted", "trust_category")


def _score_sql() -> str:
    """URL-only scoring in SQL: no page is seen, so page features are neutral."""
    from checks import q_evidence as QE

    short = S.text(K.FEATURES30_SHORTENERS.removeprefix("(?i)"))
    bad = {
        "using_ip": "ip", "long_url": "length(url) > 75", "short_url": f"regexp_matches(lower(url), {short})",
        "symbol": "contains(url, '@')", "redirecting": "length(url) - strpos(reverse(url), '//') - 1 > 6",
        "prefix_suffix": "contains(host, '-')", "sub_domains": f"{DEPTH} > 2", "https": "scheme <> 'https'",
        "domain_reg_len": "true", "non_std_port": "port is not null", "https_domain_url": "contains(host, 'https')",
        "abnormal_url": "true", "status_bar": "true", "right_click": "true", "popup": "true", "iframe": "true",
        "age": "true", "dns": "true",
        "stats_report": "regexp_matches(replace(host, '.', ''), '^[0-9]+$') or suffix in " + S.lst(K.FEATURES30_TLDS),
    }
    risky = " + ".join(f"({c})::int" for c in bad.values())
    numeric = "regexp_matches(replace(host, '.', ''), '^[0-9]+$')"
    hyphens = "length(host) - length(replace(host, '-', '')) >= 3"
    issues = [(K.URL_MODEL_ISSUES[n], bad[n]) for n in (
        "using_ip", "short_url", "symbol", "redirecting", "prefix_suffix", "sub_domains", "https", "non_std_port", "stats_report")]
    issues += [(K.URL_SCORE_ISSUES["long"], "length(url) > 75"), (K.URL_SCORE_ISSUES["at"], bad["symbol"]),
               (K.URL_SCORE_ISSUES["hyphens"], hyphens), (K.URL_SCORE_ISSUES["non_https"], bad["https"]),
               (K.URL_SCORE_ISSUES["numeric"], numeric)]
    issue_rows = " union all ".join(
        f"select page_id, {420 + n}, 'model', 'model', '{i[0]}', '', '{i[3]}', 'url-model', {K.ISSUE_IMPACT[i[3]]}, 0.72::double, 0.68::double, '' from u where {c}"
        for n, (i, c) in enumerate(issues))
    url_rows = " union all ".join(
        f"select page_id, {n} as seq, 'url' as bucket, 'url' as source, code, '' as title, severity, category, score_impact as impact, confidence as conf, reliability as rel, '' as descr from ({_url_rule(c, w)})"
        for n, (c, w) in enumerate(URL_CONDITIONS.items()))
    return S.URLS + f""", us as (select page_id, url, least(0.95::double, 0.25::double + ({risky}) * 0.02::double) as p,
    (length(url) > 75)::int * 12 + ({bad['symbol']})::int * 20 + ({hyphens})::int * 12 + ({bad['https']})::int * 10 + ({numeric})::int * 18 as bonus,
    0.35::double + ip::int * 0.1::double + ({bad['short_url']})::int * 0.08::double + ({bad['symbol']})::int * 0.08::double as hint from u),
p00 as (select page_id, url, false as trusted, 0 as hops, false as oauth, false as mfa, false as notif, false as analytics,
    least(100, round_even(round_even(p * 100, 0) * 0.75::double + bonus * 0.25::double, 0))::int as url_score,
    {S.half_even('least(0.99::double, greatest(p, least(0.95::double, hint)))', 2)} as url_conf, 0 as text_score, 0.0::double as text_conf, 0 as intel, 0.0::double as intel_conf, 0 as language from us),
ev0 as ({url_rows}), {QE.suppression_steps("ev0").replace("join pg using", "join p00 using")},
ca as (select page_id, count(*) filter (severity in ('high', 'critical')) as nsev from s6 group by page_id),
cb as (select p00.*, least(20, case coalesce(nsev, 0) when 0 then {S.rint('url_score * 0.45::double')} when 1 then {S.rint('url_score * 0.68::double')} when 2 then {S.rint('url_score * 0.9::double')} else url_score end) as d from p00 left join ca using (page_id)),
pg as (select * exclude (d), {S.rint('d * 0.82::double')} as cal from cb),
ev as (select page_id, seq, bucket, source, code, title, severity, category, impact, conf, rel, descr from s6
  union all select page_id, 400, 'model', 'model', 'model-url-phishing-probability', '', 'low', 'url-model', greatest(2, floor(cal * 0.24::double))::int,
    greatest(0.2::double, least(0.99::double, url_conf)), greatest(0.3::double, least(0.98::double, url_conf)), '' from pg
  union all select page_id, 401, 'model', 'model', 'model-url-fallback', '', 'medium', 'runtime', 9, 0.74::double, 0.6::double, '' from pg
  union all {issue_rows}), {QE.FUSION_STEPS}
select page_id, 'ok' as status, risk_score, classification, confidence, url_score, cal::int as calibrated_url_score from vd"""


@register("score_urls", _score_sql())
def score_urls_query(spark, sf):
    from webrisk.plans.score import ScoreOptions, score_urls

    return score_urls(I.planted_urls(spark, sf), ["page_id"], ScoreOptions()).select(
        "page_id", "status", "risk_score", "classification", "confidence", "url_score", "calibrated_url_score")
