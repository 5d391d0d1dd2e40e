"""Page queries."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.registry import register
from webrisk import catalogs as K
from webrisk.operators.dom_rules import dom_evidence
from webrisk.operators.html import page_elements, page_text
from webrisk.operators.page_features import page_features_30
from webrisk.plans.score import ScoreOptions, score_pages, threat_report

PAGES = f"with {S.PLANTED_PAGES}"
COUNTED = ["form", "input", "iframe", "meta", "a", "li", "h1", "p", "div", "script"]


@register("page_elements", PAGES + " union all ".join(
    f" select page_id, '{t}' as tag, {S.hits('html', '<' + t + '(?:[ ][^>]*)?>')}::bigint as n from pp where {S.hits('html', '<' + t + '(?:[ ][^>]*)?>')} > 0"
    for t in COUNTED))
def elements(spark, sf):
    e = page_elements(I.planted_pages(spark, sf))
    return e.filter(F.col("tag").isin(COUNTED)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@register("page_forms", PAGES + """
select page_id, case page_id % 16 when 2 then 2 when 6 then 2 when 7 then 2 else 1 end::bigint as inputs_in_forms,
  case page_id % 16 when 5 then 1 else 0 end::bigint as hidden_inputs
from pp where page_id % 16 between 1 and 7""")
def page_forms(spark, sf):
    e = page_elements(I.planted_pages(spark, sf)).filter("tag = 'input' and form_seq is not null")
    return e.groupBy("page_id").agg(
        F.count("*").alias("inputs_in_forms"), F.count_if("hidden").alias("hidden_inputs"))


STRIP = "regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(1), 'g'), '<[^>]*>', chr(1), 'g')"


# character references as HTML reads them: the longest known name, whose semicolon some names may lack
NAMES = sorted(html5, key=lambda n: (-len(n), n))
CHARS = f"map([{', '.join(S.text(n) for n in NAMES)}], [{', '.join(S.text(html5[n]) for n in NAMES)}])"
NAMED = f"regexp_extract(p, {S.text('^(?:' + '|'.join(NAMES) + ')')})"
DECODED = f"""array_to_string(list_transform(string_split(x, '&'), lambda p, i: case when i = 1 then p
  when {NAMED} = '' then '&' || p else chars[{NAMED}] || substr(p, length({NAMED}) + 1) end), '')"""


@register("page_text", f"""
with names as materialized (select {CHARS} as chars)
select page_id, array_to_string(list_filter(list_transform(string_split({STRIP}, chr(1)),
  lambda x: trim({DECODED})), lambda x: x <> ''), ' ') as page_text from pages, names""")
def text_of_pages(spark, sf):
    return page_text(I.table(spark, sf, "pages"))


EXPECTED = {
    1: ["dom-credential-form-blank-action"], 2: ["dom-external-credential-post"],
    4: ["dom-hidden-credential-form"], 5: ["dom-hidden-password-field"],
    6: ["dom-invisible-login-overlay"], 7: ["dom-multiple-credential-forms"],
    8: ["dom-iframe-abuse", "dom-invisible-iframe"],
    9: ["dom-meta-refresh-redirect", "dom-scripted-redirect-logic"], 10: ["dom-external-script-load"],
    11: ["dom-obfuscated-javascript", "dom-scripted-redirect-logic", "dom-suspicious-event-listeners"],
    12: ["dom-clipboard-manipulation", "dom-notification-abuse", "dom-anti-user-interaction",
         "dom-forced-fullscreen-attempt", "dom-deceptive-popup-pattern"],
    13: ["dom-brand-impersonation-cues", "dom-account-suspension-language", "dom-urgency-banner-language"],
    14: ["dom-fake-modal-injection"], 15: ["dom-excessive-hidden-elements"],
}


def _dom_rows() -> str:
    rows = [(k, c, "true") for k, codes in EXPECTED.items() for c in codes]
    rows.append((3, "dom-downgraded-form-post", "starts_with(url, 'https://')"))
    return " union all ".join(
        f" select page_id, '{c}' as code, '{K.DOM_RULES[c][1]}' as severity, {K.DOM_RULES[c][3]} as score_impact, "
        f"{K.DOM_RULES[c][4]}::double as confidence from pages where page_id % 16 = {k} and {cond}"
        for k, c, cond in rows)


@register("dom_evidence", _dom_rows())
def dom_rules(spark, sf):
    return dom_evidence(I.planted_pages(spark, sf), ["page_id"]).select(
        "page_id", "code", "severity", "score_impact", "confidence")


# thirty features of the planted pages: hosts are plain, pages carry relative anchors only
LOWER_HTML_LINKS = "len(regexp_extract_all(lower(html), '<a href='))"
SHORT = K.FEATURES30_SHORTENERS.removeprefix("(?i)")
FEATURES = {
    "using_ip": "1", "long_url": "case when length(url) < 54 then 1 when length(url) <= 75 then 0 else -1 end",
    "short_url": f"case when regexp_matches(lower(url), {S.text(SHORT)}) then -1 else 1 end",
    "symbol": "case when contains(url, '@') then -1 else 1 end",
    "redirecting": "case when length(url) - strpos(reverse(url), '//') - 1 > 6 then -1 else 1 end",
    "prefix_suffix": "case when contains(host, '-') then -1 else 1 end",
    "sub_domains": "case when subs <= 1 then 1 when subs = 2 then 0 else -1 end",
    "https": "case when starts_with(url, 'https:') then 1 else -1 end", "domain_reg_len": "-1",
    "favicon": "-1", "non_std_port": "1", "https_domain_url": "case when contains(host, 'https') then -1 else 1 end",
    "request_url": "case page_id % 16 when 8 then 1 else 1 end",
    "anchor_url": "-1", "links_in_script_tags": "case page_id % 16 when 10 then 1 else -1 end",
    "server_form_handler": "case page_id % 16 when 1 then -1 when 2 then 0 when 3 then 1 when 4 then 0 when 5 then 0 when 6 then 0 when 7 then 0 else 1 end",
    "info_email": "-1", "abnormal_url": "-1", "website_forwarding": "1", "status_bar_cust": "-1",
    "disable_right_click": "case page_id % 16 when 12 then 1 else -1 end",
    "using_popup_window": "case page_id % 16 when 12 then 1 else -1 end", "iframe_redirection": "1",
    "age_of_domain": "-1", "dns_recording": "-1", "website_traffic": "0", "page_rank": "0", "google_index": "0",
    "links_pointing_to_page": f"case when {LOWER_HTML_LINKS} = 0 then 1 when {LOWER_HTML_LINKS} <= 2 then 0 else -1 end",
    "stats_report": "1",
}
RISKY = " + ".join(f"(f_{n} = -1)::int" for n in K.FEATURES30)
F30 = f"""{PAGES}, q as (
  select *, len(list_filter(string_split(host, '.'), lambda x: x <> 'www')) - 2 as subs from pp),
f as (select page_id, url, host, {', '.join(f'{v} as f_{k}' for k, v in FEATURES.items())} from q),
r as (select *, {RISKY} as risky,
  case when length(url) > 75 then 12 else 0 end + case when contains(url, '@') then 20 else 0 end
  + case when length(host) - length(replace(host, '-', '')) >= 3 then 12 else 0 end
  + case when f_https = -1 then 10 else 0 end as bonus from f),
g as (select *, least(0.95::double, 0.25::double + risky * 0.02::double) as p from r)"""


@register("page_features_30", F30 + " select page_id, " + ", ".join(f"f_{n}" for n in K.FEATURES30) + " from f")
def features30(spark, sf):
    return page_features_30(I.planted_pages(spark, sf), ["page_id"]).select(
        "page_id", *[f"f_{n}" for n in K.FEATURES30])


@register("url_score", F30 + f"""
select page_id, risky, case when f_https = -1 then 46 else 10 end as privacy_score, round(p, 6) as url_probability,
  least(100, round_even(round_even(p * 100, 0) * 0.75::double + bonus * 0.25::double, 0))::int as url_score,
  round(least(0.99, greatest(p, 0.35 + case when f_short_url = -1 then 0.08 else 0 end)), 2) as url_confidence
from (select * from g)""")
def url_score(spark, sf):
    df = page_features_30(I.planted_pages(spark, sf), ["page_id"])
    risky = sum((F.when(F.col(f"f_{n}") == -1, 1).otherwise(0) for n in K.FEATURES30), F.lit(0))
    return df.select(
        "page_id", risky.alias("risky"), "privacy_score",
        F.round("url_probability", 6).alias("url_probability"), "url_score", "url_confidence")


@register("url_issues", F30 + """
select page_id, code, count(*)::bigint as n from (
  select page_id, 'shortener' as code from f where f_short_url = -1
  union all select page_id, 'hyphenated-host' from f where f_prefix_suffix = -1
  union all select page_id, 'many-subdomains' from f where f_sub_domains = -1
  union all select page_id, 'non-https' from f where f_https = -1
  union all select page_id, 'non-https' from f where f_https = -1
  union all select page_id, 'mailto' from f
  union all select page_id, 'double-slash' from f where f_redirecting = -1
  union all select page_id, 'long-url' from f where length(url) > 75
  union all select page_id, 'hyphenated-host' from f where length(host) - length(replace(host, '-', '')) >= 3)
group by all""")
def url_issues(spark, sf):
    df = page_features_30(I.planted_pages(spark, sf), ["page_id"])
    return df.select("page_id", F.explode("url_issues").alias("i")).groupBy(
        "page_id", F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


@register("domain_age", """
select user_id, event_id,
  (year(coalesce(e, date '2025-06-15')) - year(c)) * 12 + month(coalesce(e, date '2025-06-15')) - month(c) as months
from (select event_id, user_id, cast(ts as date) - (event_id % 900)::int as c,
  case when event_id % 3 = 0 then cast(ts as date) + (event_id % 700)::int end as e from events)""")
def domain_age(spark, sf):
    from webrisk.operators.page_features import domain_age_months

    e = I.table(spark, sf, "events")
    day = F.to_date("ts")
    created = F.date_sub(day, (F.col("event_id") % 900).cast("int"))
    expires = F.when(F.col("event_id") % 3 == 0, F.date_add(day, (F.col("event_id") % 700).cast("int")))
    return e.select("user_id", "event_id", domain_age_months(
        created, expires, F.lit("2025-06-15").cast("date")).cast("long").alias("months"))


def _page_sql() -> str:
    """The whole page pipeline in SQL, from page source to verdict."""
    from checks import q_evidence as QE
    from checks import q_texts as QT
    from checks import q_urls as QU

    strip = STRIP.replace("from pages", "from pp")
    clean = (f"array_to_string(list_filter(list_transform(string_split({strip}, chr(1)), lambda x: trim(replace(replace("
             f"replace(replace(x, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'))), lambda x: x <> ''), ' ')")
    columns = "page_id, {seq} as seq, '{bucket}' as bucket, '{bucket}' as source, {code} as code, '' as title, {sev} as severity, {cat} as category, {impact} as impact, {conf} as conf, {rel} as rel, '' as descr"

    def rows(inner: str, bucket: str, seq: int, rel: str = "0.74::double") -> str:
        return "select " + columns.format(
            seq=seq, bucket=bucket, code="code", sev="severity", cat="category", impact="score_impact",
            conf="confidence", rel=rel) + f" from ({inner})"

    url_rows = " union all ".join(
        rows(QU._url_rule(c, w), "url", i) for i, (c, w) in enumerate(QU.URL_CONDITIONS.items()))
    dom = [(k, c, "true") for k, codes in EXPECTED.items() for c in codes]
    dom.append((3, "dom-downgraded-form-post", "starts_with(url, 'https://')"))
    order = list(K.DOM_RULES)
    dom_rows = " union all ".join(
        rows(f"select page_id, '{c}' as code, '{K.DOM_RULES[c][1]}' as severity, '{K.DOM_RULES[c][2]}' as category, {K.DOM_RULES[c][3]} as score_impact, {K.DOM_RULES[c][4]}::double as confidence from pages where page_id % 16 = {k} and {cond}",
             "dom", 100 + order.index(c)) for k, c, cond in dom)
    content = " union all ".join(
        rows(QT._content_rule(c).replace("doc_id", "page_id"), "content", 200 + i) for i, c in enumerate(K.CONTENT_RULES))
    content += " union all " + rows(
        f"select page_id, 'content-emotional-amplification' as code, 'low' as severity, 'social-engineering' as category, 8 as score_impact, 0.62::double as confidence from pt where {QT.BANGS} >= 6 or {QT.UPPER} >= 0.32", "content", 250)
    issue = "select page_id, '{code}' as code, '{sev}' as severity, '{cat}' as category, {impact} as score_impact, 0.72::double as confidence from {src} where {cond}"
    nlp = " union all ".join(
        rows(issue.format(code=QT._NAMES[k], sev=QT._SEV[k], cat="language-anomaly", impact=K.ISSUE_IMPACT[QT._SEV[k]], src="sc", cond=f"{k} > 0"),
             "content", 300 + i, "0.68::double") for i, k in enumerate(QT.KEYS))
    model_issues = [
        ("short_url", "f_short_url = -1"), ("redirecting", "f_redirecting = -1"), ("prefix_suffix", "f_prefix_suffix = -1"),
        ("sub_domains", "f_sub_domains = -1"), ("https", "f_https = -1"), ("info_email", "true"),
    ]
    score_issues = [("long", "length(url) > 75"), ("hyphens", "length(host) - length(replace(host, '-', '')) >= 3"), ("non_https", "f_https = -1")]
    found = [(K.URL_MODEL_ISSUES[n], c) for n, c in model_issues] + [(K.URL_SCORE_ISSUES[n], c) for n, c in score_issues]
    url_issue_rows = " union all ".join(
        rows(issue.format(code=i[0], sev=i[3], cat="url-model", impact=K.ISSUE_IMPACT[i[3]], src="g", cond=c),
             "model", 420 + n, "0.68::double") for n, (i, c) in enumerate(found))
    f30 = F30.removeprefix("with ")
    keys = " + ".join(QT.KEYS)
    weak = S.lst(K.MODEL_BEHAVIOR_CODES)
    return f"""with {f30}, pu as (select page_id, url from pages), {S.PIECES.strip()},
pt as (select page_id, html, {clean} as text from pp),
sc as (select page_id, {QT.SUB}, case when {QT.BANGS} >= 6 then 5 else 0 end + case when {QT.CAPS} >= 3 then 6 else 0 end as emotional_pressure from pt),
ts as (select page_id, least(100, {keys})::int as text_score, round(0.42::double + least(0.45::double, ({QT.ISSUE_COUNT}) * 0.07::double), 2) as text_conf from sc),
us as (select page_id, least(100, round_even(round_even(p * 100, 0) * 0.75::double + bonus * 0.25::double, 0))::int as url_score,
    round(least(0.99, greatest(p, 0.35 + case when f_short_url = -1 then 0.08 else 0 end)), 2)::double as url_conf from g),
p00 as (select pt.page_id, pages.url, false as trusted, 0 as hops, {S.any_of('lower(text)', K.OAUTH_TEXT_HINTS)} as oauth,
    {S.any_of('lower(text)', K.MFA_HINTS)} as mfa, {S.any_of('lower(text)', K.NOTIFICATION_HINTS)} as notif,
    {S.any_of('lower(pt.html)', K.ANALYTICS_WORDS)} as analytics, url_score, url_conf, text_score, text_conf, 0 as intel, 0.0::double as intel_conf, 0 as language
  from pt join pages using (page_id) join ts using (page_id) join us using (page_id)),
ev0 as ({url_rows} union all {dom_rows} union all {content}),
{QE.suppression_steps("ev0").replace("join pg using", "join p00 using")},
ca as (select page_id, count(*) filter (severity in ('high', 'critical')) as nsev, count(*) filter (code in {weak}) > 0 as beh from s6 group by page_id),
cb as (select p00.*, case coalesce(nsev, 0) when 0 then {S.rint('url_score * 0.45::double')} when 1 then {S.rint('url_score * 0.68::double')} when 2 then {S.rint('url_score * 0.9::double')} else url_score end as d, coalesce(beh, false) as beh from p00 left join ca using (page_id)),
pg as (select * exclude (d, beh), {S.rint('(case when beh then d else least(d, 20) end) * 0.82::double')} as cal from cb),
ev as (select page_id, seq, bucket, source, code, title, severity, category, impact, conf, rel, descr from s6
  union all {nlp}
  union all select page_id, 400, 'model', 'model', 'model-url-phishing-probability', '', case when cal >= 80 then 'critical' when cal >= 60 then 'high' when cal >= 40 then 'medium' else 'low' end,
    'url-model', greatest(2, floor(cal * 0.24::double))::int, greatest(0.2::double, least(0.99::double, url_conf)), greatest(0.3::double, least(0.98::double, url_conf)), '' from pg
  union all select page_id, 401, 'model', 'model', 'model-url-fallback', '', 'medium', 'runtime', 9, 0.74::double, 0.6::double, '' from pg
  union all select page_id, 402, 'model', 'model', 'model-text-scam-likelihood', '', case when text_score >= 70 then 'high' when text_score >= 45 then 'medium' else 'low' end,
    'nlp-model', greatest(3, floor(text_score * 0.24::double))::int, greatest(0.2::double, least(0.99::double, text_conf)), greatest(0.3::double, least(0.95::double, text_conf)), '' from pg where text_score > 0
  union all {url_issue_rows}),
{QE.FUSION_STEPS},
pl as (select page_id, string_agg(pattern, ',' order by rank) as patterns from pat group by page_id)
select page_id, url, 'ok' as status, risk_score, classification, confidence, coalesce(patterns, '') as patterns, n_top::int as evidence_rows,
  phishing_probability, dom_suspicion, content_scam_score, redirect_risk, cal::int as calibrated_url_score
from vd left join pl using (page_id)"""


PAGE_SQL = _page_sql()


@register("score_pages", PAGE_SQL)
def scored(spark, sf):
    return score_pages(I.planted_pages(spark, sf), options=ScoreOptions()).select(
        "page_id", "url", "status", "risk_score", "classification", "confidence",
        F.array_join(F.transform("attack_patterns", lambda p: p["code"]), ",").alias("patterns"),
        F.size("top_evidence").alias("evidence_rows"), "phishing_probability", "dom_suspicion",
        "content_scam_score", "redirect_risk", "calibrated_url_score")


@register("threat_report", f"select page_id, classification as threat_level, evidence_rows, patterns, dom_suspicion::varchar as dom_suspicion from ({PAGE_SQL})")
def report(spark, sf):
    scored_pages = score_pages(I.planted_pages(spark, sf), options=ScoreOptions(with_timeline=True))
    r = F.from_json("report", (
        "threat_report struct<threat_level:string,evidence:array<struct<code:string>>,"
        "attack_patterns:array<struct<code:string>>,component_scores:struct<dom_suspicion:string>>"))["threat_report"]
    return threat_report(scored_pages, ["page_id"]).select("page_id", r.alias("r")).select(
        "page_id", "r.threat_level", F.size("r.evidence").alias("evidence_rows"),
        F.array_join("r.attack_patterns.code", ",").alias("patterns"),
        F.col("r.component_scores.dom_suspicion").alias("dom_suspicion"))
