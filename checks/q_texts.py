"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.registry import register
from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.operators.text_rules import content_evidence, text_scores

TEXTS = f"with {S.PLANTED_TEXTS}"
BANGS = "(length(text) - length(replace(text, '!', '')))"
UPPER = f"({S.hits('text', chr(92) + 'p{Lu}')}::double / greatest(1, {S.hits('text', chr(92) + 'pL')}))"
CAPS = "len(list_filter(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda t: t = upper(t)))"


def _content_rule(code):
    _, sev, cat, base, pattern = K.CONTENT_RULES[code]
    n = S.hits("lower(text)", pattern)
    return (f" select doc_id, '{code}' as code, '{sev}' as severity, '{cat}' as category, "
            f"least(28, {base} + (n - 1) * 2)::int as score_impact, "
            f"round(least(0.95::double, 0.66::double + n * 0.05::double), 6) as confidence "
            f"from (select doc_id, {n} as n from pt) where n > 0")


@register("content_evidence", TEXTS + " union all ".join(_content_rule(c) for c in K.CONTENT_RULES) + f"""
 union all select doc_id, 'content-emotional-amplification', 'low', 'social-engineering', 8, 0.62::double
 from pt where {BANGS} >= 6 or {UPPER} >= 0.32""")
def content(spark, sf):
    return content_evidence(I.planted_texts(spark, sf), ["doc_id"]).select(
        "doc_id", "code", "severity", "category", "score_impact", F.round("confidence", 6).alias("confidence"))


def _sub(key):
    pattern, base, _, _ = K.TEXT_SCORE_RULES[key]
    n = S.hits("lower(text)", pattern)
    return f"case when {n} > 0 then least(36, {base} + ({n} - 1) * 4) else 0 end as {key}"


SUB = ", ".join(_sub(k) for k in K.TEXT_SCORE_RULES)
KEYS = list(K.TEXT_SCORE_RULES) + ["emotional_pressure"]
SCORES = f"""{TEXTS}, s as (
  select doc_id, {SUB}, case when {BANGS} >= 6 then 5 else 0 end + case when {CAPS} >= 3 then 6 else 0 end as emotional_pressure
  from pt)"""
ISSUE_COUNT = " + ".join(f"({k} > 0)::int" for k in KEYS)


@register("text_scores", f"""{SCORES}
select doc_id, least(100, {' + '.join(KEYS)})::int as text_score,
  round(0.42::double + least(0.45::double, ({ISSUE_COUNT}) * 0.07::double), 2) as text_confidence, 'rules-only' as text_mode,
  {', '.join(f'{k}::int as {k}' for k in KEYS)} from s""")
def scores(spark, sf):
    df = text_scores(I.planted_texts(spark, sf), ["doc_id"])
    return df.select("doc_id", "text_score", "text_confidence", "text_mode",
                     *[F.col("text_sub_scores")[k].alias(k) for k in KEYS])


_NAMES = {k: f"nlp-{k}" for k in K.TEXT_SCORE_RULES} | {"emotional_pressure": K.PRESSURE_ISSUE[0]}
_SEV = {k: v[2] for k, v in K.TEXT_SCORE_RULES.items()} | {"emotional_pressure": "low"}


@register("text_issues", SCORES + " union all ".join(
    f" select doc_id, '{_NAMES[k]}' as code, '{_SEV[k]}' as severity from s where {k} > 0" for k in KEYS))
def issues(spark, sf):
    df = text_scores(I.planted_texts(spark, sf), ["doc_id"])
    return df.select("doc_id", F.explode("text_issues").alias("i")).select("doc_id", "i.code", "i.severity")


@register("text_stats", f"""{TEXTS}
select doc_id, {BANGS} as exclamations, round({UPPER}, 6) as uppercase_ratio, {CAPS} as all_caps_tokens from pt""")
def stats(spark, sf):
    t = F.col("text")
    return I.planted_texts(spark, sf).select(
        "doc_id", T.count_of(t, "!").alias("exclamations"),
        F.round(T.uppercase_ratio(t), 6).alias("uppercase_ratio"), T.all_caps_tokens(t).alias("all_caps_tokens"))


CONTEXT = {1: "please enter the 6-digit code", 2: "Sign in with your account", 3: "Enable notifications here",
           4: "use your authenticator app"}


@register("context_flags", f"""
with t as (select doc_id, text || ' ' || {S.case('doc_id % 6', {k: S.text(v) for k, v in CONTEXT.items()}, "''")} as text from documents)
select doc_id, {S.any_of('lower(text)', K.OAUTH_TEXT_HINTS)} as oauth_context, {S.any_of('lower(text)', K.MFA_HINTS)} as mfa_context,
  {S.any_of('lower(text)', K.NOTIFICATION_HINTS)} as notification_context from t""")
def context(spark, sf):
    from webrisk.operators.evidence import with_context_flags

    d = I.table(spark, sf, "documents")
    df = d.select(
        "doc_id", F.concat_ws(" ", "text", I.cases(F.col("doc_id") % 6, CONTEXT, F.lit(""))).alias("text"),
        F.lit("https://www.example.com/").alias("normalized_url"))
    return with_context_flags(df, "text").select(
        "doc_id", "oauth_context", "mfa_context", "notification_context")


def _row(inner: str, bucket: str, seq: int, rel: str = "0.74::double") -> str:
    return (f"select page_id, {seq} as seq, '{bucket}' as bucket, '{bucket}' as source, code, '' as title, severity, "
            f"category, score_impact as impact, confidence as conf, {rel} as rel, '' as descr from ({inner})")


def _text_sql() -> str:
    """Text-only scoring in SQL: content rules, text score, suppression, fusion."""
    from checks import q_evidence as QE

    url = "'local-text-analysis.invalid'"
    host = " union all ".join(
        _row(f"select page_id, '{c}' as code, '{K.URL_RULES[c][1]}' as severity, '{K.URL_RULES[c][2]}' as category, {K.URL_RULES[c][3]} as score_impact, {K.URL_RULES[c][4]}::double as confidence from pt where {w}", "url", i)
        for i, (c, w) in enumerate({
            "url-high-entropy-host": f"{S.entropy(url)} >= 4.2",
            "url-medium-entropy-host": f"{S.entropy(url)} >= 3.7 and {S.entropy(url)} < 4.2"}.items()))
    content = " union all ".join(
        _row(_content_rule(c).replace("doc_id", "page_id"), "content", 200 + i) for i, c in enumerate(K.CONTENT_RULES))
    content += " union all " + _row(
        f"select page_id, 'content-emotional-amplification' as code, 'low' as severity, 'social-engineering' as category, 8 as score_impact, 0.62::double as confidence from pt where {BANGS} >= 6 or {UPPER} >= 0.32", "content", 250)
    nlp = " union all ".join(
        _row(f"select page_id, '{_NAMES[k]}' as code, '{_SEV[k]}' as severity, 'language-anomaly' as category, {K.ISSUE_IMPACT[_SEV[k]]} as score_impact, 0.72::double as confidence from sc where {k} > 0",
             "content", 300 + i, "0.68::double") for i, k in enumerate(KEYS))
    flags = " + ".join(
        f"coalesce(max(case when bucket = 'content' and code in {S.lst(codes)} then 1 else 0 end), 0) * {p}" for _, codes, p, _ in K.NARRATIVE)
    return f"""with p_t as (select doc_id as page_id, text || ' ' || {S._PHRASE} as text from documents), pt as (select * from p_t),
sc as (select page_id, {SUB}, case when {BANGS} >= 6 then 5 else 0 end + case when {CAPS} >= 3 then 6 else 0 end as emotional_pressure from pt),
ts as (select page_id, ({' + '.join(KEYS)})::int as total, least(100, {' + '.join(KEYS)})::int as text_score, round(0.42::double + least(0.45::double, ({ISSUE_COUNT}) * 0.07::double), 2) as text_conf from sc),
pg as (select page_id, '' as url, false as trusted, 0 as hops, {S.any_of('lower(text)', K.OAUTH_TEXT_HINTS)} as oauth, {S.any_of('lower(text)', K.MFA_HINTS)} as mfa,
    {S.any_of('lower(text)', K.NOTIFICATION_HINTS)} as notif, false as analytics, 0 as cal, 0.0::double as url_conf, text_score, text_conf, 0 as intel, 0.0::double as intel_conf, total as language
  from pt join ts using (page_id)),
ev0 as ({host} union all {content}), {QE.suppression_steps("ev0")},
ev as (select page_id, seq, bucket, source, code, title, severity, category, impact, conf, rel, descr from s6 union all {nlp}
  union all select page_id, 402, 'model', 'model', 'model-text-scam-likelihood', '', case when text_score >= 70 then 'high' when text_score >= 45 then 'medium' else 'low' end,
    'nlp-model', greatest(3, floor(text_score * 0.24::double))::int, greatest(0.2::double, least(0.99::double, text_conf)), greatest(0.3::double, least(0.95::double, text_conf)), '' from pg where text_score > 0),
{QE.FUSION_STEPS},
nr as (select vd.page_id, any_value(language) as language, {flags} as points from vd left join ev using (page_id) group by vd.page_id)
select page_id as doc_id, risk_score, classification, confidence, text_score::int as text_score, least(100, least(100, nr.language) + points)::int as coercion_score
from vd join nr using (page_id)"""


@register("score_texts", _text_sql())
def text_verdicts(spark, sf):
    from webrisk.plans.score import score_texts

    return score_texts(I.planted_texts(spark, sf), ["doc_id"]).select(
        "doc_id", "risk_score", "classification", "confidence", "text_score", "coercion_score")
