"""Evidence adjustment, fusion, verdict and timeline queries on planted evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.registry import register
from webrisk import catalogs as K
from webrisk.operators import evidence as E
from webrisk.operators import patterns, timeline, verdict
from webrisk.operators.signals import explode_signals, no_signals

SEV_RANK = "list_position(['info', 'low', 'medium', 'high', 'critical'], {})"


def _templates() -> str:
    rows = []
    for j, (b, src, code, title, sev, cat, impact, conf, rel, text) in enumerate(I.EVIDENCE):
        rows.append(f"({j}, '{b}', '{src}', '{code}', '{title}', '{sev}', '{cat}', {impact}, {conf}::double, {rel}::double, '{text}')")
    return "(values " + ", ".join(rows) + ") t(seq, bucket, source, code, title, severity, category, impact, conf, rel, descr)"


BLOB = "lower(code || ' ' || title || ' ' || descr || ' ' || category)"
BASE = f"""
pg as (select page_id, url, page_id % 6 = 0 as trusted, least(page_id % 5, 4) as hops,
    page_id % 2 = 0 as oauth, page_id % 3 = 0 as mfa, page_id % 4 = 0 as notif, page_id % 5 = 0 as analytics,
    page_id * 37 % 101 as url_score, page_id % 3 <> 0 as model_loaded, page_id * 13 % 90 as cal,
    (page_id % 64)::double / 64 as url_conf, page_id * 11 % 80 as text_score, (page_id % 32)::double / 32 as text_conf,
    page_id * 17 % 60 as intel, (page_id % 16)::double / 16 as intel_conf,
    page_id % 37 + page_id % 11 as language from pages),
ev as (select page_id, t.* from pages, {_templates()} where (page_id * (seq + 3) + seq * seq) % 5 < 2)"""


def _step(name, prev, hit, penalty, cut):
    low = S.case("severity", {"low": "'info'", "medium": "'low'", "high": "'medium'", "critical": "'high'"}, "'info'")
    return f"""
{name} as (select page_id, seq, bucket, source, code, title, category, descr,
    case when h then greatest(1, impact - {penalty}) else impact end as impact,
    case when h then greatest(0.2::double, {S.half_even(f'(conf - {cut}::double)', 2)}) else conf end as conf,
    case when h then greatest(0.35::double, {S.half_even('(rel - 0.08::double)', 2)}) else rel end as rel,
    case when h then {low} else severity end as severity, n + h::int as n
  from (select x.*, {hit} as h from {prev} x join pg using (page_id)))"""


_flags = {"oauth": "oauth", "mfa": "mfa", "notification": "notif", "analytics": "analytics"}


def suppression_steps(source: str = "ev") -> str:
    parts, prev = [f"s0 as (select *, 0 as n from {source})"], "s0"
    for i, (flag, codes, penalty, cut, _) in enumerate(K.SUPPRESS_DOM, 1):
        parts.append(_step(f"s{i}", prev, f"bucket = 'dom' and {_flags[flag]} and code in {S.lst(codes)}", penalty, cut))
        prev = f"s{i}"
    parts.append(f"calm as (select page_id, count(*) filter (bucket in ('dom', 'content') and severity in ('high', 'critical')) = 0 as calm from {prev} group by page_id)")
    codes, penalty, cut, _ = K.SUPPRESS_CONTENT
    parts.append(_step("s5", f"(select {prev}.*, calm from {prev} join calm using (page_id))",
                       f"bucket = 'content' and calm and code in {S.lst(codes)}", penalty, cut))
    penalty, cut, _ = K.SUPPRESS_TRUSTED
    words = "|".join(K.WEAK_WORDS_SUPPRESSION)
    parts.append(_step("s6", "s5", f"bucket in ('url', 'dom', 'content') and trusted and (code in {S.lst(K.WEAK_CODES)} or regexp_matches({BLOB}, '{words}'))", penalty, cut))
    return ", ".join(parts)


SUPPRESSION = f"with {BASE}, {suppression_steps()}"


@register("suppression", SUPPRESSION + """
select page_id, code, descr as description, severity, impact as score_impact, conf as confidence, rel as reliability
from s6 where bucket in ('url', 'dom', 'content')""")
def suppression(spark, sf):
    df = E.suppress(I.planted_evidence(spark, sf))
    return explode_signals(df, ["page_id"], ["url", "dom", "content"]).select(
        "page_id", "code", "description", "severity", "score_impact", "confidence", "reliability")


@register("suppression_records", SUPPRESSION + """
select page_id, coalesce(sum(n), 0)::int as downgrades from pages left join (select page_id, n from s6) using (page_id) group by page_id""")
def suppression_records(spark, sf):
    return E.suppress(I.planted_evidence(spark, sf)).select("page_id", F.size("suppressed").alias("downgrades"))


@register("url_score_calibration", f"""with {BASE},
c as (select page_id, count(*) filter (severity in ('high', 'critical')) as n, count(*) filter (code in {S.lst(K.MODEL_BEHAVIOR_CODES)}) > 0 as beh
  from ev where bucket in ('url', 'dom', 'content') group by page_id),
a as (select pg.page_id, model_loaded, coalesce(n, 0) as n, coalesce(beh, false) as beh,
  case when trusted then least(url_score, 35) else url_score end as s from pg left join c using (page_id)),
b as (select *, case n when 0 then {S.rint('s * 0.45::double')} when 1 then {S.rint('s * 0.68::double')} when 2 then {S.rint('s * 0.9::double')} else s end as d from a)
select page_id, case when model_loaded then e else {S.rint('e * 0.82::double')} end::int as calibrated_url_score
from (select *, case when beh then d else least(d, 20) end as e from b)""")
def calibration(spark, sf):
    df = I.planted_evidence(spark, sf).drop("calibrated_url_score")
    return E.calibrate_url_score(df).select("page_id", "calibrated_url_score")


@register("model_evidence", f"""with {BASE}
select page_id, 'model-url-phishing-probability' as code, case when cal >= 80 then 'critical' when cal >= 60 then 'high' when cal >= 40 then 'medium' else 'low' end as severity,
  greatest(2, floor(cal * 0.24::double))::int as score_impact, greatest(0.2::double, least(0.99::double, url_conf)) as confidence, greatest(0.3::double, least(0.98::double, url_conf)) as reliability from pg
union all select page_id, 'model-url-fallback', 'medium', 9, 0.74::double, 0.6::double from pg where not model_loaded
union all select page_id, 'model-text-scam-likelihood', case when text_score >= 70 then 'high' when text_score >= 45 then 'medium' else 'low' end,
  greatest(3, floor(text_score * 0.24::double))::int, greatest(0.2::double, least(0.99::double, text_conf)), greatest(0.3::double, least(0.95::double, text_conf)) from pg where text_score > 0
union all select page_id, 'model-text-runtime-warning', 'medium', 8, 0.7::double, 0.58::double from pg where text_score > 0""")
def model_rows(spark, sf):
    df = I.planted_evidence(spark, sf).withColumn("text_mode", F.lit("rules-only"))
    df = df.select("page_id", F.concat(E.url_model_rows(df), E.text_model_rows("artifact missing")).alias("r"))
    return df.select("page_id", F.explode("r").alias("s")).select(
        "page_id", "s.code", "s.severity", "s.score_impact", "s.confidence", "s.reliability")


@register("issue_evidence", f"""
select page_id, code, severity, {S.case('severity', {k: v for k, v in K.ISSUE_IMPACT.items()}, '8')} as score_impact,
  0.72::double as confidence, 0.68::double as reliability, 'url-model' as category
from pages, (values ('a', 'critical'), ('b', 'high'), ('c', 'medium'), ('d', 'low'), ('e', 'info')) t(code, severity)
where (page_id + ascii(code)) % 3 = 0""")
def issue_evidence(spark, sf):
    p = I.table(spark, sf, "pages")
    issues = F.array_compact(F.array(*[
        F.when((F.col("page_id") + ord(c)) % 3 == 0, F.struct(
            F.lit(c).alias("code"), F.lit("t").alias("title"), F.lit("d").alias("description"),
            F.lit(s).alias("severity")))
        for c, s in zip("abcde", ["critical", "high", "medium", "low", "info"])]))
    return p.select("page_id", F.explode(E.issue_rows(issues, "model", "url-model")).alias("s")).select(
        "page_id", "s.code", "s.severity", "s.score_impact", "s.confidence", "s.reliability", "s.category")


@register("append_new_codes", f"""with {BASE},
u as (select page_id, code, seq from ev where bucket = 'dom' union all select page_id, code, seq + 100 from ev where bucket = 'content'
  union all select page_id, code, seq + 200 from ev where bucket = 'content' union all select page_id, code, seq + 300 from ev where bucket = 'dom')
select page_id, code, count(*)::bigint as n from (
  select page_id, code from ev where bucket = 'dom'
  union all select distinct page_id, code from ev where bucket = 'content') group by all""")
def append_codes(spark, sf):
    df = I.planted_evidence(spark, sf)
    merged = E.append_new_codes(
        F.col("dom_signals"), F.concat("content_signals", "content_signals", "dom_signals"))
    return df.select("page_id", F.explode(merged).alias("s")).groupBy(
        "page_id", F.col("s.code").alias("code")).agg(F.count("*").alias("n"))


def _pattern_values() -> str:
    rows = [
        f"({i}, '{code}', '{title}', {base}::double, {need}, {str(single).lower()}, '{c}')"
        for i, (code, title, base, need, single, codes, _) in enumerate(K.ATTACK_PATTERNS) for c in codes
    ]
    return "(values " + ", ".join(rows) + ") pc(pattern_no, pattern, ptitle, base, need, single, code)"


PATTERNS = f"""
lastc as (select page_id, code, max_by(rel, seq) as rel, max_by(severity, seq) as sev from ev group by all),
pm as (select page_id, pattern_no, pattern, ptitle, base, need, single, count(*) as m,
    count(*) filter (sev in ('high', 'critical')) as hi, sum(rel order by code) / count(*) as avg_rel,
    string_agg(code, ',' order by code) as codes from {_pattern_values()} join lastc using (code) group by all),
pq as (select *, least(0.98::double, base + least(0.16::double, m * 0.035::double) + least(0.12::double, hi * 0.03::double)
    + (avg_rel - 0.65::double) * 0.18::double) as c from pm where m >= need or (single and m = 1 and hi > 0)),
pat as (select page_id, pattern_no, pattern, ptitle, {S.half_even('c', 2)} as confidence, codes,
    row_number() over (partition by page_id order by {S.half_even('c', 2)} desc, pattern_no) as rank
  from pq where not (c < 0.62 and m = 1) qualify rank <= 8)"""


@register("attack_patterns", f"with {BASE}, {PATTERNS} select page_id, rank::int as pattern_rank, pattern as code, confidence, codes from pat")
def attack_patterns(spark, sf):
    df = patterns.with_attack_patterns(I.planted_evidence(spark, sf))
    return patterns.explode_patterns(df, ["page_id"]).select(
        "page_id", "pattern_rank", "code", "confidence", F.array_join("evidence_codes", ",").alias("codes"))


def _narrative() -> str:
    flags = ", ".join(
        f"coalesce(count(*) filter (bucket in ('content', 'dom') and code in {S.lst(codes)}), 0) > 0 as {flag}"
        for flag, codes, _, _ in K.NARRATIVE)
    points = " + ".join(f"{flag}::int * {p}" for flag, _, p, _ in K.NARRATIVE)
    words = ", ".join(f"case when {flag} then '{w}' end" for flag, _, _, w in K.NARRATIVE)
    return f"""with {BASE}, n as (select pg.page_id, any_value(language) as language, {flags} from pg left join ev using (page_id) group by pg.page_id)
select page_id, {', '.join(f for f, _, _, _ in K.NARRATIVE)}, least(100, least(100, language) + {points})::bigint as coercion_score,
  case when len(list_filter([{words}], lambda x: x is not null)) > 0 then '{K.NARRATIVE_FOUND}' || array_to_string(list_filter([{words}], lambda x: x is not null), ', ') || '.' else '{K.NARRATIVE_NONE}' end as narrative_summary from n"""


@register("narrative", _narrative())
def narrative(spark, sf):
    df = patterns.with_narrative(I.planted_evidence(spark, sf))
    return df.select("page_id", *[f for f, _, _, _ in K.NARRATIVE],
                     F.col("coercion_score").cast("long").alias("coercion_score"), "narrative_summary")


MULT = S.case("severity", {k: f"{v}::double" for k, v in K.SEVERITY_MULTIPLIER.items()}, "1.0::double")
WEAK = f"(code in {S.lst(K.WEAK_CODES)} or regexp_matches({BLOB}, '{'|'.join(K.WEAK_WORDS_SCORING)}'))"
STRONG = f"(code in {S.lst(K.STRONG_CODES)} or (category in ('credential-harvest', 'behavioral-flow') and severity in ('high', 'critical')) or severity = 'critical')"
C = verdict.COMPONENTS
WEIGHTED = {c: f"{c} * {w}::double" for c, w in K.COMPONENT_WEIGHTS.items()}
FUSION_STEPS = f"""{PATTERNS},
e1 as (select ev.*, trusted, {STRONG} as strong, {WEAK} as weak from ev join pg using (page_id)),
sn as (select page_id, count(*) filter (strong) as strong_rows from e1 group by page_id),
e2 as (select e1.*, case when weak and strong_rows = 0 then null else impact * {MULT} * greatest(0.35::double, least(1.0::double, rel))
    * case when weak then 0.22::double else 1.0 end * case when trusted and weak then 0.35::double when trusted then 0.8::double else 1.0 end end as pts
  from e1 join sn using (page_id)),
e3 as (select *, case when pts is null then 0 else greatest(impact, round_even(pts, 0)::int) end as esc from e2),
bs as (select page_id, {', '.join(f"least(100, round_even(coalesce(sum(pts order by seq) filter (bucket = '{b}'), 0), 0))::int as s_{b}" for b in ('url', 'dom', 'content', 'reputation', 'model'))},
    coalesce(sum(impact) filter (bucket = 'dom' and code in {S.lst(K.REDIRECT_CODES)}), 0) as redir from e3 group by page_id),
cm as (select pg.*, coalesce(strong_rows, 0)::int as strong_rows,
    greatest(coalesce(s_url, 0), coalesce(s_model, 0), cal)::int as phishing_probability, coalesce(s_dom, 0) as dom_suspicion,
    greatest(coalesce(s_content, 0), text_score)::int as content_scam_score, greatest(coalesce(s_reputation, 0), intel)::int as reputation_score,
    least(100, case when hops >= 1 then least(65, hops * 22) else 0 end + least(35, coalesce(redir, 0)))::int as redirect_risk
  from pg left join bs using (page_id) left join sn using (page_id)),
fl as (select page_id,
    count(*) filter (code in {S.lst(K.BEHAVIOR_CODES)}) > 0 as beh, count(*) filter (code in {S.lst(K.DOM_ABUSE_CODES)}) > 0 as abuse,
    count(*) filter (bucket = 'dom' and code in {S.lst(K.DOM_CLUSTER_CODES)} and severity in ('medium', 'high', 'critical')) >= 2 as cluster,
    count(*) filter (bucket = 'content' and code in {S.lst(K.SOCIAL_CONTENT_CODES)}) > 0 as risky_content,
    count(*) filter (bucket = 'url' and code in {S.lst(K.SOCIAL_URL_CODES)}) > 0 as risky_url from ev group by page_id),
pf as (select page_id, count(*) filter (confidence >= 0.72) > 0 as any_pattern,
    count(*) filter (pattern = 'social-engineering-scam' and confidence >= 0.72) > 0 as social from pat group by page_id),
v0 as (select cm.*, {S.rint(' + '.join(WEIGHTED[c] for c in C))}::int as raw, coalesce(beh, false) as beh, coalesce(abuse, false) as abuse,
    coalesce(cluster, false) as cluster, coalesce(any_pattern, false) as any_pattern,
    coalesce(social and risky_content and risky_url, false) as social
  from cm left join fl using (page_id) left join pf using (page_id)),
v1 as (select *, not any_pattern and not beh and not abuse as calm, trusted and strong_rows = 0 as trust_cap,
    raw >= 50 and strong_rows < 2 and not any_pattern as thin, not trusted and cluster and raw < 26 as dom_lift from v0),
v2 as (select *, not trusted and social and (case when dom_lift then 26 else raw end) < 26 as social_lift,
    least(case when calm then 20 end, case when trust_cap then 12 end, case when thin then 45 end)::int as risk_cap from v1),
v3 as (select *, least(case when dom_lift or social_lift then 26 else raw end, risk_cap, 100)::int as risk_score,
    list_filter([case when calm then {S.text(K.NOTE_NO_BEHAVIOR)} end, case when calm then {S.text(K.NOTE_WEAK_IGNORED)} end,
      case when trust_cap then {S.text(K.NOTE_TRUSTED)} end, case when thin then {S.text(K.NOTE_CAPPED)} end,
      case when dom_lift then {S.text(K.NOTE_DOM_LIFT)} end, case when social_lift then {S.text(K.NOTE_SOCIAL_LIFT)} end], lambda x: x is not null) as notes from v2),
v as (select *, case when risk_score < 25 then 'Safe' when risk_score < 50 then 'Suspicious' when risk_score < 75 then 'Dangerous' else 'Critical' end as classification from v3),
tp as (select *, row_number() over (partition by page_id order by {SEV_RANK.format('severity')} desc, rel desc, impact desc, conf desc, seq) as rank from e3 qualify rank <= 14),
ta as (select page_id, count(*) as n_top, count(*) filter (severity in ('high', 'critical')) as n_severe,
    string_agg(title, ', ' order by rank) filter (rank <= 3) as lead, list(code order by rank) as codes from tp group by page_id),
wc as (select page_id, name, w, row_number() over (partition by page_id order by w desc, i) as r from (
    {' union all '.join(f"select page_id, '{c}' as name, {i} as i, {WEIGHTED[c]} as w from v" for i, c in enumerate(C))})),
vc as (select v.*, coalesce(n_top, 0) as n_top, lead, coalesce(codes, []) as top_codes,
    {S.half_even(f"greatest(0.15::double, least(0.99::double, 0.34::double + least(1.0::double, coalesce(n_top, 0) / 10.0::double) * 0.22::double + (({' + '.join(f'({c} > 0)::int' for c in C)}) / 5.0::double) * 0.18::double + least(1.0::double, coalesce(n_severe, 0) / 5.0::double) * 0.1::double + url_conf * 0.08::double + text_conf * 0.04::double + intel_conf * 0.04::double))", 2)} as conf0
  from v left join ta using (page_id)),
vd as (select *, case when risk_cap is not null and strong_rows = 0 then least(conf0, 0.62::double) else conf0 end as confidence from vc)
"""


FUSION = f"with {BASE}, {FUSION_STEPS}"


def fused(spark, sf):
    df = patterns.with_attack_patterns(I.planted_evidence(spark, sf))
    df = patterns.with_narrative(df)
    return verdict.with_risk_score(verdict.with_component_scores(df))


def detailed(spark, sf):
    return verdict.with_verdict_details(fused(spark, sf))


@register("component_scores", FUSION + f"select page_id, {', '.join(C)}, strong_rows from v")
def component_scores(spark, sf):
    return verdict.with_component_scores(I.planted_evidence(spark, sf)).select("page_id", *C, "strong_rows")


@register("escalation_contribution", FUSION + "select page_id, code, descr as description, esc as escalation_contribution from e3")
def escalation(spark, sf):
    df = verdict.with_component_scores(I.planted_evidence(spark, sf))
    return explode_signals(df, ["page_id"]).select("page_id", "code", "description", "escalation_contribution")


@register("risk_verdict", FUSION + "select page_id, risk_score, risk_cap, classification, array_to_string(notes, '|') as notes from v")
def risk_verdict(spark, sf):
    return fused(spark, sf).select(
        "page_id", "risk_score", "risk_cap", "classification", F.array_join("calibration_notes", "|").alias("notes"))


@register("class_breakdown_of_pages", FUSION + "select classification, count(*)::bigint as n, round(avg(risk_score), 6) as mean_score from v group by 1")
def class_counts(spark, sf):
    return fused(spark, sf).groupBy("classification").agg(
        F.count("*").alias("n"), F.round(F.avg("risk_score"), 6).alias("mean_score"))


@register("evidence_ranking", FUSION + "select page_id, rank::int as rank, code, severity, impact as score_impact, descr as description from tp")
def ranking(spark, sf):
    df = detailed(spark, sf)
    return df.select("page_id", F.posexplode("top_evidence").alias("i", "s")).select(
        "page_id", (F.col("i") + 1).alias("rank"), "s.code", "s.severity", "s.score_impact", "s.description")


@register("verdict_confidence", FUSION + "select page_id, confidence from vd")
def verdict_confidence(spark, sf):
    return detailed(spark, sf).select("page_id", "confidence")


@register("signal_counts", f"with {BASE} select page_id, count(seq)::int as total, " + ", ".join(
    f"(count(*) filter (severity = '{s}'))::int as {s}" for s in K.SEVERITIES) + " from pages left join ev using (page_id) group by page_id")
def signal_counts(spark, sf):
    return detailed(spark, sf).select("page_id", "signal_counts.*")


@register("indicators", f"with {BASE} select page_id, source, string_agg(distinct code, ',' order by code) as codes from ev group by all")
def indicators(spark, sf):
    return detailed(spark, sf).select("page_id", F.explode("indicators").alias("source", "c")).select(
        "page_id", "source", F.array_join("c", ",").alias("codes"))


@register("reason_chain", FUSION + f"""
select page_id, line from (
  select page_id, title || ': ' || descr || ' (confidence ' || printf('%.2f', conf) || ', reliability ' || printf('%.2f', rel) || ', escalation +' || esc || ')' as line from tp where rank <= 6
  union all select page_id, 'Component ''' || name || ''' contributed ' || printf('%.1f', {S.half_even('w', 1)}) || ' risk points.' from wc where r <= 2
  union all select page_id, unnest(notes[1:3]) from v)""")
def reason_chain(spark, sf):
    return detailed(spark, sf).select("page_id", F.explode("reason_chain").alias("line"))


@register("verdict_summary", FUSION + f"""
select page_id, case when len(notes) > 0 and classification = 'Safe' then {S.text(K.SUMMARY_SAFE_NOTES)}
  when n_top = 0 and classification = 'Safe' then {S.text(K.SUMMARY_SAFE_EMPTY)} when n_top = 0 then {S.text(K.SUMMARY_EMPTY)}
  when classification in ('Critical', 'Dangerous') then 'Threat profile is ' || upper(classification) || ' based on correlated phishing indicators: ' || lead || '. The page should be treated as hostile until proven otherwise.'
  when classification = 'Suspicious' then 'Threat profile is SUSPICIOUS due to mixed-risk evidence including ' || lead || '. User interaction should be restricted pending validation.'
  else 'Threat profile is SAFE with minor cautionary signals: ' || lead || '.' end as summary from vd""")
def verdict_summary(spark, sf):
    return detailed(spark, sf).select("page_id", "summary")


def _actions() -> str:
    by_code = ", ".join(
        f"case when list_has_any(top_codes, [{', '.join(S.text(c) for c in codes)}]) then {S.text(a)} end"
        for codes, a in K.CODE_ACTIONS)
    by_class = S.case("classification", {k: "[" + ", ".join(S.text(a) for a in v) + "]" for k, v in K.CLASS_ACTIONS.items()}, "[]")
    return f"select page_id, array_to_string((list_filter([{by_code}], lambda x: x is not null) || {by_class})[1:6], '|') as actions from vd"


@register("recommended_actions", FUSION + _actions())
def actions(spark, sf):
    return detailed(spark, sf).select("page_id", F.array_join("recommended_actions", "|").alias("actions"))


@register("detected_issues", FUSION + "select page_id, code, severity from (select *, row_number() over (partition by page_id, code order by rank) as k from tp) where k = 1")
def detected_issues(spark, sf):
    return detailed(spark, sf).select("page_id", F.explode("detected_issues").alias("i")).select(
        "page_id", "i.code", "i.severity")


@register("key_findings", FUSION + f"""
select page_id, coalesce(issue_list, '') as issue_list, coalesce(findings, 'No significant phishing behavior indicators were detected in this investigation run.') as findings
from pages left join (select page_id, string_agg(code, ',' order by k) filter (k <= 10) as issue_list,
  string_agg(title || ': ' || descr, '|' order by k) filter (k <= 5) as findings from (
  select *, row_number() over (partition by page_id order by {SEV_RANK.format('severity')} desc, impact desc, rank) as k from tp) group by page_id) using (page_id)""")
def findings(spark, sf):
    df = verdict.key_findings(detailed(spark, sf))
    return df.select("page_id", F.array_join("issue_list", ",").alias("issue_list"),
                     F.array_join("key_findings", "|").alias("findings"))


@register("behavior_findings", f"with {BASE} select page_id, code from ev where bucket = 'dom' and (starts_with(code, 'interaction-') or contains(category, 'behavior') or contains(category, 'credential'))")
def behavior(spark, sf):
    df = verdict.behavior_findings(I.planted_evidence(spark, sf))
    return df.select("page_id", F.explode("behavior_findings").alias("s")).select("page_id", "s.code")


@register("explanation", FUSION + f"""
, ps as (select page_id, string_agg(ptitle, ', ' order by rank) filter (rank <= 4) as pats from pat group by page_id),
ns as (select page_id, list_filter([{', '.join(f"case when count(*) filter (bucket in ('content', 'dom') and code in {S.lst(codes)}) > 0 then '{w}' end" for _, codes, _, w in K.NARRATIVE)}], lambda x: x is not null) as words from ev group by page_id),
one as (select page_id, title, code, conf from tp where rank = 1),
four as (select page_id, string_agg(title || ' (' || source || '/' || severity || ', impact ' || impact || ')', '; ' order by rank) as f from tp where rank <= 4 group by page_id),
tot as (select page_id, count(*) as total from ev group by page_id),
sm as (select page_id, case when len(notes) > 0 and classification = 'Safe' then {S.text(K.SUMMARY_SAFE_NOTES)}
  when n_top = 0 and classification = 'Safe' then {S.text(K.SUMMARY_SAFE_EMPTY)} when n_top = 0 then {S.text(K.SUMMARY_EMPTY)}
  when classification in ('Critical', 'Dangerous') then 'Threat profile is ' || upper(classification) || ' based on correlated phishing indicators: ' || lead || '. The page should be treated as hostile until proven otherwise.'
  when classification = 'Suspicious' then 'Threat profile is SUSPICIOUS due to mixed-risk evidence including ' || lead || '. User interaction should be restricted pending validation.'
  else 'Threat profile is SAFE with minor cautionary signals: ' || lead || '.' end as summary from vd)
select page_id, array_to_string(list_filter([
  'Threat classification: ' || classification || ' (' || risk_score || '/100).',
  'Lead indicator: ' || one.title || ' [' || one.code || '] with confidence ' || one.conf || '.',
  'Correlated evidence count: ' || total || ' signals across URL, DOM, content, model, and reputation.',
  summary, 'Target analyzed: ' || url || '.',
  case when trusted then 'Trusted domain context detected (trust score 55/100); weak contextual indicators were suppressed unless strong phishing behavior was present.' end,
  nullif(array_to_string(notes[1:3], ' '), ''),
  'Primary forensic findings: ' || four.f || '.', 'Likely attack patterns: ' || pats || '.',
  case when len(coalesce(words, [])) > 0 then '{K.NARRATIVE_FOUND}' || array_to_string(words, ', ') || '.' else '{K.NARRATIVE_NONE}' end], lambda x: x is not null), ' ') as explanation
from vd left join ps using (page_id) left join ns using (page_id) left join one using (page_id) left join four using (page_id) left join tot using (page_id) left join sm using (page_id)""")
def explanation(spark, sf):
    return verdict.with_explanation(detailed(spark, sf)).select("page_id", "explanation")


BONUS = S.case("severity", {k: str(v) for k, v in K.SEVERITY_BONUS.items()}, "0")


def _bucket_rows(i: int, bucket: str) -> str:
    stage, source, title, _, sev, delta, w = K.TIMELINE_BUCKETS[bucket]
    d = f"least(20, greatest(1, round_even((impact * {w}::double) * greatest(0.45::double, least(1.0::double, conf)), 0)::int + {BONUS}))"
    return (f" select page_id, {i} as a, -1 as b, '{stage}' as stage, '{title}' as title, {delta} as delta from ev where bucket = '{bucket}' group by page_id"
            f" union all select page_id, {i}, seq, '{stage}', title, {d} from ev where bucket = '{bucket}'")


TIMELINE = FUSION + f""", st as (
  select page_id, 0 as a, 0 as b, 'collection' as stage, 'Investigation initialized' as title, 0 as delta from pages
  union all {_bucket_rows(1, 'url')}
  union all select page_id, 2, 0, 'delivery-analysis', 'Redirect chain observed', least(18, hops * 6) from pg where hops > 0
  union all {_bucket_rows(3, 'dom')} union all {_bucket_rows(4, 'content')} union all {_bucket_rows(5, 'model')} union all {_bucket_rows(6, 'reputation')}
  union all select page_id, 7, r, 'reasoning', 'Weighted component contribution: ' || name, greatest(1, {S.rint('w * 0.15::double')}) from wc where r <= 3),
ru as (select *, least(100, sum(delta) over (partition by page_id order by a, b rows unbounded preceding)) as after from st),
rb as (select *, least(100, after - 0) as x, coalesce(lag(after) over (partition by page_id order by a, b), 0) as before from ru),
endp as (select page_id, max(after) as reached from ru group by page_id),
fin as (select rb.page_id, a, b, stage, title, before, after from rb
  union all select page_id, 8, 0, 'reasoning', 'Final evidence normalization', reached, risk_score from endp join v using (page_id) where reached <> risk_score),
cl as (select *, case when after < 25 then 0 when after < 50 then 1 when after < 75 then 2 else 3 end as ca,
    case when before < 25 then 0 when before < 50 then 1 when before < 75 then 2 else 3 end as cb from fin),
al as (select page_id, a, b, 0 as c, stage, title, before, after from cl
  union all select page_id, a, b, 1, 'escalation', 'Threat escalated to ' || upper(['Safe', 'Suspicious', 'Dangerous', 'Critical'][ca + 1]), after, after from cl where ca > cb
  union all select page_id, 9, 0, 0, 'conclusion', 'Investigation concluded: ' || upper(classification), risk_score, risk_score from v)
select page_id, (row_number() over (partition by page_id order by a, b, c) - 1)::int as event_no, stage, title,
  before::int as score_before, after::int as score_after from al"""


@register("timeline", TIMELINE)
def timeline_query(spark, sf):
    df = timeline.with_timeline(detailed(spark, sf), F.lit("2024-01-01").cast("timestamp"))
    return timeline.explode_timeline(df, ["page_id"]).select(
        "page_id", "event_no", "stage", "title", "score_before", "score_after")


@register("confidence_progression", f"""select page_id, event_no, 'evt-' || printf('%03d', event_no + 1) as event_id, epoch_us(timestamp '2024-01-01' + event_no * interval 1 second) as event_us,
  score_after as score, case when score_after < 25 then 'Safe' when score_after < 50 then 'Suspicious' when score_after < 75 then 'Dangerous' else 'Critical' end as classification, stage from ({TIMELINE})""")
def progression(spark, sf):
    df = timeline.with_timeline(detailed(spark, sf), F.timestamp_seconds(F.lit(1704067200)))
    return timeline.confidence_progression(df, ["page_id"]).select(
        "page_id", "event_no", "event_id", F.unix_micros("event_time").alias("event_us"), "score",
        "classification", "stage")


__all__ = ["no_signals"]
