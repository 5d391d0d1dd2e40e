"""Reputation and interaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.registry import register
from webrisk import catalogs as K
from webrisk.functions import urls as U
from webrisk.operators import evidence as E
from webrisk.operators import intel, interaction, patterns

PAYLOADS = """
with pl as (select event_id as id, 'https://u' || user_id || '.example.com/' as url, event_id % 3 as k, event_id as i, ts,
    floor(value)::int as v, event_id % 23 = 0 as failed from events),
fi as (select *, case k when 0 then 'virustotal' when 1 then 'urlscan' else 'abuseipdb' end as provider,
    v % 4 as mal, i % 3 as sus,
    not (i % 7 = 0 or i % 5 = 0) as judged, v % 120 as us, v % 101 as ab, i % 60 as reps from pl),
fd as (select id, url, provider, ts, failed,
    case when failed then 0 when k = 0 then least(100, mal * 22 + sus * 11) when k = 1 then case when judged then least(100, us) else 0 end else ab end::int as score,
    case when failed then 0.2::double when k = 0 then least(0.97::double, 0.58::double + least(25, mal + sus) * 0.015::double)
      when k = 1 then case when judged then 0.65::double else 0.45::double end else least(0.95::double, 0.55::double + least(40, reps) * 0.01::double) end as confidence,
    case when failed then 'error' when k = 0 then case when mal > 0 then 'malicious' when sus > 0 then 'suspicious' else 'clean' end
      when k = 1 then case when not judged then 'submitted' when us >= 65 then 'malicious' when us >= 35 then 'suspicious' else 'clean' end
      else case when ab >= 75 then 'malicious' when ab >= 30 then 'suspicious' else 'clean' end end as verdict,
    case when failed then null when k = 0 and mal > 0 then 'reputation-virustotal-malicious' when k = 0 and sus > 0 then 'reputation-virustotal-suspicious'
      when k = 1 and judged and us >= 65 then 'reputation-urlscan-malicious' when k = 1 and judged and us >= 35 then 'reputation-urlscan-suspicious'
      when k = 2 and ab >= 75 then 'reputation-abuseipdb-high' when k = 2 and ab >= 30 then 'reputation-abuseipdb-medium' end as issue,
    case when k = 0 and mal >= 3 then 'critical' when (k = 0 and mal > 0) or (k = 1 and us >= 65) or (k = 2 and ab >= 75) then 'high' else 'medium' end as sev
  from fi)"""


@register("provider_findings", PAYLOADS + """
select id, provider, score, round(confidence, 6) as confidence, verdict, issue as issue_code, case when issue is not null then sev end as issue_severity from fd""")
def findings(spark, sf):
    return intel.provider_findings(I.payloads(spark, sf)).select(
        "id", "provider", "finding.score", F.round("finding.confidence", 6).alias("confidence"),
        "finding.verdict", F.col("issue.code").alias("issue_code"),
        F.col("issue.severity").alias("issue_severity"))


RESULTS = PAYLOADS + f""", la as (select * from fd qualify row_number() over (partition by url, provider order by ts desc) = 1),
re as (select url, max(ts) as intel_ts,
  coalesce(least(100, max(score) filter (verdict not in ('error', 'submitted')) + greatest(0, count(*) filter (verdict not in ('error', 'submitted') and score >= 45) - 1) * 8), 0)::int as intel_score,
  case when count(*) filter (verdict <> 'error') = 0 then 0.2::double else {S.half_even("greatest(0.25::double, least(0.99::double, (sum(confidence order by case provider when 'virustotal' then 0 when 'urlscan' then 1 else 2 end) filter (verdict <> 'error')) / nullif(count(*) filter (verdict <> 'error'), 0)))", 2)} end as intel_confidence,
  count(*)::int as providers, count(issue)::int as issues from la group by url)"""


@register("intel_results", RESULTS + " select url, intel_ts, intel_score, intel_confidence, providers, issues from re")
def results(spark, sf):
    return intel.intel_results(I.payloads(spark, sf)).select(
        "url", "intel_ts", "intel_score", "intel_confidence", F.size("intel_findings").alias("providers"),
        F.size("intel_issues").alias("issues"))


@register("reputation_evidence", PAYLOADS + """
select id, 'reputation-' || provider || '-' || verdict as code, case when score >= 75 then 'high' when score >= 45 then 'medium' else 'low' end as severity,
  greatest(4, floor(score * 0.25::double))::int as score_impact, round(greatest(0.2::double, least(0.99::double, confidence)), 6) as confidence, round(greatest(0.3::double, least(0.98::double, confidence)), 6) as reliability
from fd where verdict not in ('error', 'unavailable', 'submitted') and score > 0""")
def reputation(spark, sf):
    df = intel.provider_findings(I.payloads(spark, sf))
    return df.select("id", F.explode(E.reputation_rows(F.array("finding"))).alias("s")).select(
        "id", "s.code", "s.severity", "s.score_impact", F.round("s.confidence", 6).alias("confidence"),
        F.round("s.reliability", 6).alias("reliability"))


@register("cached_lookup", """
with s as (select event_id as id, user_id as url, ts from events where event_type <> 'view'),
c as (select user_id as url, ts, floor(value)::int as score from events where event_type = 'view'),
j as (select s.id, s.url, s.ts, c.ts as cts, c.score from s asof left join c on s.url = c.url and s.ts >= c.ts)
select id, url, ts, coalesce(epoch_us(ts) - epoch_us(cts) <= 900000000, false) as cache_hit,
  case when epoch_us(ts) - epoch_us(cts) <= 900000000 then score end as cached_score from j""")
def cached(spark, sf):
    e = I.table(spark, sf, "events")
    s = e.filter("event_type <> 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("url"), "ts")
    c = e.filter("event_type = 'view'").select(
        F.col("user_id").alias("url"), "ts", F.floor("value").cast("int").alias("score"))
    return intel.lookup_cached(s, c, ["score"])


def _count(shift, name):
    j = I.COUNTERS.index(name)
    return f"((page_id * {j + 2} + step * {j + 1 + shift} + {shift * j}) % 3)"


def _diff(name, mode):
    d = f"({_count(1, name)} - {_count(0, name)})"
    return f"{d}::int" if mode == 0 else f"greatest(0, {d} * {mode})::int"


STEPS = "with st as (select page_id, unnest([1, 2, 3]) as step from pages), df as (select *, " + ", ".join(
    f"{_diff(c, d)} as {n}" for n, c, d in interaction.MUTATIONS) + """,
  (case when (page_id + step) % 5 = 0 then true when (page_id + step) % 7 = 0 then true else false end) as redirect_triggered,
  page_id % 2 > 0 or (page_id + step) % 3 = 0 as popup from st),
sg as (select *, least(25, visible_credential_fields_increase * 4 + forms_increase * 3 + overlays_increase * 3 + iframes_increase * 2 + urgency_text_hits_increase + redirect_triggered::int * 4)::int as significance from df),
ic as (select *, list_filter([case when redirect_triggered then 'interaction-triggered-redirect' end,
  case when visible_credential_fields_increase > 0 then 'interaction-hidden-credential-reveal' end,
  case when forms_increase > 0 then 'interaction-dynamic-form-injection' end,
  case when overlays_increase > 0 then 'interaction-overlay-injection' end,
  case when iframes_increase > 0 then 'interaction-iframe-insertion' end,
  case when popup and significance >= 4 then 'interaction-popup-scare-flow' end], lambda x: x is not null) as codes, popup and significance < 4 as popup_suppressed from sg),
rc as (select *, least(97, 35 + sum(case when len(codes) > 0 then 10 + least(6, significance) else 2 end) over (partition by page_id order by step))::double / 100 as confidence_after from ic)"""


@register("interaction_steps", STEPS + " select page_id, step, " + ", ".join(n for n, _, _ in interaction.MUTATIONS) +
          ", redirect_triggered, significance, array_to_string(codes, ',') as codes, popup_suppressed, confidence_after from rc")
def steps(spark, sf):
    df = interaction.interaction_steps(I.interaction_log(spark, sf), ["page_id"])
    return df.select(
        "page_id", "step", *[n for n, _, _ in interaction.MUTATIONS], "redirect_triggered", "significance",
        F.array_join("new_indicator_codes", ",").alias("codes"), "popup_suppressed", "confidence_after")


_RULES = ", ".join(
    f"('{c}', '{r[1]}', {r[3]}, {r[4]}, {r[5]}::double, {r[6]}::double)" for c, r in K.INTERACTION_RULES.items())


@register("interaction_evidence", STEPS + f""", ex as (select page_id, step, significance, unnest(codes) as code from rc),
fr as (select page_id, code, min(step) as step, min_by(significance, step) as significance from ex group by all)
select page_id, step, code, severity, case when significance < 7 then lo else hi end::int as score_impact,
  case when significance < 7 then clo else chi end as confidence,
  round(greatest(0.2::double, least(0.98::double, (case when significance < 7 then clo else chi end) - 0.05::double)), 6) as reliability
from fr join (values {_RULES}) r(code, severity, lo, hi, clo, chi) using (code)""")
def interaction_rows(spark, sf):
    return interaction.interaction_evidence(I.interaction_log(spark, sf), ["page_id"]).select(
        "page_id", "step", "code", "severity", "score_impact", "confidence",
        F.round("reliability", 6).alias("reliability"))


@register("interaction_summary", STEPS + """
select page_id, count(*)::bigint as actions_attempted, bool_or(redirect_triggered) as redirect_observed,
  count_if(popup_suppressed)::bigint as suppressed_indicators, max((page_id % 2)::int) as dialog_count,
  max(((page_id + step) % 3 = 0)::int) as popup_count from rc group by page_id""")
def interaction_summary(spark, sf):
    return interaction.interaction_summary(I.interaction_log(spark, sf), ["page_id"]).select(
        "page_id", "actions_attempted", "redirect_observed", "suppressed_indicators", "dialog_count", "popup_count")


@register("flow_pattern", STEPS + f""", ag as (select page_id, count(*) as steps, sum(len(codes)) as n, sum(confidence_after order by step) / count(*) as mean,
  list_sort(list_distinct(flatten(list(codes)))) as codes from rc group by page_id)
select page_id, {S.half_even('least(0.96::double, 0.68::double + least(0.16::double, n * 0.03::double) + least(0.1::double, (mean - 0.5::double) * 0.25::double))', 2)} as confidence,
  array_to_string(codes, ',') as codes from ag where steps >= 2 and n >= 2""")
def flow(spark, sf):
    df = interaction.interaction_results(I.interaction_log(spark, sf), ["page_id"])
    return df.select("page_id", F.explode(patterns.flow_pattern(F.col("interaction_events"))).alias("p")).select(
        "page_id", "p.confidence", F.array_join("p.evidence_codes", ",").alias("codes"))


_TEXT = "case (page_id + n + m) % 6 when 0 then 'Verify account' when 1 then 'Learn more' when 2 then 'Sign in with Google' when 3 then 'Continue' when 4 then 'Next' else '' end"
_HREF = "case (page_id * 3 + n + 2 * m) % 5 when 0 then '/login' when 1 then '/privacy' when 2 then '/secure/help' when 3 then '/home' else '' end"


@register("candidate_targets", f"""
with g as (select page_id, n, m, {_TEXT} as text, {_HREF} as href, case when n % 2 = 0 then 'button:has-text(''' || n || ''')' else 'a#' || n end as selector
  from pages, unnest([0, 1, 2, 3, 4, 5]) a(n), unnest([0, 1, 2]) b(m)),
sc as (select *, case when {S.any_of('lower(text)', K.SUSPICIOUS_CLICK_WORDS)} then 6 else 0 end + case when {S.any_of('href', K.SUSPICIOUS_HREF_WORDS)} then 4 else 0 end
  + case when n % 2 = 0 then 1 else 0 end - case when {S.any_of('lower(text)', K.BENIGN_CLICK_WORDS)} then 8 else 0 end - case when {S.any_of('href', K.BENIGN_HREF_WORDS)} then 3 else 0 end as score from g where m < 2)
select page_id, row_number() over (partition by page_id order by score desc, n, m)::int as target_rank, selector, m as match_no, score, text, href from sc where score > 0
qualify target_rank <= 4""")
def targets(spark, sf):
    return interaction.candidate_targets(I.click_candidates(spark, sf), ["page_id"])


@register("suspicious_redirect", """
select page_id, step, (page_id + step) % 5 = 0 or ((page_id + step) % 7 = 0) as suspicious
from pages, unnest([1, 2, 3]) s(step)""")
def redirect(spark, sf):
    return I.interaction_log(spark, sf).select(
        "page_id", "step", U.is_suspicious_redirect(F.col("url_before"), F.col("url_after")).alias("suspicious"))
