"""Evaluation and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.registry import register
from webrisk.operators import evaluate as E
from webrisk.operators import history as H
from webrisk.operators.verdict import class_rank, risk_band

R4 = (lambda v: S.half_even(f"({v})", 4))
R3 = (lambda v: S.half_even(f"({v})", 3))


def _sweep(thresholds, wrap) -> str:
    grid = ", ".join(str(t) for t in thresholds)
    return f"""with {S.RECORDS}, c as (select t as threshold, count_if(true_label = 1 and risk_score >= t)::bigint as tp,
  count_if(true_label = 0 and risk_score >= t)::bigint as fp, count_if(true_label = 0 and risk_score < t)::bigint as tn,
  count_if(true_label = 1 and risk_score < t)::bigint as fn from val, unnest([{grid}]) g(t) group by t)
select threshold, tp, fp, tn, fn, {S.rate_columns(wrap)} from c"""


@register("threshold_sweep", _sweep([20, 30, 40, 50, 60], R4))
def sweep(spark, sf):
    return E.threshold_sweep(I.records(spark, sf))


@register("metrics_at_threshold", _sweep([40], R4))
def metrics(spark, sf):
    return E.metrics_at_threshold(I.records(spark, sf), 40)


@register("predicted_label", f"""with {S.RECORDS} select rec.id, case when rec.risk_score is not null then (rec.risk_score >= 40)::int
  else (sc.classification <> 'Safe')::int end as predicted_label from rec join sc using (id)""")
def predicted(spark, sf):
    r = I.records(spark, sf).join(I.scans(spark, sf).select("id", "classification"), "id")
    return r.select("id", E.predicted_label(F.col("risk_score"), F.col("classification"), 40).alias("predicted_label"))


@register("false_positives", f"with {S.RECORDS} select id, url, risk_score from val where true_label = 0 and risk_score >= 40")
def fp(spark, sf):
    return E.false_positives(I.records(spark, sf), 40).select("id", "url", "risk_score")


@register("false_negatives", f"with {S.RECORDS} select id, url, risk_score from val where true_label = 1 and risk_score < 40")
def fn(spark, sf):
    return E.false_negatives(I.records(spark, sf), 40).select("id", "url", "risk_score")


@register("error_preview", f"with {S.RECORDS} select id, risk_score from val where true_label = 0 and risk_score >= 40 order by risk_score desc, id limit 30")
def error_preview(spark, sf):
    return E.preview(E.false_positives(I.records(spark, sf), 40), [F.desc("risk_score"), "id"]).select("id", "risk_score")


@register("run_summary", f"""with {S.RECORDS} select count(*)::bigint as sample_count, count_if(status <> 'error')::bigint as success_count,
  count_if(status = 'error')::bigint as failure_count, count_if(timeout_exceeded)::bigint as timeout_exceeded_count,
  {S.half_even('sum(duration_seconds)', 3)} as total_runtime_seconds, {S.half_even('(sum(duration_seconds) / count(*))', 4)} as average_runtime_seconds from rec""")
def run_summary(spark, sf):
    return E.run_summary(I.records(spark, sf))


@register("score_histogram", f"with {S.RECORDS} select true_label, risk_score, count(*)::bigint as n from val group by all")
def histogram(spark, sf):
    return E.score_histogram(I.records(spark, sf))


@register("score_bins", f"""with {S.RECORDS}, m as (select min(risk_score) as lo, max(risk_score) as hi from rec)
select true_label, least(floor((risk_score - lo) / ((hi - lo) / 24.0::double)), 23)::int as bin, count(*)::bigint as n
from rec, m where risk_score is not null group by all""")
def bins(spark, sf):
    return E.score_bins(I.records(spark, sf))


@register("pattern_frequency", f"with {S.RECORDS} select code, count(*)::bigint as n from (select unnest(attack_patterns) as code from rec) group by 1 order by n desc, code limit 12")
def frequency(spark, sf):
    return E.pattern_frequency(I.records(spark, sf))


CORPUS = f"""with {S.SCANS}, c0 as (select *, case when id % 5 = 0 then 'ambiguous' when (id * 7 + risk_score) % 100 < risk_score then 'malicious' else 'benign' end as label,
  list_filter([case when id % 2 = 0 then 'credential-harvesting' end, case when id % 3 = 0 then 'brand-impersonation' end], lambda x: x is not null) as expected,
  list_filter([case when id % 6 = 0 then 'brand-impersonation' end, case when id % 4 = 0 then 'credential-harvesting' end], lambda x: x is not null) as got,
  classification <> 'Safe' as hit, list_position(['Safe', 'Suspicious', 'Dangerous', 'Critical'], classification) - 1 as rk,
  case when id % 4 = 0 then classification <> 'Safe' when id % 4 = 1 then classification in ('Safe', 'Suspicious') else true end as met from sc)"""


def corpus_rows(spark, sf):
    c = I.corpus(spark, sf)
    scored = c.select(
        "id", "risk_score", "classification", "confidence",
        F.transform("p_codes", lambda p: F.struct(p.alias("code"))).alias("attack_patterns"),
        F.col("e_rows").alias("top_evidence"), F.array().cast("array<int>").alias("suppressed"),
        F.lit(0).alias("coercion_score"))
    return E.corpus_rows(scored, c.select(
        "id", "label", "category", "expected_patterns", "expected_classification_min", "expected_classification_max"))


@register("corpus_rows", CORPUS + " select id, label, array_to_string(list_sort(list_intersect(expected, got)), ',') as matched, met as classification_expectation_met from c0")
def corpus(spark, sf):
    return corpus_rows(spark, sf).select(
        "id", "label", F.array_join("matched_patterns", ",").alias("matched"), "classification_expectation_met")


@register("corpus_summary", CORPUS + f""" select count(*)::bigint as sample_count, count_if(label = 'malicious' and hit)::bigint as tp, count_if(label <> 'malicious' and hit)::bigint as fp,
  count_if(label <> 'malicious' and not hit)::bigint as tn, count_if(label = 'malicious' and not hit)::bigint as fn, {S.half_even('(count_if(met)::double / count(*))', 3)} as expectation_pass_rate from c0""")
def corpus_summary(spark, sf):
    return E.corpus_summary(corpus_rows(spark, sf))


@register("corpus_by_label", CORPUS + f" select label, {S.half_even('avg(risk_score)', 3)} as average_risk, round(avg(confidence), 2) as average_confidence, {S.half_even('avg(rk)', 3)} as average_class_rank, 0::bigint as with_interaction_findings from c0 group by label")
def by_label(spark, sf):
    return E.corpus_by_label(corpus_rows(spark, sf)).withColumn("average_confidence", F.round("average_confidence", 2))


@register("pattern_coverage", CORPUS + " select code, count(*)::bigint as n from (select unnest(list_intersect(expected, got)) as code from c0) group by 1")
def coverage(spark, sf):
    return E.pattern_coverage(corpus_rows(spark, sf))


@register("noisy_signals", CORPUS + """, e as (select label, 'mailto' as code, 'medium' as sev, 13 as imp from c0 where id % 2 = 0 union all select label, 'url-deep-path', 'medium', 9 from c0 where id % 3 = 0
  union all select label, 'url-ip-host', 'high', 24 from c0 where id % 7 = 0),
k as (select 'benign_high_severity' as kind, code from e where label = 'benign' and sev in ('high', 'critical') union all select 'noisy_low_impact', code from e where label <> 'malicious' and imp <= 10)
select kind, code, count(*)::bigint as n, (row_number() over (partition by kind order by count(*) desc, code))::int as rank from k group by kind, code qualify rank <= 10""")
def noisy(spark, sf):
    return E.noisy_signals(corpus_rows(spark, sf))


@register("corpus_sweep", CORPUS + f""", c as (select t as threshold, count_if(label = 'malicious' and risk_score >= t)::bigint as tp, count_if(label <> 'malicious' and risk_score >= t)::bigint as fp,
  count_if(label <> 'malicious' and risk_score < t)::bigint as tn, count_if(label = 'malicious' and risk_score < t)::bigint as fn from c0, unnest([25, 35, 45, 55, 65, 75]) g(t) group by t)
select threshold, tp, fp, tn, fn, {R3(S.ratio('tp', 'tp + fp'))} as precision, {R3(S.ratio('tp', 'tp + fn'))} as recall from c""")
def corpus_sweep(spark, sf):
    return E.corpus_sweep(corpus_rows(spark, sf))


@register("evaluation_records", S.URLS + f""", l as (select page_id, url, case when regexp_matches(host, 'casino|free-bets|spam-farm|cheap-pills|adult') then 1 else 0 end as true_label, 'planted' as source from u)
select page_id, url, true_label, source, 'ok' as status, false as timeout_exceeded from l""")
def evaluation_records(spark, sf):
    from webrisk.plans.score import ScoreOptions, score_urls

    urls = I.planted_urls(spark, sf)
    scored = score_urls(urls.withColumnRenamed("page_id", "id"), ["id"], ScoreOptions(with_explanation=False))
    labels = urls.select(
        F.col("page_id").alias("id"), "url", F.lit("planted").alias("source_dataset"),
        F.when(F.col("url").rlike("casino|free-bets|spam-farm|cheap-pills|adult"), 1).otherwise(0).alias("label"))
    out = E.evaluation_records(scored, labels, key="id").withColumnRenamed("id", "page_id")
    return out.join(urls, "page_id").select("page_id", "url", "true_label", "source", "status", "timeout_exceeded")


# -- scan history ------------------------------------------------------------

@register("recent_scans", f"with {S.SCANS} select id, url, scan_type, risk_score, classification, created_at from sc where user_id = 8 order by created_at desc, id desc limit 20 offset 5")
def recent(spark, sf):
    return H.recent_scans(I.scans(spark, sf), 8, 20, 5).select(
        "id", "url", "scan_type", "risk_score", "classification", "created_at")


@register("count_for_user", f"with {S.SCANS} select count(*)::bigint as total from sc where user_id = 8")
def count_user(spark, sf):
    return H.count_for_user(I.scans(spark, sf), 8)


@register("class_breakdown", f"with {S.SCANS} select user_id, classification, count(*)::bigint as count, {S.half_even('avg(risk_score)', 2)} as avg_risk_score from sc group by all")
def breakdown(spark, sf):
    return H.class_breakdown(I.scans(spark, sf))


@register("dashboard", f"""with {S.SCANS}, m as (select * from sc where user_id = 8), b as (select classification, count(*) as n, {S.half_even('avg(risk_score)', 2)} as a from m group by 1),
r as (select id, created_at from m order by created_at desc, id desc limit 5)
select (select string_agg(classification || '=' || n || '/' || a, ',' order by classification) from b) as classes,
  (select string_agg(id::varchar, ',' order by created_at desc, id desc) from r) as recent_ids, (select sum(n)::bigint from b) as total_scans""")
def dashboard(spark, sf):
    d = H.dashboard(I.scans(spark, sf), 8)
    return d.select(
        F.array_join(F.transform("classification_breakdown", lambda c: F.concat(
            c["classification"], F.lit("="), c["count"].cast("string"), F.lit("/"), c["avg_risk_score"].cast("string"))), ",").alias("classes"),
        F.array_join(F.transform("recent_scans", lambda r: r["id"].cast("string")), ",").alias("recent_ids"),
        "total_scans")


IDS = [0, -4, 8, 21, 34, 55, 89, 144, 144, 233, 377, 610]


@register("delete_scans", f"with {S.SCANS} select id, user_id from sc where not (user_id = 8 and id in (8, 21, 34, 55, 89, 144, 233, 377, 610))")
def delete(spark, sf):
    return H.delete_scans(I.scans(spark, sf), 8, IDS).select("id", "user_id")


@register("delete_report", f"with {S.SCANS} select count(*)::bigint as deleted_count, 0::bigint as remaining from sc where user_id = 8")
def delete_report(spark, sf):
    return H.delete_report(I.scans(spark, sf), 8)


@register("risk_bands", f"with {S.SCANS} select case when risk_score >= 70 then 'High' when risk_score >= 40 then 'Elevated' when risk_score >= 20 then 'Low' else 'Minimal' end as band, count(*)::bigint as n from sc group by 1")
def bands(spark, sf):
    return I.scans(spark, sf).groupBy(risk_band(F.col("risk_score")).alias("band")).agg(F.count("*").alias("n"))


@register("history_search", f"with {S.SCANS} select id, url from sc where classification = 'Dangerous' and (contains(lower(url), 'site7.') or contains(lower(explanation), 'purchase'))")
def history_search(spark, sf):
    s = I.scans(spark, sf)
    by_url = H.search(s, "Dangerous", " SITE7. ").select("id", "url")
    return by_url.union(H.search(s, "Dangerous", "Purchase").select("id", "url")).distinct()


@register("class_ranks", f"with {S.SCANS} select classification, (list_position(['Safe', 'Suspicious', 'Dangerous', 'Critical'], classification) - 1)::int as rank, count(*)::bigint as n from sc group by all")
def ranks(spark, sf):
    return I.scans(spark, sf).groupBy("classification", class_rank(F.col("classification")).alias("rank")).agg(
        F.count("*").alias("n"))
