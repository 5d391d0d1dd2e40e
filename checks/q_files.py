"""Reader and sink queries: tables are written to a scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.registry import register
from webrisk.functions.urls import url_host
from webrisk.operators import history, prep
from webrisk.session import shared_root
from webrisk.sources import readers, sinks


def scratch(spark, name: str) -> str:
    """A new folder below the shared folder of the cluster."""
    return f"{shared_root(spark)}/files-{uuid.uuid4().hex[:12]}/{name}"


def _pages(spark, sf):
    return I.table(spark, sf, "pages")


HOSTS = S.H


@register("read_url_lines", f"""
select url, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^([^:]*)', 1) as domain, 1 as label, 'malicious' as label_text, raw as raw_value
from (select case when page_id % 2 = 0 then url else 'https://' || {HOSTS} end as url, case when page_id % 2 = 0 then url else {HOSTS} end as raw from pages)""")
def url_lines(spark, sf):
    path = scratch(spark, "openphish.txt")
    value = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(url_host(F.col("url")))
    _pages(spark, sf).select(F.concat(F.lit(" "), value, F.lit(" \n")).alias("value")).write.text(path)
    # the label comes from the file name, which Spark chose; infer it from the folder instead
    df = readers.read_url_lines(spark, path)
    label = readers.infer_label(F.lit("openphish.txt"))
    return df.select("url", "domain", label.alias("label"),
                     F.when(label == 1, "malicious").otherwise("benign").alias("label_text"), "raw_value")


@register("read_phish_feed", f"select url, 1 as label from pages union all select 'http://' || {HOSTS}, 1 from pages")
def phish_feed(spark, sf):
    urls, domains = scratch(spark, "urls"), scratch(spark, "domains")
    _pages(spark, sf).select("url").write.text(urls)
    _pages(spark, sf).select(url_host(F.col("url"))).write.text(domains)
    return readers.read_phish_feed(spark, urls, domains).select("url", "label")


@register("read_url_csv", "select url, url as raw_value from pages")
def url_csv(spark, sf):
    path = scratch(spark, "csv")
    _pages(spark, sf).select(F.col("page_id").alias("id"), F.col("url").alias("Phish_URL")).write.option("header", True).csv(path)
    return readers.read_url_csv(spark, path).select("url", "raw_value")


@register("read_url_csv_by_position", f"select 'https://' || {HOSTS} as url, {HOSTS} as raw_value from pages")
def url_csv_position(spark, sf):
    path = scratch(spark, "csv")
    _pages(spark, sf).select(F.col("page_id").alias("pos"), url_host(F.col("url")).alias("name")).write.option("header", True).csv(path)
    return readers.read_url_csv(spark, path).select("url", "raw_value")


@register("read_labeled_csv", "select url, 1 as label, 'phishtank' as source from pages")
def labeled_csv(spark, sf):
    path = scratch(spark, "csv")
    _pages(spark, sf).select(F.col("page_id").alias("id"), F.col("url").alias("phish_url")).write.option("header", True).csv(path)
    return readers.read_preset(spark, path, "phishtank").select("url", "label", "source")


@register("read_ranked_domains", f"select 'https://' || {HOSTS} as url, 0 as label, page_id as line_no from pages")
def ranked(spark, sf):
    path = scratch(spark, "csv")
    _pages(spark, sf).select("page_id", url_host(F.col("url"))).write.csv(path)
    return readers.read_ranked_domains(spark, path).select("url", "label", "line_no")


def _corpus_file(spark, sf) -> str:
    path = scratch(spark, "json")
    i = F.col("page_id")
    _pages(spark, sf).select(
        i.cast("string").alias("id"),
        F.when(i % 3 == 0, "malicious").when(i % 3 == 1, "benign").otherwise("ambiguous").alias("label"),
        F.lit("c").alias("category"), "url", F.when(i % 2 == 0, F.lit("t")).alias("text"),
        F.when(i % 5 == 0, F.array(F.lit("p"))).alias("expected_patterns")).write.json(path)
    return path


@register("read_corpus", """
select page_id::varchar as id, case page_id % 3 when 0 then 'malicious' when 1 then 'benign' else 'ambiguous' end as label, url,
  case when page_id % 2 = 0 then 't' else '' end as text, '' as html, (page_id % 5 = 0)::int as patterns from pages""")
def corpus(spark, sf):
    return readers.read_corpus(spark, _corpus_file(spark, sf), multi_line=False).select(
        "id", "label", "url", "text", "html", F.size("expected_patterns").alias("patterns"))


@register("read_json_urls", """
select url, case page_id % 3 when 0 then 1 when 1 then 0 else -1 end as label from pages""")
def json_urls(spark, sf):
    return readers.read_json_urls(spark, _corpus_file(spark, sf), multi_line=False).select("url", "label")


@register("load_all", f"select distinct url from (select url from pages union all select 'https://' || {HOSTS} from pages "
          f"union all select 'https://alt-' || {HOSTS} from pages union all select 'https://json.example.com/' || page_id from pages)")
def load_all(spark, sf):
    root = scratch(spark, "all")
    p = _pages(spark, sf)
    p.select("url").write.text(f"{root}/a")
    p.select(F.col("page_id").alias("pos"), url_host(F.col("url")).alias("domain")).write.option("header", True).csv(f"{root}/b")
    p.select(F.col("page_id").alias("first id"), F.concat(F.lit("alt-"), url_host(F.col("url"))).alias("Site")).write.option(
        "header", True).option("sep", ";").csv(f"{root}/d")
    p.select(F.col("page_id").cast("string").alias("id"), F.concat(F.lit("https://json.example.com/"), F.col("page_id").cast("string")).alias("url")).write.json(f"{root}/e")
    p.select("url").write.text(f"{root}/results/c")
    merged, _ = readers.load_all(spark, root)
    return merged.select("url")


@register("label_inference", """
select event_id, case when regexp_matches(name, 'phish|openphish|malicious|scam|attack') then 1 else 0 end as label
from (select event_id, case event_id % 5 when 0 then 'OpenPhish-top.txt' when 1 then 'tranco.csv' when 2 then 'scam.txt' when 3 then 'other.txt' else 'safe_attack.csv' end as n, lower(n) as name from events)""")
def labels(spark, sf):
    names = {0: "OpenPhish-top.txt", 1: "tranco.csv", 2: "scam.txt", 3: "other.txt"}
    return I.table(spark, sf, "events").select(
        "event_id", readers.infer_label(I.cases(F.col("event_id") % 5, names, F.lit("safe_attack.csv"))).alias("label"))


@register("result_sinks", f"with {S.RECORDS} select id, risk_score, true_label, len(attack_patterns)::int as patterns from rec")
def result_sinks(spark, sf):
    path = scratch(spark, "records")
    sinks.write_json_lines(I.records(spark, sf), path)
    schema = "id bigint, risk_score int, true_label int, attack_patterns array<string>"
    return spark.read.schema(schema).json(path).select(
        "id", "risk_score", "true_label", F.size("attack_patterns").alias("patterns"))


@register("csv_sink", f"with {S.RECORDS} select id, '[' || array_to_string(list_transform(attack_patterns, lambda x: '\"' || x || '\"'), ',') || ']' as attack_patterns from rec")
def csv_sink(spark, sf):
    path = scratch(spark, "records")
    sinks.write_csv(I.records(spark, sf), path)
    return spark.read.option("header", True).option("escape", "\\").csv(path).select(
        F.col("id").cast("long").alias("id"), "attack_patterns")


@register("history_append", f"with {S.SCANS} select id, user_id, risk_score, cast(created_at as date) as scan_date from sc")
def history_append(spark, sf):
    path = scratch(spark, "history")
    sinks.append_history(I.scans(spark, sf), path)
    return spark.read.parquet(path).select("id", "user_id", "risk_score", "scan_date")


@register("history_rewrite", f"with {S.SCANS} select id, user_id from sc where not (user_id = 8 and id in (8, 21, 34, 55, 89, 144, 233, 377, 610))")
def history_rewrite(spark, sf):
    path, staging = scratch(spark, "history"), scratch(spark, "staging")
    sinks.append_history(I.scans(spark, sf), path)
    history.rewrite_without(spark, path, staging, 8, [8, 21, 34, 55, 89, 144, 233, 377, 610])
    return spark.read.parquet(path).select("id", "user_id")


__all__ = ["prep"]
