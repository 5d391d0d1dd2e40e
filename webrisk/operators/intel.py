"""Reputation findings from recorded provider payloads, and the reuse of recent results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrisk.functions import text as T
from webrisk.operators.text_rules import ISSUES_DDL

PROVIDERS = ["virustotal", "urlscan", "abuseipdb"]
FINDING_DDL = "struct<provider:string,score:int,confidence:double,summary:string,verdict:string>"
_STATS = "struct<malicious:int,suspicious:int,harmless:int,undetected:int>"


def _issue(code: str, title: str, description: Column, severity) -> Column:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(
        F.lit(code).alias("code"), F.lit(title).alias("title"),
        description.alias("description"), level.alias("severity"))


def _finding(provider: str, score: Column, confidence: Column, summary: Column, verdict: Column) -> Column:
    return F.struct(
        F.lit(provider).alias("provider"), score.cast("int").alias("score"),
        confidence.cast("double").alias("confidence"), summary.alias("summary"),
        verdict.alias("verdict")).cast(FINDING_DDL)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def virustotal(payload: Column) -> tuple[Column, Column]:
    """Finding and issue of an engine-count payload."""
    parsed = F.from_json(payload, f"data struct<attributes:struct<stats:{_STATS}>>")
    stats = parsed["data"]["attributes"]["stats"]
    bad, odd = _zero(stats["malicious"]), _zero(stats["suspicious"])
    verdict = F.when(bad > 0, "malicious").when(odd > 0, "suspicious").otherwise("clean")
    finding = _finding(
        "virustotal",
        F.least(F.lit(100), bad * 22 + odd * 11),
        F.least(F.lit(0.97), F.lit(0.58) + F.least(F.lit(25), bad + odd) * 0.015),
        F.format_string(
            "VT detections: malicious=%d, suspicious=%d, harmless=%d, undetected=%d",
            bad, odd, _zero(stats["harmless"]), _zero(stats["undetected"])),
        verdict,
    )
    issue = F.when(bad > 0, _issue(
        "reputation-virustotal-malicious", "VirusTotal malicious detections",
        F.format_string("VirusTotal reports %d malicious engine detections for this URL.", bad),
        F.when(bad >= 3, "critical").otherwise("high"),
    )).when(odd > 0, _issue(
        "reputation-virustotal-suspicious", "VirusTotal suspicious detections",
        F.format_string("VirusTotal reports %d suspicious engine detections for this URL.", odd),
        "medium"))
    return finding, issue


def urlscan(payload: Column) -> tuple[Column, Column]:
    """Finding and issue of a scan-submission payload, with or without a verdict."""
    p = F.from_json(
        payload,
        "uuid string, result string, message string, verdicts struct<overall:struct<score:int>>")
    overall = p["verdicts"]["overall"]
    judged = overall.isNotNull()
    score = F.when(judged, F.least(F.lit(100), _zero(overall["score"]))).otherwise(0)
    verdict = (
        F.when(~judged, "submitted").when(score >= 65, "malicious").when(score >= 35, "suspicious")
        .otherwise("clean")
    )
    summary = (
        F.when(
            (F.coalesce(p["uuid"], F.lit("")) != "") & (F.coalesce(p["result"], F.lit("")) != ""),
            F.format_string("URLScan submission accepted (uuid=%s). Result: %s", p["uuid"], p["result"]))
        .when(F.coalesce(p["message"], F.lit("")) != "", F.concat(F.lit("URLScan response: "), p["message"]))
        .otherwise("URL submitted to URLScan.")
    )
    finding = _finding("urlscan", score, F.when(judged, 0.65).otherwise(0.45), summary, verdict)
    issue = F.when(verdict == "malicious", _issue(
        "reputation-urlscan-malicious", "URLScan malicious verdict", summary, "high",
    )).when(verdict == "suspicious", _issue(
        "reputation-urlscan-suspicious", "URLScan suspicious verdict", summary, "medium"))
    return finding, issue


def abuseipdb(payload: Column, ip: Column) -> tuple[Column, Column]:
    """Finding and issue of an address-reputation payload."""
    p = F.from_json(
        payload, "data struct<abuseConfidenceScore:int,totalReports:int,usageType:string>")["data"]
    score, reports = _zero(p["abuseConfidenceScore"]), _zero(p["totalReports"])
    verdict = F.when(score >= 75, "malicious").when(score >= 30, "suspicious").otherwise("clean")
    address = F.coalesce(ip, F.lit("unknown"))
    finding = _finding(
        "abuseipdb", F.least(F.lit(100), score),
        F.least(F.lit(0.95), F.lit(0.55) + F.least(F.lit(40), reports) * 0.01),
        F.format_string(
            "AbuseIPDB for %s: abuseConfidenceScore=%d, totalReports=%d, usageType=%s",
            address, score, reports, F.coalesce(p["usageType"], F.lit("unknown"))),
        verdict,
    )
    text = F.format_string("Resolved host IP %s has AbuseIPDB confidence score %d.", address, score)
    issue = F.when(score >= 75, _issue(
        "reputation-abuseipdb-high", "High abuse confidence IP", text, "high",
    )).when(score >= 30, _issue(
        "reputation-abuseipdb-medium", "Moderate abuse confidence IP", text, "medium"))
    return finding, issue


def provider_findings(payloads: DataFrame) -> DataFrame:
    """Add ``finding`` and ``issue`` to recorded payloads (provider, payload, optional ip, error).

    A row with an ``error`` text gives an error finding that contributes no score.
    """
    none = F.lit(None).cast("string")
    ip = F.col("ip") if "ip" in payloads.columns else none
    error = F.col("error") if "error" in payloads.columns else none
    finding, issue = None, None
    for name in PROVIDERS:
        f, i = parse_payload(name, F.col("payload"), ip, error)
        mine = F.col("provider") == name
        finding = F.when(mine, f) if finding is None else finding.when(mine, f)
        issue = F.when(mine, i) if issue is None else issue.when(mine, i)
    return payloads.withColumns({"finding": finding, "issue": issue})


def parse_payload(provider: str, payload: Column, ip: Column, error: Column) -> tuple[Column, Column]:
    """Finding and issue of one payload of a known provider."""
    finding, issue = {
        "virustotal": lambda: virustotal(payload),
        "urlscan": lambda: urlscan(payload),
        "abuseipdb": lambda: abuseipdb(payload, ip),
    }[provider]()
    failed = F.struct(
        F.lit(provider).alias("provider"), F.lit(0).alias("score"), F.lit(0.2).alias("confidence"),
        F.concat(F.lit(f"{provider} lookup failed: "), error).alias("summary"),
        F.lit("error").alias("verdict")).cast(FINDING_DDL)
    return F.when(error.isNotNull(), failed).otherwise(finding), F.when(error.isNull(), issue)


def intel_score(findings: Column) -> Column:
    """Strongest active score, plus 8 for each further provider at 45 or more."""
    scores = F.transform(
        F.filter(findings, lambda f: ~f["verdict"].isin("error", "submitted")), lambda f: f["score"])
    corroborated = F.size(F.filter(scores, lambda s: s >= 45))
    return F.coalesce(
        F.least(F.lit(100), F.array_max(scores) + F.greatest(F.lit(0), corroborated - 1) * 8), F.lit(0))


def intel_confidence(findings: Column) -> Column:
    """Mean confidence of the findings that did not fail, .2 without any."""
    usable = F.filter(findings, lambda f: f["verdict"] != "error")
    total = F.aggregate(usable, F.lit(0.0), lambda a, f: a + f["confidence"])
    return F.when(
        F.size(usable) > 0,
        T.py_round(T.clamp(total / F.greatest(F.size(usable), F.lit(1)), 0.25, 0.99), 2),
    ).otherwise(F.lit(0.2))


def intel_results(payloads: DataFrame, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """One row per key: the latest finding of each provider, fused.

    The providers are a fixed short list, so the result is a fixed set of ``max_by``
    aggregates that combine before the shuffle; no finding list is ever collected, and
    only the surviving payloads are parsed.
    """
    keys = keys or ["url"]
    none = F.lit(None).cast("string")
    raw = F.struct(
        F.col("payload").alias("payload"),
        (F.col("ip") if "ip" in payloads.columns else none).alias("ip"),
        (F.col("error") if "error" in payloads.columns else none).alias("error"),
    )
    latest = payloads.groupBy(*keys).agg(*[
        F.max_by(
            F.when(F.col("provider") == p, raw),
            F.when(F.col("provider") == p, F.struct(F.col(ts), F.col("payload"))),
        ).alias(f"_{p}")
        for p in PROVIDERS
    ], F.max(ts).alias("intel_ts"))

    def parsed(provider: str) -> Column:
        r = F.col(f"_{provider}")
        finding, issue = parse_payload(provider, r["payload"], r["ip"], r["error"])
        return F.when(r.isNotNull(), F.struct(finding.alias("finding"), issue.alias("issue")))

    latest = latest.withColumn("_found", F.array_compact(F.array(*[parsed(p) for p in PROVIDERS])))
    latest = latest.withColumns({
        "intel_findings": F.transform("_found", lambda r: r["finding"]),
        "intel_issues": F.array_compact(F.transform("_found", lambda r: r["issue"])).cast(ISSUES_DDL),
    })
    return latest.withColumns({
        "intel_score": intel_score(F.col("intel_findings")),
        "intel_confidence": intel_confidence(F.col("intel_findings")),
    }).select(*keys, "intel_ts", "intel_score", "intel_confidence", "intel_findings", "intel_issues")


def lookup_cached(
    scans: DataFrame, results: DataFrame, value: list[str], key: str = "url", ts: str = "ts",
    ttl_seconds: int = 900,
) -> DataFrame:
    """As-of lookup with tolerance: latest result at or before the scan, at most ``ttl_seconds`` old.

    Time is cut into coarse slots as long as the tolerance and fine slots of one second. A
    usable result lies in the scan's coarse slot or the one before. Rows are ordered only
    within (key, second); across seconds one pre-aggregated row per second is carried
    forward. No pairs are formed, and a hot key spreads over its seconds.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = ttl_seconds * 1_000_000
    hit = F.struct(micros.alias("at"), *[F.col(v) for v in value])
    fine, coarse = F.floor(F.col("_at") / 1_000_000), F.floor(F.col("_at") / width)
    r = results.select(
        F.col(key), micros.alias("_at"), F.lit(0).alias("_kind"), hit.alias("_hit"))
    hit_type = r.schema["_hit"].dataType
    scan_columns = scans.columns
    s = scans.select(
        F.col(key), micros.alias("_at"), F.lit(1).alias("_kind"),
        F.struct(*scan_columns).alias("_scan"))
    rows = r.withColumn("_scan", F.lit(None).cast(s.schema["_scan"].dataType)).unionByName(
        s.withColumn("_hit", F.lit(None).cast(hit_type))
    ).withColumns({"_fine": fine, "_coarse": coarse})

    inside = Window.partitionBy(key, "_coarse", "_fine").orderBy("_at", "_kind").rowsBetween(
        Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.last("_hit", ignorenulls=True).over(inside)).filter("_kind = 1")

    seconds = rows.groupBy(key, "_coarse", "_fine").agg(F.max_by("_hit", F.when(
        F.col("_hit").isNotNull(), F.col("_at"))).alias("_last"))
    earlier = Window.partitionBy(key, "_coarse").orderBy("_fine").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = seconds.withColumn("_earlier", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    before = r.withColumn("_coarse", coarse + 1).groupBy(key, "_coarse").agg(
        F.max_by("_hit", "_at").alias("_before"))
    joined = here.join(carried, [key, "_coarse", "_fine"], "left").join(before, [key, "_coarse"], "left")
    best = F.coalesce("_here", "_earlier", "_before")
    fresh = (F.col("_at") - F.col("_best.at")) <= width
    return joined.withColumn("_best", best).select(
        *[F.col(f"_scan.{c}").alias(c) for c in scan_columns],
        F.coalesce(fresh, F.lit(False)).alias("cache_hit"),
        *[F.when(fresh, F.col(f"_best.{v}")).alias(f"cached_{v}") for v in value],
    )
