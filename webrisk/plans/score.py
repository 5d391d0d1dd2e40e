"""The scoring plans: pages, bare URLs and texts to verdicts.

Without findings or interaction logs the whole plan is one stage: scan, source
patterns, one Arrow pass for the parse, then column expressions. Findings and
interaction events are aggregated to one row per URL or page before they are joined,
so a hot URL never multiplies rows; and the joins come last, when sources and texts
have been reduced to evidence.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.operators import dom_rules, evidence as E, html as H, page_features as P
from webrisk.operators import patterns, text_rules, timeline, url_rules, verdict
from webrisk.operators.interaction import EVENTS_DDL
from webrisk.operators.signals import SIGNALS_DDL, no_signals

H_ELEMENTS = f"array<{H.ELEMENT.simpleString()}>"
FINDINGS_DDL = (
    "array<struct<provider:string,score:int,confidence:double,summary:string,verdict:string>>"
)


@dataclass(frozen=True)
class ScoreOptions:
    """Parameters of a scoring plan.

    ``text_limit`` and ``excerpt_chars`` cut the page text that feeds the content rules
    and the text score; None (default) uses whole texts. ``model_sees_page`` says
    whether the 30-feature URL model may look at the page.
    """

    weights: Mapping[str, float] = field(default_factory=lambda: dict(K.COMPONENT_WEIGHTS))
    fix_codes: bool = False
    text_limit: int | None = None
    excerpt_chars: int | None = None
    model_sees_page: bool = True
    url_model_issue: str | None = None
    text_model_issue: str | None = None
    text_model_name: str | None = None
    # confidence credited to reputation when no findings are given (0.2 if providers were reachable)
    intel_confidence_default: float = 0.0
    with_timeline: bool = False
    with_explanation: bool = True


def score_pages(
    pages: DataFrame,
    keys: list[str] | None = None,
    findings: DataFrame | None = None,
    interactions: DataFrame | None = None,
    options: ScoreOptions | None = None,
    started_at: Column | None = None,
) -> DataFrame:
    """Score a table of pages.

    ``pages`` needs ``url``; optional columns are ``html``, ``page_text``,
    ``redirect_chain`` (array), ``domain_created``/``domain_expires`` (dates),
    ``url_probability_in`` (trained model), ``text_model_score`` and
    ``text_model_confidence``. ``findings`` is one row per url from
    ``intel.intel_results``, ``interactions`` one row per key from
    ``interaction.interaction_results``.

    The result keeps the keys and the url and adds verdict, evidence arrays, patterns,
    narrative and (optionally) timeline. A URL that cannot be parsed gets status
    'error' and NULL scores.
    """
    o = options or ScoreOptions()
    keys = keys or ["page_id"]
    missing = {
        "html": F.lit(None).cast("string"), "page_text": F.lit(None).cast("string"),
        "redirect_chain": F.array().cast("array<string>"),
    }
    df = pages.withColumns({c: v for c, v in missing.items() if c not in pages.columns})
    optional = [c for c in (
        "domain_created", "domain_expires", "url_probability_in", "text_model_score",
        "text_model_confidence", "fetch_error") if c in df.columns]
    df = df.select(*keys, "url", "html", "page_text", "redirect_chain", *[
        c for c in optional if c not in keys])
    df = df.withColumn(
        "redirect_chain", F.coalesce("redirect_chain", F.array().cast("array<string>")))
    df = dom_rules.source_flags(df)
    df = P.model_source_flags(df) if o.model_sees_page else P.without_page(df)
    df = H.parse_pages(df)
    df = url_rules.with_url_signals(url_rules.with_url_context(df))
    df = dom_rules.with_dom_signals(dom_rules.with_dom_facts(df))

    given = F.coalesce("page_text", F.lit(""))
    seen = F.coalesce("dom_text", F.lit(""))
    if o.text_limit is not None:
        seen = F.substring(seen, 1, o.text_limit)
    df = df.withColumn("_text", F.when(given.rlike(r"(?U)\S"), T.strip(given)).otherwise(seen))
    spoken = F.col("_text")
    if o.excerpt_chars is not None:
        spoken = F.substring(spoken, 1, o.excerpt_chars)
    df = df.withColumn("_spoken", F.when(given != "", given).otherwise(spoken))
    # everything that reads tags or texts comes first; afterwards rows are small
    df = _url_features(df, optional, "elements" if o.model_sees_page else None)
    df = df.drop("elements", "dom_text", "page_text").withColumn(
        "_gate", text_rules.phrase_gate(F.lower("_text")))
    df = text_rules.with_content_signals(df, "_text", "_gate")
    df = E.with_context_flags(df, "_text")
    df = _text_score(df, optional)
    df = E.suppress(E.with_domain_trust(df))
    # joins come after sources, tags and texts are gone: a shuffle moves only evidence
    if findings is not None:
        df = df.join(
            findings.select("url", "intel_score", "intel_confidence", "intel_findings", "intel_issues"),
            "url", "left")
    if interactions is not None:
        df = df.join(
            interactions.select(*keys, "interaction_events", "interaction_signals"), keys, "left")
        df = df.withColumns({
            "interaction_events": F.coalesce("interaction_events", F.array().cast(EVENTS_DDL)),
            "interaction_signals": F.coalesce("interaction_signals", no_signals()),
        })
    defaults = {
        "intel_findings": F.array().cast(FINDINGS_DDL),
        "intel_issues": F.array().cast(text_rules.ISSUES_DDL),
        "intel_score": F.lit(0), "intel_confidence": F.lit(o.intel_confidence_default),
    }
    df = df.withColumns({
        name: F.coalesce(name, value) if name in df.columns else value
        for name, value in defaults.items()
    })
    return _finish(df, keys, o, optional, started_at, has_url=True)


def _url_features(df: DataFrame, optional: list[str], elements: str | None) -> DataFrame:
    if elements is None:
        elements = "_no_elements"
        df = df.withColumn(elements, F.array().cast(H_ELEMENTS))
    return P.with_page_features(
        df,
        "domain_created" if "domain_created" in optional else None,
        "domain_expires" if "domain_expires" in optional else None,
        elements=elements,
    )


def _text_score(df: DataFrame, optional: list[str]) -> DataFrame:
    return text_rules.with_text_score(
        df, "_spoken",
        "text_model_score" if "text_model_score" in optional else None,
        "text_model_confidence" if "text_model_confidence" in optional else None,
        "_gate" if "_gate" in df.columns else None,
    ).drop("_text", "_spoken", "_gate")


def score_texts(
    texts: DataFrame, keys: list[str], text: str = "text", options: ScoreOptions | None = None,
    started_at: Column | None = None,
) -> DataFrame:
    """Score texts without a URL: no URL model, no page, no reputation."""
    o = options or ScoreOptions()
    df = texts.select(*keys, F.lit("https://local-text-analysis.invalid").alias("url"),
                      F.col(text).alias("_spoken"))
    df = df.withColumns({
        "_text": T.strip(F.coalesce("_spoken", F.lit(""))),
        "redirect_chain": F.array().cast("array<string>"),
        "intel_findings": F.array().cast(FINDINGS_DDL),
        "intel_issues": F.array().cast(text_rules.ISSUES_DDL),
        "intel_score": F.lit(0), "intel_confidence": F.lit(0.0),
        "dom_signals": no_signals(), "analytics_context": F.lit(False),
    })
    df = url_rules.with_url_signals(url_rules.with_url_context(df))
    df = df.withColumn("_gate", text_rules.phrase_gate(F.lower("_text")))
    df = text_rules.with_content_signals(df, "_text", "_gate")
    df = _text_score(E.with_context_flags(df, "_text"), [])
    df = E.suppress(E.with_domain_trust(df))
    return _finish(df, keys, o, [], started_at, has_url=False)


def _finish(
    df: DataFrame, keys: list[str], o: ScoreOptions, optional: list[str],
    started_at: Column | None, has_url: bool,
) -> DataFrame:
    if "interaction_signals" in df.columns:
        df = df.withColumn(
            "dom_signals", E.append_new_codes(F.col("dom_signals"), F.col("interaction_signals")))
    if has_url:
        df = P.with_url_score(
            df, "url_probability_in" if "url_probability_in" in optional else None)
        df = E.calibrate_url_score(df)
        model_rows = F.concat(
            E.url_model_rows(df, o.url_model_issue),
            E.text_model_rows(o.text_model_issue),
            E.issue_rows(F.col("url_issues"), "model", "url-model"),
        )
    else:
        df = df.withColumns({
            "calibrated_url_score": F.lit(0), "url_confidence": F.lit(0.0), "url_score": F.lit(0),
            "privacy_score": F.lit(None).cast("int"),
        })
        model_rows = E.text_model_rows(o.text_model_issue)
    df = df.withColumns({
        "model_signals": model_rows.cast(SIGNALS_DDL),
        "content_signals": F.concat(
            F.col("content_signals"), E.issue_rows(F.col("text_issues"), "content", "language-anomaly")
        ).cast(SIGNALS_DDL),
        "reputation_signals": F.concat(
            E.reputation_rows(F.col("intel_findings")),
            E.issue_rows(F.col("intel_issues"), "reputation", "provider-alert"),
        ).cast(SIGNALS_DDL),
    })
    df = patterns.with_narrative(patterns.with_attack_patterns(df))
    df = verdict.with_component_scores(df, o.fix_codes)
    df = verdict.with_risk_score(df, o.weights, o.fix_codes)
    df = verdict.with_verdict_details(df)
    out = [*keys, "url", "normalized_url", "hostname", "status"]
    broken = (F.col("bad_port") | F.col("bad_netloc")) if has_url else F.lit(False)
    df = df.withColumn("status", F.when(broken, "error").otherwise("ok"))
    if o.with_explanation:
        df = verdict.with_explanation(
            df, "url" if has_url else None, o.url_model_issue, o.text_model_name,
            fetch_error="fetch_error" if "fetch_error" in optional else None)
        out += ["explanation", "detected_patterns"]
    if o.with_timeline:
        df = timeline.with_timeline(df, started_at)
        out.append("timeline")
    verdict_columns = {"risk_score": "int", "classification": "string", "confidence": "double"}
    df = df.withColumns({
        name: F.when(F.col("status") == "ok", F.col(name)).cast(kind)
        for name, kind in verdict_columns.items()
    })
    weighted = F.struct(*[
        T.py_round(F.col(f"_w_{c}"), 2).alias(c) for c in verdict.COMPONENTS])
    df = df.withColumn("weighted_components", weighted)
    out += [
        "risk_score", "classification", "confidence", "risk_cap", "strong_rows",
        *verdict.COMPONENTS, "weighted_components", "url_score", "calibrated_url_score",
        "url_confidence", "text_score", "text_confidence", "text_sub_scores", "intel_score",
        "privacy_score", "is_trusted", "trust_score", "trust_category", "trust_reasons",
        "url_signals", "dom_signals", "content_signals", "reputation_signals", "model_signals",
        "suppressed", "attack_patterns", "top_evidence", "detected_issues", "signal_counts",
        "indicators", "reason_chain", "summary", "recommended_actions", "calibration_notes",
        "coercion_score", "narrative_summary", *[flag for flag, _, _, _ in K.NARRATIVE],
        "redirect_chain",
    ]
    if "interaction_events" in df.columns:
        out.append("interaction_events")
    return df.select(*out)


def score_urls(urls: DataFrame, keys: list[str], options: ScoreOptions | None = None) -> DataFrame:
    """Score bare URLs: no page is fetched, nothing goes through Python."""
    o = options or ScoreOptions()
    df = urls.select(*keys, *([] if "url" in keys else ["url"]))
    df = df.withColumns({
        "_text": F.lit(""), "_spoken": F.lit(""),
        "redirect_chain": F.array().cast("array<string>"),
        "intel_findings": F.array().cast(FINDINGS_DDL),
        "intel_issues": F.array().cast(text_rules.ISSUES_DDL),
        "intel_score": F.lit(0), "intel_confidence": F.lit(o.intel_confidence_default),
        "dom_signals": no_signals(), "content_signals": no_signals(),
        "analytics_context": F.lit(False),
    })
    df = P.without_page(df)
    df = url_rules.with_url_signals(url_rules.with_url_context(df))
    df = _url_features(df, [], None)
    df = _text_score(E.with_context_flags(df, "_text"), [])
    df = E.suppress(E.with_domain_trust(df))
    return _finish(df, keys, o, [], None, has_url=True)

def threat_report(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One nested report document per row as JSON text."""
    report = F.struct(
        F.struct(
            F.col("classification").alias("threat_level"),
            F.col("summary").alias("executive_summary"),
            F.col("reason_chain").alias("reasoning_chain"),
            "recommended_actions",
            F.struct(*verdict.COMPONENTS).alias("component_scores"),
            F.col("weighted_components").alias("weighted_contributions"),
            "indicators", "signal_counts",
            F.col("top_evidence").alias("evidence"), "attack_patterns",
            F.struct("coercion_score", *[flag for flag, _, _, _ in K.NARRATIVE],
                     F.col("text_sub_scores").alias("nlp_sub_scores"), "narrative_summary",
                     ).alias("social_engineering_analysis"),
            *(["timeline"] if "timeline" in scored.columns else []),
        ).alias("threat_report"),
        F.struct(
            "normalized_url", "redirect_chain", "url_signals", "dom_signals", "content_signals",
            "reputation_signals", "model_signals", "attack_patterns",
            F.struct(
                F.struct("is_trusted", "trust_score", "trust_category", "trust_reasons").alias("domain_trust"),
                F.col("suppressed").alias("suppressed_detections"),
            ).alias("metadata"),
        ).alias("technical_findings"),
    )
    return scored.select(*keys, F.to_json(report).alias("report"))


__all__ = ["ScoreOptions", "score_pages", "score_texts", "score_urls", "threat_report"]
