"""Context, suppression and the evidence rows derived from scores and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.operators.signals import (
    SIGNAL_DDL, SIGNALS_DDL, has_code, is_severe, no_signals, search_text, signal,
)

_RECORD_DDL = (
    "struct<step:int,code:string,reason:string,original_severity:string,original_impact:int,"
    "original_confidence:double,severity:string,score_impact:int,confidence:double>"
)
_RULE_DDL = (
    "array<struct<step:int,active:boolean,weak_only:boolean,codes:array<string>,"
    "penalty:int,confidence_penalty:double,reason:string>>"
)


def with_domain_trust(df: DataFrame) -> DataFrame:
    """Add trust_score, is_trusted, trust_category and trust_reasons of a host.

    Works on the columns of ``url_rules.with_url_context``. The enterprise test is a
    plain suffix test on text, so a longer name ending in a listed domain also counts.
    """
    host, base = F.col("hostname"), F.lower(F.col("base_domain"))
    url = F.lower(F.col("normalized_url"))
    after_first = F.when(base.contains("."), F.regexp_replace(base, r"^[^.]*\.", "")).otherwise("")
    enterprise = F.lit(False)
    for name in K.TRUSTED_ENTERPRISE_DOMAINS:
        enterprise = enterprise | host.endswith(name) | base.endswith(name)
    df = df.withColumns({
        "_tr_suffix": F.col("tld").isin(K.TRUSTED_SUFFIXES) | after_first.isin(K.TRUSTED_SUFFIXES),
        "_tr_enterprise": enterprise,
        "_tr_transport": T.contains_any(host, K.TRANSPORT_WORDS),
        "_tr_oauth": T.contains_any(url, K.OAUTH_URL_HINTS),
    })
    points = sum(
        (F.when(F.col(f"_tr_{k}"), p).otherwise(0) for k, p in K.TRUST_POINTS.items()), F.lit(0)
    )
    df = df.withColumn("trust_score", T.clamp(points, 0, 100))
    category = (
        F.when(F.col("_tr_enterprise"), "trusted-provider")
        .when(F.col("_tr_suffix"), "public-sector")
        .when(F.col("_tr_transport"), "transport-portal")
        .when(F.col("_tr_oauth"), "trusted-auth")
        .otherwise("untrusted")
    )
    reasons = F.array_compact(F.array(*[
        F.when(F.col(f"_tr_{k}"), K.TRUST_REASONS[k]) for k in K.TRUST_POINTS
    ]))
    return df.withColumns({
        "is_trusted": F.col("trust_score") >= 45,
        "trust_category": category,
        "trust_reasons": F.when(F.size(reasons) > 0, reasons).otherwise(
            F.array(F.lit(K.TRUST_REASONS["none"]))),
    }).drop(*[f"_tr_{k}" for k in K.TRUST_POINTS])


def with_context_flags(df: DataFrame, text: str) -> DataFrame:
    """Add oauth/mfa/notification context of URL and text (analytics comes from the source)."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_ctx", lowered)
    return df.withColumns({
        "oauth_context": T.contains_any(F.lower(F.col("normalized_url")), K.OAUTH_URL_HINTS)
        | T.contains_any(F.col("_ctx"), K.OAUTH_TEXT_HINTS),
        "mfa_context": T.contains_any(F.col("_ctx"), K.MFA_HINTS),
        "notification_context": T.contains_any(F.col("_ctx"), K.NOTIFICATION_HINTS),
    }).drop("_ctx")


def _words_pattern(words: list[str]) -> str:
    return "|".join(words)


def is_weak_context(s: Column) -> Column:
    """Weak-context test of the suppression step."""
    return s["code"].isin(K.WEAK_CODES) | search_text(s).rlike(_words_pattern(K.WEAK_WORDS_SUPPRESSION))


def _one_step_down(severity: Column) -> Column:
    steps = {v: K.SEVERITIES[max(0, i - 1)] for i, v in enumerate(K.SEVERITIES)}
    return T.lookup(severity, steps, "low")


def downgrade(s: Column, penalty: Column, confidence_penalty: Column, reason: Column) -> Column:
    """Lower impact, confidence, reliability and severity of one signal, with floors."""
    note = F.create_map(
        F.lit("calibration_note"), reason,
        F.lit("original_signal_state"), F.to_json(F.struct(
            s["severity"].alias("severity"), s["score_impact"].alias("score_impact"),
            s["confidence"].alias("confidence"))),
    )
    old = F.map_filter(
        F.coalesce(s["analyst_details"], F.create_map().cast("map<string,string>")),
        lambda k, v: ~k.isin("calibration_note", "original_signal_state"),
    )
    return F.struct(
        s["code"].alias("code"), s["title"].alias("title"), s["description"].alias("description"),
        _one_step_down(s["severity"]).alias("severity"),
        s["source"].alias("source"), s["category"].alias("category"),
        F.greatest(F.lit(1), s["score_impact"] - penalty).alias("score_impact"),
        F.greatest(F.lit(0.2), T.py_round(s["confidence"] - confidence_penalty, 2)).alias("confidence"),
        F.greatest(F.lit(0.35), T.py_round(s["reliability"] - 0.08, 2)).alias("reliability"),
        reason.alias("reasoning_context"),
        s["escalation_contribution"].alias("escalation_contribution"),
        s["source_module"].alias("source_module"),
        F.map_concat(old, note).alias("analyst_details"),
        s["value"].alias("value"),
    ).cast(SIGNAL_DDL)


def _rule(step, active, weak_only, codes, penalty, confidence_penalty, reason) -> Column:
    return F.struct(
        F.lit(step).alias("step"), active.alias("active"), F.lit(weak_only).alias("weak_only"),
        T.string_array(codes).alias("codes"), F.lit(penalty).alias("penalty"),
        F.lit(confidence_penalty).alias("confidence_penalty"), F.lit(reason).alias("reason"),
    )


def _fold(signals: Column, rules: list[Column]) -> Column:
    """Apply the rules to every signal in order; keeps the audit records per signal."""
    rule_array = F.array(*rules).cast(_RULE_DDL)
    state = f"struct<s:{SIGNAL_DDL},records:array<{_RECORD_DDL}>>"

    def merge(acc: Column, rule: Column) -> Column:
        s = acc["s"]
        hit = rule["active"] & F.when(rule["weak_only"], is_weak_context(s)).otherwise(
            F.array_contains(rule["codes"], s["code"])
        )

        def apply(after: Column) -> Column:
            record = F.struct(
                rule["step"].alias("step"), s["code"].alias("code"), rule["reason"].alias("reason"),
                s["severity"].alias("original_severity"), s["score_impact"].alias("original_impact"),
                s["confidence"].alias("original_confidence"), after["severity"].alias("severity"),
                after["score_impact"].alias("score_impact"), after["confidence"].alias("confidence"),
            ).cast(_RECORD_DDL)
            return F.struct(
                after.alias("s"), F.concat(acc["records"], F.array(record)).alias("records")
            ).cast(state)

        changed = T.let(
            downgrade(s, rule["penalty"], rule["confidence_penalty"], rule["reason"]), apply
        )
        return F.when(hit, changed).otherwise(acc)

    return F.transform(
        signals,
        lambda s: F.aggregate(
            rule_array,
            F.struct(s.alias("s"), F.array().cast(f"array<{_RECORD_DDL}>").alias("records")).cast(state),
            merge,
        ),
    )


def suppress(df: DataFrame) -> DataFrame:
    """Contextual suppression of url/dom/content signals; adds ``suppressed`` audit records.

    Step 1 lowers DOM signals explained by a benign context. Step 2 lowers soft content
    cues when, after step 1, no DOM or content signal is severe. Step 3 lowers weak cues
    on trusted domains. Steps are cumulative, and step 2 has to see the result of step 1.
    """
    context = {
        "oauth": F.col("oauth_context"), "mfa": F.col("mfa_context"),
        "notification": F.col("notification_context"), "analytics": F.col("analytics_context"),
    }
    first = [
        _rule(1, context[flag], False, codes, penalty, cut, reason)
        for flag, codes, penalty, cut, reason in K.SUPPRESS_DOM
    ]
    penalty, cut, reason = K.SUPPRESS_TRUSTED
    trusted = _rule(3, F.col("is_trusted"), True, [], penalty, cut, reason)
    df = df.withColumn("_dom1", _fold(F.col("dom_signals"), first))
    dom1 = F.col("_dom1")
    severe = F.exists(dom1, lambda x: is_severe(x["s"]["severity"])) | F.exists(
        "content_signals", lambda s: is_severe(s["severity"])
    )
    df = df.withColumn("_severe", severe)
    codes, penalty, cut, reason = K.SUPPRESS_CONTENT
    soft = _rule(2, ~F.col("_severe"), False, codes, penalty, cut, reason)
    df = df.withColumns({
        "_url3": _fold(F.col("url_signals"), [trusted]),
        "_dom3": _fold(F.transform(dom1, lambda x: x["s"]), [trusted]),
        "_content3": _fold(F.col("content_signals"), [soft, trusted]),
    })

    def records(column: str, step: int) -> Column:
        return F.filter(
            F.flatten(F.transform(F.col(column), lambda x: x["records"])), lambda r: r["step"] == step
        )

    return df.withColumns({
        "suppressed": F.concat(
            records("_dom1", 1), records("_content3", 2), records("_url3", 3),
            records("_dom3", 3), records("_content3", 3)),
        "url_signals": F.transform("_url3", lambda x: x["s"]),
        "dom_signals": F.transform("_dom3", lambda x: x["s"]),
        "content_signals": F.transform("_content3", lambda x: x["s"]),
    }).drop("_dom1", "_severe", "_url3", "_dom3", "_content3")


def append_new_codes(existing: Column, incoming: Column) -> Column:
    """Append the incoming signals whose code is not present yet, first of each code wins."""
    fresh = F.aggregate(
        incoming,
        existing,
        lambda acc, s: F.when(
            F.exists(acc, lambda e: e["code"] == s["code"]), acc
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return fresh


def calibrate_url_score(df: DataFrame) -> DataFrame:
    """Add ``calibrated_url_score``: the URL score damped by missing corroboration.

    Counts the url, dom and content rows present at this moment (after suppression,
    with interaction rows, before model, issue and reputation rows).
    """
    url = F.lower(F.col("normalized_url"))
    severe = sum(
        (F.size(F.filter(F.col(f"{b}_signals"), lambda s: is_severe(s["severity"])))
         for b in ("url", "dom", "content")),
        F.lit(0),
    )
    behavior = F.lit(False)
    for bucket in ("url", "dom", "content"):
        behavior = behavior | has_code(F.col(f"{bucket}_signals"), K.MODEL_BEHAVIOR_CODES)
    df = df.withColumns({"_severe_rows": severe, "_behavior": behavior})
    score = F.col("url_score")
    score = F.when(T.contains_any(url, K.IDENTITY_HOSTS), F.least(score, F.lit(45))).otherwise(score)
    score = F.when(F.col("is_trusted"), F.least(score, F.lit(35))).otherwise(score)
    n = F.col("_severe_rows")
    df = df.withColumn("_s1", score)
    s1 = F.col("_s1")
    damped = (
        F.when(n == 0, T.round_int(s1 * 0.45)).when(n == 1, T.round_int(s1 * 0.68))
        .when(n == 2, T.round_int(s1 * 0.9)).otherwise(s1)
    )
    df = df.withColumn(
        "_s2", F.when(F.col("_behavior"), damped).otherwise(F.least(damped, F.lit(20)))
    )
    s2 = F.col("_s2")
    final = F.when(F.col("model_loaded"), s2).otherwise(T.round_int(s2 * 0.82))
    return df.withColumn("calibrated_url_score", T.clamp(final, 0, 100)).drop(
        "_severe_rows", "_behavior", "_s1", "_s2"
    )


def py_float_text(value: Column) -> Column:
    """Shortest text of a two-decimal number (0.5, 0.68, 1.0)."""
    return value.cast("string")


def url_model_rows(df: DataFrame, model_issue: str | None = None) -> Column:
    """Evidence of the URL score, and a fallback row where no trained model was used."""
    score, confidence = F.col("calibrated_url_score"), F.col("url_confidence")
    severity = (
        F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")
    )
    impact = F.greatest(F.lit(2), F.floor(score * 0.24).cast("int"))
    main = signal(
        "model-url-phishing-probability", "URL phishing model probability",
        F.format_string(
            "Pretrained URL model produced raw score %d/100 and calibrated score %d/100 with confidence %s.",
            F.col("url_score"), score, py_float_text(confidence)),
        severity, "model", "url-model", impact,
        T.clamp(confidence, 0.2, 0.99), T.clamp(confidence, 0.3, 0.98),
        context="Local URL classifier probability transformed into model evidence signal.",
        module="url_analyzer",
        value=F.to_json(F.struct(
            F.col("url_score").alias("raw_score"), score.alias("calibrated_score"),
            F.col("model_loaded").alias("model_loaded"))),
    )
    fallback = signal(
        "model-url-fallback", "URL model fallback mode",
        "Pretrained model was unavailable during inference; heuristic fallback scoring was applied.",
        "medium", "model", "runtime", 9, 0.74, 0.6,
        context="URL model unavailable; runtime fallback degraded model certainty.",
        contribution=6, module="url_analyzer", value=model_issue,
    )
    return F.array_compact(F.array(main, F.when(~F.col("model_loaded"), fallback))).cast(SIGNALS_DDL)


def text_model_rows(model_issue: str | None = None) -> Column:
    """Evidence of a positive text score, and a warning row when a runtime issue is given."""
    score, confidence = F.col("text_score"), F.col("text_confidence")
    severity = F.when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")
    main = signal(
        "model-text-scam-likelihood", "NLP scam-language likelihood",
        F.format_string(
            "Text model produced score %d/100 with confidence %s (mode: %s).",
            score, py_float_text(confidence), F.col("text_mode")),
        severity, "model", "nlp-model",
        F.greatest(F.lit(3), F.floor(score * 0.24).cast("int")),
        T.clamp(confidence, 0.2, 0.99), T.clamp(confidence, 0.3, 0.95),
        context="Local NLP inference used for social-engineering support scoring.",
        module="text_analyzer",
        value=F.to_json(F.struct(
            F.col("text_mode").alias("runtime_mode"), F.col("text_sub_scores").alias("sub_scores"))),
    )
    rows = [F.when(score > 0, main)]
    if model_issue:
        rows.append(F.when(score > 0, signal(
            "model-text-runtime-warning", "NLP local transformer runtime warning", model_issue,
            "medium", "model", "runtime", 8, 0.7, 0.58,
            context="NLP inference warning reduced model-assisted narrative certainty.",
            contribution=4, module="text_analyzer",
            value=F.to_json(F.struct(F.col("text_mode").alias("runtime_mode"))),
        )))
    return F.array_compact(F.array(*rows)).cast(SIGNALS_DDL)


def issue_rows(issues: Column, source: str, category: str) -> Column:
    """Turn detected issues into evidence with impact by severity."""

    def convert(i: Column) -> Column:
        return signal(
            i["code"], i["title"], i["description"], i["severity"], source, category,
            T.lookup(i["severity"], K.ISSUE_IMPACT, 8), 0.72, 0.68,
            context=f"Converted detection issue from {source} module into normalized signal evidence.",
            module=source,
        )

    return F.transform(F.coalesce(issues, F.array().cast(
        "array<struct<code:string,title:string,description:string,severity:string>>")), convert)


def reputation_rows(findings: Column) -> Column:
    """Evidence of provider findings; pending, failed and zero-score findings give none."""

    def convert(f: Column) -> Column:
        score, confidence = f["score"], f["confidence"]
        return F.when(
            ~f["verdict"].isin("error", "unavailable", "submitted") & (score > 0),
            signal(
                F.concat_ws("-", F.lit("reputation"), f["provider"], f["verdict"]),
                F.concat(F.initcap(f["provider"]), F.lit(" reputation verdict: "), f["verdict"]),
                f["summary"],
                F.when(score >= 75, "high").when(score >= 45, "medium").otherwise("low"),
                "reputation", f["provider"],
                F.greatest(F.lit(4), F.floor(score * 0.25).cast("int")),
                T.clamp(confidence, 0.2, 0.99), T.clamp(confidence, 0.3, 0.98),
                context="External provider verdict correlated with local investigation evidence.",
                module="threat_intel_service",
                value=F.to_json(F.struct(score.alias("provider_score"), f["verdict"].alias("verdict"))),
            ),
        )

    return F.array_compact(F.transform(findings, convert)).cast(SIGNALS_DDL)


__all__ = [
    "with_domain_trust", "with_context_flags", "is_weak_context", "downgrade", "suppress",
    "append_new_codes", "calibrate_url_score", "url_model_rows", "text_model_rows", "issue_rows",
    "reputation_rows", "no_signals",
]
