"""Fusion of evidence into component scores, risk score, class, confidence and texts.

All steps are expressions over the evidence arrays of one row: a page corpus is
scored in the stage that parsed it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.functions.plan import sealed
from webrisk.operators.signals import BUCKETS, SIGNALS_DDL, has_code, is_severe, search_text

COMPONENTS = list(K.COMPONENT_WEIGHTS)


def _codes(codes: list[str], fix_codes: bool) -> list[str]:
    return [K.EMITTED_SPELLING.get(c, c) for c in codes] if fix_codes else codes


def is_strong(s: Column, fix_codes: bool = False) -> Column:
    return (
        s["code"].isin(_codes(K.STRONG_CODES, fix_codes))
        | (s["category"].isin("credential-harvest", "behavioral-flow") & is_severe(s["severity"]))
        | (s["severity"] == "critical")
    )


def is_weak(s: Column) -> Column:
    return s["code"].isin(K.WEAK_CODES) | search_text(s).rlike("|".join(K.WEAK_WORDS_SCORING))


def classify(score: Column) -> Column:
    expr = None
    for bound, name in K.CLASS_BOUNDS:
        expr = F.when(score < bound, name) if expr is None else expr.when(score < bound, name)
    return expr.otherwise(K.CLASSES[-1])


def class_rank(name: Column) -> Column:
    return T.rank_of(name, K.CLASSES)


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= 70, "High").when(score >= 40, "Elevated").when(score >= 20, "Low")
        .otherwise("Minimal")
    )


def with_component_scores(df: DataFrame, fix_codes: bool = False) -> DataFrame:
    """Add the component scores and set every row's escalation contribution."""
    trusted = F.col("is_trusted")

    def tag(bucket: str) -> Column:
        return F.transform(
            F.col(f"{bucket}_signals"),
            lambda s: F.struct(
                F.lit(bucket).alias("bucket"), s.alias("s"), is_weak(s).alias("weak"),
                is_strong(s, fix_codes).alias("strong"),
            ),
        )

    df = df.withColumn("_rows", F.concat(*[tag(b) for b in BUCKETS]))
    df = df.withColumn("strong_rows", F.size(F.filter("_rows", lambda r: r["strong"])))
    any_strong = F.col("strong_rows") > 0

    def points(r: Column) -> Column:
        s = r["s"]
        value = (
            s["score_impact"] * T.lookup(s["severity"], K.SEVERITY_MULTIPLIER, 1.0)
            * T.clamp(s["reliability"], 0.35, 1.0)
            * F.when(r["weak"], 0.22).otherwise(1.0)
            * F.when(trusted & r["weak"], 0.35).when(trusted, 0.8).otherwise(1.0)
        )
        return F.when(r["weak"] & ~any_strong, F.lit(None)).otherwise(value)

    df = df.withColumn("_rows", F.transform("_rows", lambda r: F.struct(
        r["bucket"].alias("bucket"), r["s"].alias("s"), r["weak"].alias("weak"),
        r["strong"].alias("strong"), points(r).alias("points"),
    )))

    def bucket_score(bucket: str) -> Column:
        total = F.aggregate(
            F.filter("_rows", lambda r: r["bucket"] == bucket),
            F.lit(0.0), lambda a, r: a + F.coalesce(r["points"], F.lit(0.0)),
        )
        return T.clamp(T.round_int(total), 0, 100)

    df = df.withColumns({f"{b}_rule_score": bucket_score(b) for b in BUCKETS})
    settled = F.transform("_rows", lambda r: F.struct(
        r["bucket"].alias("bucket"),
        r["s"].withField(
            "escalation_contribution",
            F.when(r["points"].isNull(), 0).otherwise(
                F.greatest(r["s"]["escalation_contribution"], T.round_int(r["points"]))),
        ).alias("s"),
    ))
    df = df.withColumn("_settled", settled)

    def untag(bucket: str) -> Column:
        mine = F.filter("_settled", lambda r: r["bucket"] == bucket)
        return F.transform(mine, lambda r: r["s"]).cast(SIGNALS_DDL)

    df = df.withColumns({f"{b}_signals": untag(b) for b in BUCKETS})
    hops = F.size("redirect_chain")
    behavior = F.aggregate(
        F.filter("dom_signals", lambda s: s["code"].isin(K.REDIRECT_CODES)),
        F.lit(0), lambda a, s: a + s["score_impact"],
    )
    chain = F.when(hops >= 1, F.least(F.lit(65), hops * 22)).otherwise(0)
    df = df.withColumns({
        "phishing_probability": F.greatest(
            "url_rule_score", "model_rule_score", T.clamp(F.col("calibrated_url_score"), 0, 100)),
        "dom_suspicion": F.col("dom_rule_score"),
        "content_scam_score": F.greatest("content_rule_score", T.clamp(F.col("text_score"), 0, 100)),
        "reputation_score": F.greatest("reputation_rule_score", T.clamp(F.col("intel_score"), 0, 100)),
        "redirect_risk": T.clamp(chain + F.least(F.lit(35), behavior), 0, 100),
    })
    df = df.drop("_rows", "_settled", *[f"{b}_rule_score" for b in BUCKETS])
    return sealed(df, ["strong_rows", *[f"{b}_signals" for b in BUCKETS], *COMPONENTS])


def with_risk_score(
    df: DataFrame, weights: Mapping[str, float] | None = None, fix_codes: bool = False
) -> DataFrame:
    """Add weighted components, risk_score, risk_cap, classification and calibration_notes."""
    weights = dict(weights or K.COMPONENT_WEIGHTS)
    df = df.withColumns({f"_w_{c}": F.col(c) * F.lit(float(weights[c])) for c in COMPONENTS})
    total = sum((F.col(f"_w_{c}") for c in COMPONENTS[1:]), F.col(f"_w_{COMPONENTS[0]}"))
    every = F.concat(*[F.col(f"{b}_signals") for b in BUCKETS])
    df = df.withColumns({
        "_all": every,
        "_raw": T.round_int(total),
        "_pattern": F.exists("attack_patterns", lambda p: p["confidence"] >= 0.72),
        "_social": F.exists(
            "attack_patterns",
            lambda p: (p["code"] == "social-engineering-scam") & (p["confidence"] >= 0.72),
        )
        & has_code(F.col("content_signals"), K.SOCIAL_CONTENT_CODES)
        & has_code(F.col("url_signals"), K.SOCIAL_URL_CODES),
        "_cluster": F.size(F.filter(
            "dom_signals",
            lambda s: s["code"].isin(_codes(K.DOM_CLUSTER_CODES, fix_codes))
            & s["severity"].isin("medium", "high", "critical"),
        )) >= 2,
    })
    raw, trusted, strong = F.col("_raw"), F.col("is_trusted"), F.col("strong_rows")
    df = df.withColumns({
        "_calm": ~F.col("_pattern") & ~has_code(F.col("_all"), K.BEHAVIOR_CODES)
        & ~has_code(F.col("_all"), _codes(K.DOM_ABUSE_CODES, fix_codes)),
        "_trust_cap": trusted & (strong == 0),
        "_thin": (raw >= 50) & (strong < 2) & ~F.col("_pattern"),
        "_dom_lift": ~trusted & F.col("_cluster") & (raw < 26),
    })
    lifted = F.when(F.col("_dom_lift"), F.lit(26)).otherwise(raw)
    social_lift = ~trusted & F.col("_social") & (lifted < 26)
    df = df.withColumns({"_lifted": lifted, "_social_lift": social_lift})
    lifted = F.when(F.col("_social_lift"), F.lit(26)).otherwise(F.col("_lifted"))
    cap = F.least(
        F.when(F.col("_calm"), 20), F.when(F.col("_trust_cap"), 12), F.when(F.col("_thin"), 45),
    )
    notes = F.array_compact(F.array(
        F.when(F.col("_calm"), K.NOTE_NO_BEHAVIOR),
        F.when(F.col("_calm"), K.NOTE_WEAK_IGNORED),
        F.when(F.col("_trust_cap"), K.NOTE_TRUSTED),
        F.when(F.col("_thin"), K.NOTE_CAPPED),
        F.when(F.col("_dom_lift"), K.NOTE_DOM_LIFT),
        F.when(F.col("_social_lift"), K.NOTE_SOCIAL_LIFT),
    ))
    df = df.withColumns({"risk_cap": cap.cast("int"), "calibration_notes": notes, "_lifted": lifted})
    df = df.withColumn("risk_score", T.clamp(F.least("_lifted", "risk_cap"), 0, 100).cast("int"))
    df = df.withColumn("classification", classify(F.col("risk_score"))).drop(
        "_raw", "_pattern", "_social", "_cluster", "_calm", "_trust_cap", "_thin", "_dom_lift",
        "_lifted", "_social_lift",
    )
    return sealed(df, [
        *[f"_w_{c}" for c in COMPONENTS], "_all", "risk_cap", "calibration_notes", "risk_score",
        "classification",
    ])


def rank_signals(signals: Column, limit: int) -> Column:
    """Strongest signals first: severity, reliability, impact, confidence, then arrival."""
    order = F.array_sort(F.transform(signals, lambda s, i: F.struct(
        (-T.rank_of(s["severity"], K.SEVERITIES)).alias("a"), (-s["reliability"]).alias("b"),
        (-s["score_impact"]).alias("c"), (-s["confidence"]).alias("d"), i.alias("i"),
    )))
    return F.transform(
        F.slice(order, 1, limit), lambda o: F.element_at(signals, o["i"] + 1)
    ).cast(SIGNALS_DDL)


def component_ranking() -> Column:
    """Components by weighted contribution, largest first, ties in component order."""
    return F.array_sort(F.array(*[
        F.struct((-F.col(f"_w_{c}")).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("name"))
        for i, c in enumerate(COMPONENTS)
    ]))


def with_verdict_details(df: DataFrame) -> DataFrame:
    """Add top_evidence, confidence, signal_counts, indicators, reason_chain, summary,
    recommended_actions and detected_issues."""
    every = F.col("_all")
    df = sealed(df.withColumn("top_evidence", rank_signals(every, 14)), ["top_evidence"])
    top = F.col("top_evidence")
    populated = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in COMPONENTS), F.lit(0))
    severe = F.size(F.filter(top, lambda s: is_severe(s["severity"])))
    confidence = (
        F.lit(0.34)
        + F.least(F.lit(1.0), F.size(top) / F.lit(10.0)) * 0.22
        + populated / F.lit(5) * 0.18
        + F.least(F.lit(1.0), severe / F.lit(5.0)) * 0.1
        + T.clamp(F.col("url_confidence"), 0.0, 1.0) * 0.08
        + T.clamp(F.col("text_confidence"), 0.0, 1.0) * 0.04
        + T.clamp(F.col("intel_confidence"), 0.0, 1.0) * 0.04
    )
    rounded = T.py_round(T.clamp(confidence, 0.15, 0.99), 2)
    capped = F.col("risk_cap").isNotNull() & (F.col("strong_rows") == 0)

    def severity_count(name: str) -> Column:
        return F.size(F.filter(every, lambda s: s["severity"] == name)).alias(name)

    sources = ["url", "dom", "interaction", "content", "reputation", "model"]

    def codes_of(source: str) -> Column:
        mine = F.filter(every, lambda s: s["source"] == source)
        codes = F.array_sort(F.array_distinct(F.transform(mine, lambda s: s["code"])))
        return F.struct(F.lit(source).alias("key"), codes.alias("value"))

    per_source = F.filter(
        F.array(*[codes_of(src) for src in sources]), lambda e: F.size(e["value"]) > 0
    )
    df = df.withColumns({
        "confidence": F.when(capped, F.least(rounded, F.lit(0.62))).otherwise(rounded),
        "signal_counts": F.struct(
            F.size(every).alias("total"), *[severity_count(s) for s in reversed(K.SEVERITIES)]
        ),
        "indicators": F.map_from_entries(per_source),
        "_ranking": component_ranking(),
    })

    def two(value: Column) -> Column:
        return F.format_string("%.2f", T.py_round(value, 2))

    lines = F.transform(F.slice(top, 1, 6), lambda s: F.concat(
        s["title"], F.lit(": "), s["description"], F.lit(" (confidence "), two(s["confidence"]),
        F.lit(", reliability "), two(s["reliability"]), F.lit(", escalation +"),
        s["escalation_contribution"].cast("string"), F.lit(")"),
    ))
    shares = F.transform(F.slice("_ranking", 1, 2), lambda r: F.concat(
        F.lit("Component '"), r["name"], F.lit("' contributed "),
        F.format_string("%.1f", T.py_round(-r["k"], 1)), F.lit(" risk points."),
    ))
    lead = F.array_join(F.transform(F.slice(top, 1, 3), lambda s: s["title"]), ", ")
    name, notes = F.col("classification"), F.col("calibration_notes")
    summary = (
        F.when((F.size(notes) > 0) & (name == "Safe"), K.SUMMARY_SAFE_NOTES)
        .when((F.size(top) == 0) & (name == "Safe"), K.SUMMARY_SAFE_EMPTY)
        .when(F.size(top) == 0, K.SUMMARY_EMPTY)
        .when(name.isin("Critical", "Dangerous"), F.format_string(K.SUMMARY_HOSTILE, F.upper(name), lead))
        .when(name == "Suspicious", F.format_string(K.SUMMARY_SUSPICIOUS, lead))
        .otherwise(F.format_string(K.SUMMARY_SAFE, lead))
    )
    by_class = None
    for key, texts in K.CLASS_ACTIONS.items():
        rows = T.string_array(texts)
        by_class = F.when(name == key, rows) if by_class is None else by_class.when(name == key, rows)
    by_code = F.array_compact(F.array(*[
        F.when(has_code(top, codes), F.lit(action)) for codes, action in K.CODE_ACTIONS
    ]))
    df = df.withColumns({
        "reason_chain": F.concat(lines, shares, F.slice(notes, 1, 3)),
        "summary": summary,
        "recommended_actions": F.slice(F.array_distinct(F.concat(by_code, by_class)), 1, 6),
        "detected_issues": F.transform(first_per_code(top), lambda s: F.struct(
            s["code"].alias("code"), s["title"].alias("title"),
            s["description"].alias("description"), s["severity"].alias("severity"))),
    })
    return df


def first_per_code(signals: Column) -> Column:
    """Keep the first signal of every code, in order."""
    return F.filter(
        signals,
        lambda s, i: F.array_position(
            F.transform(signals, lambda x: x["code"]), s["code"]).cast("int") == i + 1,
    )


def with_explanation(
    df: DataFrame,
    url: str | None = "url",
    model_issue: str | None = None,
    text_model_name: str | None = None,
    intel_notes: str | None = None,
    fetch_error: str | None = None,
) -> DataFrame:
    """Add ``explanation``, the ordered text segments joined by blanks."""
    top, patterns, notes = F.col("top_evidence"), F.col("attack_patterns"), F.col("calibration_notes")
    first = F.try_element_at(top, F.lit(1))
    has = F.size(top) > 0
    segments = [
        F.format_string("Threat classification: %s (%d/100).", F.col("classification"), F.col("risk_score")),
        F.when(has, F.concat(
            F.lit("Lead indicator: "), first["title"], F.lit(" ["), first["code"],
            F.lit("] with confidence "), T.py_round(first["confidence"], 2).cast("string"), F.lit("."))),
        F.when(has, F.format_string(
            "Correlated evidence count: %d signals across URL, DOM, content, model, and reputation.",
            F.col("signal_counts")["total"])),
        F.col("summary"),
    ]
    if url:
        segments.append(F.when(F.coalesce(F.col(url), F.lit("")) != "", F.concat(
            F.lit("Target analyzed: "), F.col(url), F.lit("."))))
    if text_model_name:
        segments.append(F.lit(f"NLP inference artifact: {text_model_name}."))
    if model_issue:
        segments.append(F.lit(f"URL model runtime note: {model_issue}."))
    if intel_notes:
        segments.append(F.array_join(F.slice(F.col(intel_notes), 1, 2), " "))
    if fetch_error:
        segments.append(F.concat(F.lit("DOM collection warning: "), F.col(fetch_error), F.lit(".")))
    segments += [
        F.when(F.col("is_trusted"), F.format_string(
            "Trusted domain context detected (trust score %d/100); weak contextual indicators were "
            "suppressed unless strong phishing behavior was present.", F.col("trust_score"))),
        F.when(F.size("suppressed") > 0, F.format_string(
            "Calibration layer downgraded %d low-context indicators to reduce false positives.",
            F.size("suppressed"))),
        F.when(F.size(notes) > 0, F.array_join(F.slice(notes, 1, 3), " ")),
        F.when(has, F.concat(
            F.lit("Primary forensic findings: "),
            F.array_join(F.transform(F.slice(top, 1, 4), lambda s: F.concat(
                s["title"], F.lit(" ("), s["source"], F.lit("/"), s["severity"], F.lit(", impact "),
                s["score_impact"].cast("string"), F.lit(")"))), "; "),
            F.lit("."))),
    ]
    if "interaction_events" in df.columns:
        segments.append(F.when(F.size("interaction_events") > 0, F.format_string(
            "Interaction simulation executed %d controlled probes, revealing dynamic phishing behavior "
            "not present in static inspection.", F.size("interaction_events"))))
    segments += [
        F.when(F.size(patterns) > 0, F.concat(
            F.lit("Likely attack patterns: "),
            F.array_join(F.transform(F.slice(patterns, 1, 4), lambda p: p["title"]), ", "), F.lit("."))),
        F.col("narrative_summary"),
    ]
    trimmed = [F.nullif(T.strip(s), F.lit("")) for s in segments]
    detected = F.when(has, F.transform(F.slice(top, 1, 10), lambda s: s["code"])).otherwise(
        F.array(F.lit("no-strong-patterns")))
    return df.withColumns({"explanation": F.concat_ws(" ", *trimmed), "detected_patterns": detected})


def key_findings(df: DataFrame) -> DataFrame:
    """Add ``key_findings`` (five distinct short texts) and ``issue_list`` (ten rows) for display."""
    top = F.col("top_evidence")
    order = F.array_sort(F.transform(top, lambda s, i: F.struct(
        (-T.rank_of(s["severity"], K.SEVERITIES)).alias("a"), (-s["score_impact"]).alias("b"), i.alias("i"))))
    ranked = F.transform(order, lambda o: F.element_at(top, o["i"] + 1))
    df = df.withColumn("_ranked", ranked)

    def short(text: Column) -> Column:
        return F.when(F.length(text) <= 120, text).otherwise(F.concat(F.substring(text, 1, 119), F.lit("…")))

    texts = F.transform(F.slice("_ranked", 1, 5), lambda s: short(
        T.strip(F.regexp_replace(F.concat_ws(": ", s["title"], s["description"]), r"\s+", " "))))
    none = "No significant phishing behavior indicators were detected in this investigation run."
    return df.withColumns({
        "key_findings": F.when(F.size(top) > 0, F.slice(F.array_distinct(texts), 1, 5)).otherwise(
            F.array(F.lit(none))),
        "issue_list": F.transform(F.slice("_ranked", 1, 10), lambda s: s["code"]),
    }).drop("_ranked")


def behavior_findings(df: DataFrame) -> DataFrame:
    """Add ``behavior_findings``: DOM signals that come from interaction or describe behavior."""
    return df.withColumn("behavior_findings", F.filter("dom_signals", lambda s: (
        s["code"].startswith("interaction-") | s["category"].contains("behavior")
        | s["category"].contains("credential"))))
