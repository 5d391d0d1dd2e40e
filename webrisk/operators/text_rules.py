"""Content evidence and the rule-based text score."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.functions.plan import sealed
from webrisk.operators.signals import SIGNALS_DDL, explode_signals, extracted, fired

ISSUES_DDL = "array<struct<code:string,title:string,description:string,severity:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """All matches; a pattern with an inner group shows that group after the match."""
    java = F.lit("(?U)" + pattern)
    found = F.regexp_extract_all(text, java, F.lit(1))
    if re.compile(pattern).groups > 1:
        found = F.zip_with(
            found, F.regexp_extract_all(text, java, F.lit(2)),
            lambda a, b: F.when(F.coalesce(b, F.lit("")) == "", a).otherwise(F.concat_ws(" ", a, b)),
        )
    return F.when(T.contains_any(text, T.anchors(pattern)), found).otherwise(
        F.array().cast("array<string>"))


def phrase_gate(text: Column) -> Column:
    """False when no phrase of the content rules or of the text score can match.

    Both rule sets share most phrases; testing their literals once spares almost every
    text the per-rule searches.
    """
    patterns = [r[4] for r in K.CONTENT_RULES.values()] + [r[0] for r in K.TEXT_SCORE_RULES.values()]
    literals = list(dict.fromkeys(a for p in patterns for a in T.anchors(p)))
    # a literal that contains another one adds nothing
    shortest = [a for a in literals if not any(b != a and b in a for b in literals)]
    return T.contains_any(text, shortest)


def with_content_signals(df: DataFrame, text: str, gate: str | None = None) -> DataFrame:
    """Add ``content_signals``: six phrase rules and the formatting rule.

    ``gate`` names a column with :func:`phrase_gate` of the text; computed here if absent.
    """
    df = df.withColumn("_lowered", F.lower(F.coalesce(F.col(text), F.lit(""))))
    lowered = F.col("_lowered")
    if gate is None:
        gate = "_gate_content"
        df = df.withColumn(gate, phrase_gate(lowered))
    none = F.array().cast("array<string>")
    df = df.withColumns({
        f"_m_{code}": F.when(F.col(gate), _matches(lowered, r[4])).otherwise(none)
        for code, r in K.CONTENT_RULES.items()
    }).drop("_gate_content")
    df = df.withColumns({
        "_bangs": T.count_of(lowered, "!"),
        "_upper_ratio": T.uppercase_ratio(F.coalesce(F.col(text), F.lit(""))),
    })

    def rule(code: str) -> tuple[Column, Column]:
        title, severity, category, base, _ = K.CONTENT_RULES[code]
        matches = F.col(f"_m_{code}")
        hits = F.size(matches)
        return hits > 0, extracted(
            code, title,
            F.format_string(K.CONTENT_DESCRIPTION, hits, F.array_join(F.slice(matches, 1, 3), ", ")),
            severity, "content", category,
            F.least(F.lit(28), F.lit(base) + (hits - 1) * 2),
            F.least(F.lit(0.95), F.lit(0.66) + hits * 0.05),
            value=hits,
        )

    title, severity, category, impact, confidence, description = K.AMPLIFICATION_RULE
    rules = [rule(code) for code in K.CONTENT_RULES]
    rules.append((
        (F.col("_bangs") >= 6) | (F.col("_upper_ratio") >= 0.32),
        extracted(
            "content-emotional-amplification", title, description, severity, "content", category,
            impact, confidence,
            value=F.to_json(F.struct(
                F.col("_bangs").alias("exclamation_count"),
                T.py_round(F.col("_upper_ratio"), 3).alias("uppercase_ratio"))),
        ),
    ))
    drop = ["_lowered", "_bangs", "_upper_ratio"] + [f"_m_{code}" for code in K.CONTENT_RULES]
    return df.withColumn("content_signals", fired(rules)).drop(*drop)


def content_evidence(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Long table of content evidence."""
    return explode_signals(with_content_signals(df.select(*keys, text), text), keys, ["content"])


def with_text_score(
    df: DataFrame, text: str, model_score: str | None = None, model_confidence: str | None = None,
    gate: str | None = None,
) -> DataFrame:
    """Add text_score, text_confidence, text_mode, text_sub_scores (map) and text_issues.

    A precomputed model score may be given as columns; it is fused .45 rules / .55 model.
    """
    df = df.withColumns({
        "_t_raw": F.coalesce(F.col(text), F.lit("")),
    }).withColumn("_t_lower", F.lower(F.col("_t_raw")))
    lowered = F.col("_t_lower")
    if gate is None:
        gate = "_gate_score"
        df = df.withColumn(gate, phrase_gate(lowered))
    df = df.withColumns({
        f"_h_{key}": F.when(F.col(gate), T.pattern_hits(lowered, rule[0])).otherwise(F.lit(0))
        for key, rule in K.TEXT_SCORE_RULES.items()
    } | {
        "_h_pressure": F.when(T.count_of(lowered, "!") >= 6, 5).otherwise(0)
        + F.when(T.all_caps_tokens(F.col("_t_raw")) >= 3, 6).otherwise(0),
        "_t_blank": ~F.col("_t_raw").rlike(r"(?U)\S"),
    })
    scores, issues = {}, []
    for key, (_, base, severity, title) in K.TEXT_SCORE_RULES.items():
        hits = F.col(f"_h_{key}")
        scores[key] = F.when(hits > 0, F.least(F.lit(36), F.lit(base) + (hits - 1) * 4)).otherwise(0)
        issues.append(F.when(hits > 0, F.struct(
            F.lit(f"nlp-{key}").alias("code"),
            F.lit(title).alias("title"),
            F.format_string(K.TEXT_ISSUE_DESCRIPTION, hits).alias("description"),
            F.lit(severity).alias("severity"),
        )))
    code, title, description, severity = K.PRESSURE_ISSUE
    scores["emotional_pressure"] = F.col("_h_pressure")
    issues.append(F.when(F.col("_h_pressure") > 0, F.struct(
        F.lit(code).alias("code"), F.lit(title).alias("title"),
        F.lit(description).alias("description"), F.lit(severity).alias("severity"))))
    entries = []
    for key, value in scores.items():
        entries += [F.lit(key), value.cast("int")]
    blank = F.col("_t_blank")
    df = df.withColumns({
        "text_issues": F.when(blank, F.array().cast(ISSUES_DDL)).otherwise(
            F.array_compact(F.array(*issues)).cast(ISSUES_DDL)),
        "text_sub_scores": F.when(blank, F.create_map().cast("map<string,int>")).otherwise(
            F.create_map(*entries)),
    })
    total = F.aggregate(F.map_values("text_sub_scores"), F.lit(0), lambda a, v: a + v)
    rule_score = T.clamp(total, 0, 100)
    rule_confidence = F.lit(0.42) + F.least(F.lit(0.45), F.size("text_issues") * 0.07)
    score, confidence, mode = rule_score, rule_confidence, F.lit("rules-only")
    if model_score is not None:
        given = F.coalesce(F.col(model_score), F.lit(0)) > 0
        score = F.when(given, T.round_int(rule_score * 0.45 + F.col(model_score) * 0.55)).otherwise(score)
        other = F.col(model_confidence) if model_confidence else F.lit(0.0)
        confidence = F.when(
            given, F.least(F.lit(0.99), F.greatest(rule_confidence, F.coalesce(other, F.lit(0.0))))
        ).otherwise(confidence)
        mode = F.when(given, F.lit("local-transformer")).otherwise(mode)
    df = df.withColumns({
        "text_score": F.when(blank, 0).otherwise(T.clamp(score, 0, 100)).cast("int"),
        "text_confidence": F.when(blank, 0.0).otherwise(
            T.py_round(T.clamp(confidence, 0.1, 0.99), 2)),
        "text_mode": F.when(blank, F.lit("empty")).otherwise(mode),
    })
    drop = ["_gate_score", "_t_raw", "_t_lower", "_t_blank", "_h_pressure"] + [f"_h_{k}" for k in K.TEXT_SCORE_RULES]
    return df.drop(*drop)


def text_scores(
    df: DataFrame, keys: list[str], text: str = "text",
    model_score: str | None = None, model_confidence: str | None = None,
) -> DataFrame:
    """Text score table: one row per text.

    The columns are sealed: a filter on them, such as the one that ``explode`` adds, would repeat all searches at the scan.
    """
    columns = ["text_score", "text_confidence", "text_mode", "text_sub_scores", "text_issues"]
    return sealed(with_text_score(df, text, model_score, model_confidence).select(*keys, *columns), columns)
