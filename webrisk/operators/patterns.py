"""Attack patterns and the narrative profile of a page's evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.functions.plan import explode_rows
from webrisk.operators.signals import BUCKETS, has_code

PATTERNS_DDL = (
    "array<struct<code:string,title:string,description:string,confidence:double,"
    "evidence_codes:array<string>>>"
)


def pattern_catalog() -> Column:
    return F.array(*[
        F.struct(
            F.lit(code).alias("code"), F.lit(title).alias("title"), F.lit(base).alias("base"),
            F.lit(need).alias("need"), F.lit(single).alias("single"),
            T.string_array(codes).alias("codes"), F.lit(description).alias("description"),
        )
        for code, title, base, need, single, codes, description in K.ATTACK_PATTERNS
    ])


def with_attack_patterns(df: DataFrame) -> DataFrame:
    """Add ``attack_patterns``: up to eight patterns by confidence, stable in catalog order.

    For a code that fired more than once the last signal supplies severity and
    reliability. ``interaction_events`` (optional column) feeds the multi-step pattern.
    """
    df = df.withColumn("_facts", F.transform(
        F.concat(*[F.col(f"{b}_signals") for b in BUCKETS]),
        lambda s: F.struct(
            s["code"].alias("code"),
            s["severity"].isin("high", "critical").alias("high"),
            s["reliability"].alias("reliability"),
        ),
    ))
    facts = F.col("_facts")
    codes = F.array_distinct(F.transform(facts, lambda x: x["code"]))
    df = df.withColumn("_codes", codes)

    def measure(p: Column) -> Column:
        def with_matches(matched: Column) -> Column:
            last = F.transform(
                matched, lambda c: F.element_at(F.filter(facts, lambda x: x["code"] == c), -1)
            )

            def with_info(info: Column) -> Column:
                m = F.size(info)
                high = F.size(F.filter(info, lambda x: x["high"]))
                mean = F.aggregate(info, F.lit(0.0), lambda a, x: a + x["reliability"]) / F.greatest(
                    m, F.lit(1)
                )
                confidence = F.least(
                    F.lit(0.98),
                    p["base"] + F.least(F.lit(0.16), m * 0.035) + F.least(F.lit(0.12), high * 0.03)
                    + (mean - 0.65) * 0.18,
                )
                return F.struct(
                    p["code"].alias("code"), p["title"].alias("title"),
                    p["description"].alias("description"), confidence.alias("confidence"),
                    matched.alias("evidence_codes"),
                    ((m >= p["need"]) | (p["single"] & (m == 1) & (high > 0))).alias("enough"),
                )

            return T.let(last, with_info)

        return T.let(F.array_sort(F.array_intersect(p["codes"], F.col("_codes"))), with_matches)

    measured = F.filter(
        F.transform(pattern_catalog(), measure),
        lambda p: (F.size(p["evidence_codes"]) > 0) & p["enough"]
        & ~((p["confidence"] < 0.62) & (F.size(p["evidence_codes"]) == 1)),
    )
    found = F.transform(measured, lambda p: F.struct(
        p["code"].alias("code"), p["title"].alias("title"), p["description"].alias("description"),
        T.py_round(p["confidence"], 2).alias("confidence"), p["evidence_codes"].alias("evidence_codes"),
    )).cast(PATTERNS_DDL)
    if "interaction_events" in df.columns:
        found = F.concat(found, flow_pattern(F.col("interaction_events")))
    df = df.withColumn("_found", found)
    order = F.array_sort(F.transform(
        "_found", lambda p, i: F.struct((-p["confidence"]).alias("k"), i.alias("i"))
    ))
    return df.withColumn(
        "attack_patterns",
        F.transform(F.slice(order, 1, 8), lambda o: F.element_at(F.col("_found"), o["i"] + 1)),
    ).drop("_facts", "_codes", "_found")


def flow_pattern(events: Column) -> Column:
    """Multi-step flow: at least two interaction steps with at least two indicators in all."""
    steps = F.size(events)
    indicators = F.flatten(F.transform(events, lambda e: e["new_indicator_codes"]))
    n = F.size(indicators)
    mean = F.aggregate(events, F.lit(0.0), lambda a, e: a + e["confidence_after"]) / F.greatest(
        steps, F.lit(1)
    )
    confidence = F.least(
        F.lit(0.96),
        F.lit(0.68) + F.least(F.lit(0.16), n * 0.03) + F.least(F.lit(0.1), (mean - 0.5) * 0.25),
    )
    code, title, description = K.FLOW_PATTERN
    row = F.struct(
        F.lit(code).alias("code"), F.lit(title).alias("title"), F.lit(description).alias("description"),
        T.py_round(confidence, 2).alias("confidence"),
        F.array_sort(F.array_distinct(indicators)).alias("evidence_codes"),
    )
    return F.array_compact(F.array(F.when((steps >= 2) & (n >= 2), row))).cast(PATTERNS_DDL)


def with_narrative(df: DataFrame) -> DataFrame:
    """Add narrative flags, ``coercion_score`` and ``narrative_summary``."""
    signals = F.concat(F.col("content_signals"), F.col("dom_signals"))
    df = df.withColumns({flag: has_code(signals, codes) for flag, codes, _, _ in K.NARRATIVE})
    language = F.least(
        F.lit(100),
        F.aggregate(
            F.map_values(F.coalesce(F.col("text_sub_scores"), F.create_map().cast("map<string,int>"))),
            F.lit(0), lambda a, v: a + v,
        ),
    )
    points = sum((F.when(F.col(flag), p).otherwise(0) for flag, _, p, _ in K.NARRATIVE), F.lit(0))
    words = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(w)) for flag, _, _, w in K.NARRATIVE]))
    return df.withColumns({
        "coercion_score": F.least(F.lit(100), language + points),
        "narrative_summary": F.when(
            F.size(words) > 0,
            F.concat(F.lit(K.NARRATIVE_FOUND), F.array_join(words, ", "), F.lit(".")),
        ).otherwise(F.lit(K.NARRATIVE_NONE)),
    })


def explode_patterns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long table of attack patterns with their rank."""
    return explode_rows(df, keys, "attack_patterns", "_i", "_p").select(
        *keys, (F.col("_i") + 1).alias("pattern_rank"), "_p.*"
    )
