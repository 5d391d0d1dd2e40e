"""Recorded interaction logs: mutation diffs, indicators, evidence.

A log row is one step of a recorded session: key columns, ``step``, ``url_before``,
``url_after``, ``before`` and ``after`` counters (map), ``dialogs`` and ``popups`` seen
so far, and optionally ``selector``, ``target_index``, ``target_text``, ``target_href``
and ``action``. Everything that can be decided per row is; the running confidence is a
capped prefix sum, and the per-page result is one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.functions import urls as U
from webrisk.operators.signals import SIGNALS_DDL, signal

MUTATIONS = [
    # name, counter, direction (+1 growth, -1 decrease, 0 signed change)
    ("forms_increase", "forms", 1),
    ("iframes_increase", "iframes", 1),
    ("visible_credential_fields_increase", "visibleCredentialFields", 1),
    ("hidden_credential_fields_decrease", "hiddenCredentialFields", -1),
    ("overlays_increase", "suspiciousOverlays", 1),
    ("hidden_elements_change", "hiddenElements", 0),
    ("urgency_text_hits_increase", "urgencyTextHits", 1),
]
EVENTS_DDL = (
    "array<struct<step:bigint,step_id:string,action:string,target:string,url_before:string,"
    "url_after:string,redirect_triggered:boolean,new_indicator_codes:array<string>,"
    "dom_mutations:array<struct<name:string,value:int>>,confidence_after:double>>"
)


def with_mutation_diff(log: DataFrame) -> DataFrame:
    """Add the seven counter changes between ``before`` and ``after``."""

    def change(counter: str) -> Column:
        def at(m: str) -> Column:
            return F.coalesce(F.try_element_at(F.col(m), F.lit(counter)), F.lit(0))

        return at("after") - at("before")

    values = {}
    for name, counter, direction in MUTATIONS:
        diff = change(counter)
        values[name] = (diff if direction == 0 else F.greatest(F.lit(0), diff * direction)).cast("int")
    return log.withColumns(values)


def with_significance(log: DataFrame) -> DataFrame:
    """Add redirect_triggered and the mutation significance (0..25)."""
    log = log.withColumn(
        "redirect_triggered", U.is_suspicious_redirect(F.col("url_before"), F.col("url_after")))
    raw = (
        F.col("visible_credential_fields_increase") * 4 + F.col("forms_increase") * 3
        + F.col("overlays_increase") * 3 + F.col("iframes_increase") * 2
        + F.col("urgency_text_hits_increase") + F.when(F.col("redirect_triggered"), 4).otherwise(0)
    )
    return log.withColumn("significance", T.clamp(raw, 0, 25).cast("int"))


def target_suspicion(text: Column, href: Column, selector: Column) -> Column:
    """Suspicion of a click target from its text, link and selector."""
    words, link = F.lower(text), F.lower(href)
    return (
        F.when(T.contains_any(words, K.SUSPICIOUS_CLICK_WORDS), 6).otherwise(0)
        + F.when(T.contains_any(link, K.SUSPICIOUS_HREF_WORDS), 4).otherwise(0)
        + F.when(selector.contains(K.BUTTON_SELECTOR), 1).otherwise(0)
        - F.when(T.contains_any(words, K.BENIGN_CLICK_WORDS), 8).otherwise(0)
        - F.when(T.contains_any(link, K.BENIGN_HREF_WORDS), 3).otherwise(0)
    )


def candidate_targets(
    candidates: DataFrame, keys: list[str], per_selector: int = 2, limit: int = 4
) -> DataFrame:
    """Best click targets per page: first matches per selector, positive score, top by score.

    ``candidates`` has the keys, ``selector_no``, ``selector``, ``match_no``, ``text``, ``href``.
    ``match_no`` counts the matches of a selector from 0, so the first matches need no window;
    the top list is a grouped window that Spark prunes before the shuffle.
    """
    scored = candidates.filter(F.col("match_no") < per_selector).withColumn(
        "score",
        target_suspicion(
            F.coalesce("text", F.lit("")), F.coalesce("href", F.lit("")), F.col("selector")),
    ).filter("score > 0")
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "selector_no", "match_no")
    return (
        scored.withColumn("target_rank", F.row_number().over(w))
        .filter(F.col("target_rank") <= limit)
        .select(*keys, "target_rank", "selector", "match_no", "score",
                F.coalesce("text", F.lit("")).alias("text"), F.coalesce("href", F.lit("")).alias("href"))
    )


def with_indicators(log: DataFrame) -> DataFrame:
    """Add new_indicator_codes and the suppressed popup flag."""
    popup = (F.col("dialogs") > 0) | (F.col("popups") > 0)
    weak = F.col("significance") < 4
    codes = F.array_compact(F.array(
        F.when(F.col("redirect_triggered"), F.lit("interaction-triggered-redirect")),
        F.when(F.col("visible_credential_fields_increase") > 0, F.lit("interaction-hidden-credential-reveal")),
        F.when(F.col("forms_increase") > 0, F.lit("interaction-dynamic-form-injection")),
        F.when(F.col("overlays_increase") > 0, F.lit("interaction-overlay-injection")),
        F.when(F.col("iframes_increase") > 0, F.lit("interaction-iframe-insertion")),
        F.when(popup & ~weak, F.lit("interaction-popup-scare-flow")),
    ))
    return log.withColumns({"new_indicator_codes": codes, "popup_suppressed": popup & weak})


def with_running_confidence(log: DataFrame, keys: list[str]) -> DataFrame:
    """Add confidence_after: .35 plus capped growth over the steps of a page."""
    gain = F.when(
        F.size("new_indicator_codes") > 0,
        F.lit(0.1) + F.least(F.lit(0.06), F.col("significance") * 0.01),
    ).otherwise(F.lit(0.02))
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    # hundredths as integers: the running sum is exact whatever the order
    total = F.sum(F.rint(gain * 100).cast("long")).over(w)
    return log.withColumn(
        "confidence_after", F.least(F.lit(0.97), (total + 35).cast("double") / 100.0))


def interaction_steps(log: DataFrame, keys: list[str]) -> DataFrame:
    """All per-step columns: mutations, significance, indicators, running confidence."""
    return with_running_confidence(
        with_indicators(with_significance(with_mutation_diff(log))), keys)


def indicator_signal(code: Column, significance: Column) -> Column:
    """Evidence of one indicator, in the stronger tier from significance 7 on."""
    strong = significance >= 7
    expr = None
    for name, (title, severity, category, low, high, c_low, c_high, text, context) in K.INTERACTION_RULES.items():
        confidence = F.when(strong, c_high).otherwise(c_low)
        row = signal(
            name, title, text, severity, "interaction", category,
            F.when(strong, high).otherwise(low), confidence,
            T.clamp(confidence - 0.05, 0.2, 0.98), context=context, module="interaction_simulator",
            details={"mutation_significance": significance},
        )
        expr = F.when(code == name, row) if expr is None else expr.when(code == name, row)
    return expr


def interaction_evidence(log: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows of a log, first occurrence of each code per page."""
    steps = interaction_steps(log, keys)
    exploded = steps.select(*keys, "step", "significance", F.posexplode("new_indicator_codes").alias("_i", "code"))
    first = exploded.groupBy(*keys, "code").agg(
        F.min_by("significance", F.struct("step", "_i")).alias("significance"),
        F.min(F.struct("step", "_i")).alias("_at"),
    )
    return first.withColumn("s", indicator_signal(F.col("code"), F.col("significance"))).select(
        *keys, F.col("_at.step").alias("step"), "significance", "s.*")


def _as_event() -> Column:
    names = [m[0] for m in MUTATIONS]
    return F.struct(
        F.col("step").cast("bigint").alias("step"),
        F.format_string("sim-%03d", F.col("step").cast("int")).alias("step_id"),
        F.col("action").alias("action"),
        F.concat_ws("#", F.col("selector"), F.col("target_index").cast("string")).alias("target"),
        F.col("url_before").alias("url_before"), F.col("url_after").alias("url_after"),
        F.col("redirect_triggered").alias("redirect_triggered"),
        F.col("new_indicator_codes").alias("new_indicator_codes"),
        F.array(*[
            F.struct(F.lit(n).alias("name"), F.col(n).cast("int").alias("value"))
            for n in [*names, "significance"]
        ]).alias("dom_mutations"),
        F.col("confidence_after").alias("confidence_after"),
    )


def interaction_results(log: DataFrame, keys: list[str], events: bool = True) -> DataFrame:
    """One row per page for the scoring plan: first-per-code signals and, for timelines, the ordered events.

    The first occurrence of each of the few codes is a running minimum, so signals gather nothing and any log length is fine.
    ``events`` are part of the row by nature: an array of the page's steps. Without them the array is empty, which costs the
    timeline and the multi-step pattern, but no signal.
    """
    for name, default in (("action", "click"), ("selector", "target")):
        if name not in log.columns:
            log = log.withColumn(name, F.lit(default))
    if "target_index" not in log.columns:
        log = log.withColumn("target_index", F.lit(0))
    steps = interaction_steps(log, keys)
    if events:
        steps = steps.withColumn("_e", _as_event())
    codes = list(K.INTERACTION_RULES)
    place = lambda code: F.array_position("new_indicator_codes", code)
    first = [
        F.min(F.when(place(code) > 0, F.struct("step", place(code).alias("i"), F.lit(code).alias("code"), "significance"))).alias(f"_first{n}")
        for n, code in enumerate(codes)]
    told = [F.collect_list(F.struct("step", "_e")).alias("_steps")] if events else []
    grouped = steps.groupBy(*keys).agg(*first, *told)
    found = F.array_sort(F.array_compact(F.array(*(F.col(f"_first{n}") for n in range(len(codes))))))
    listed = F.array().cast(EVENTS_DDL)
    if events:
        # ordered by step, equal steps as they came
        order = F.array_sort(F.transform("_steps", lambda x, i: F.struct(x["step"].alias("step"), i.alias("i"))))
        listed = F.transform(order, lambda o: F.element_at(F.col("_steps"), o["i"] + 1)["_e"]).cast(EVENTS_DDL)
    return grouped.select(
        *keys, listed.alias("interaction_events"),
        F.transform(found, lambda x: indicator_signal(x["code"], x["significance"])).cast(SIGNALS_DDL).alias("interaction_signals"),
    )


def interaction_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: steps, popups, dialogs, any redirect, suppressed indicators."""
    return interaction_steps(log, keys).groupBy(*keys).agg(
        F.count("*").alias("actions_attempted"),
        F.max("popups").alias("popup_count"),
        F.max("dialogs").alias("dialog_count"),
        F.bool_or("redirect_triggered").alias("redirect_observed"),
        F.count_if("popup_suppressed").alias("suppressed_indicators"),
        F.max_by("url_after", "step").alias("final_url"),
    )
