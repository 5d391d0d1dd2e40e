"""Investigation timeline of a scored page.

The rows of a page are laid out in order and folded once: the running score and the
running confidence only grow (both are capped sums), a class change inserts an
escalation row. The fold stays inside the row, so it needs no window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.functions.plan import explode_rows, sealed
from webrisk.operators.verdict import class_rank, classify

_STEP_DDL = (
    "array<struct<stage:string,source:string,title:string,detail:string,severity:string,"
    "delta:int,codes:array<string>>>"
)
_EVENT_DDL = (
    "struct<stage:string,source:string,title:string,detail:string,severity:string,"
    "score_before:int,score_after:int,score_delta:int,confidence_before:double,"
    "confidence_after:double,classification_after:string,evidence_codes:array<string>>"
)
_STATE_DDL = f"struct<score:int,confidence:double,events:array<{_EVENT_DDL}>>"


def _step(stage, source, title, detail, severity, delta, codes) -> Column:
    def c(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        c(stage).alias("stage"), c(source).alias("source"), c(title).alias("title"),
        c(detail).alias("detail"), c(severity).alias("severity"), c(delta).cast("int").alias("delta"),
        codes.alias("codes"),
    )


def class_severity(name: Column) -> Column:
    return T.lookup(name, {"Critical": "critical", "Dangerous": "high", "Suspicious": "medium"}, "info")


def signal_delta(s: Column, weight: float) -> Column:
    """Score step of one evidence row, 1..20."""
    base = T.round_int(s["score_impact"] * F.lit(weight) * T.clamp(s["confidence"], 0.45, 1.0))
    return F.least(
        F.lit(20), F.greatest(F.lit(1), base + T.lookup(s["severity"], K.SEVERITY_BONUS, 0)))


def next_confidence(running: Column, severity: Column, delta: Column) -> Column:
    return F.least(
        F.lit(0.97),
        running + T.lookup(severity, K.CONFIDENCE_BOOST, 0.03)
        + F.least(F.lit(0.08), F.greatest(F.lit(0), delta) * 0.002),
    )


def _bucket_steps(bucket: str) -> Column:
    stage, source, title, detail, severity, delta, weight = K.TIMELINE_BUCKETS[bucket]
    signals = F.col(f"{bucket}_signals")
    header = F.array(_step(
        stage, source, title, F.format_string(detail, F.size(signals)), severity, delta,
        F.transform(F.slice(signals, 1, 4), lambda s: s["code"]),
    ))
    rows = F.transform(signals, lambda s: _step(
        stage, source, s["title"], s["description"], s["severity"], signal_delta(s, weight),
        F.array(s["code"]),
    ))
    return F.when(F.size(signals) > 0, F.concat(header.cast(_STEP_DDL), rows.cast(_STEP_DDL))).otherwise(
        F.array().cast(_STEP_DDL))


def _redirect_steps() -> Column:
    hops = F.size("redirect_chain")
    row = _step(
        "delivery-analysis", "network", "Redirect chain observed",
        F.format_string(
            "Navigation followed %d redirect hops before final content was rendered.", hops),
        F.when(hops >= 2, "high").otherwise("medium"), F.least(F.lit(18), hops * 6),
        F.array(F.lit("redirect-chain")),
    )
    return F.array_compact(F.array(F.when(hops > 0, row))).cast(_STEP_DDL)


def _interaction_steps() -> Column:
    events = F.col("interaction_events")
    header = F.array(_step(
        "interaction-simulation", "interaction", "Controlled interaction simulation completed",
        F.format_string(
            "Executed %d interaction probes to uncover dynamic phishing behavior.", F.size(events)),
        "medium", 4, F.array(F.lit("interaction-simulation")),
    )).cast(_STEP_DDL)

    def one(e: Column) -> Column:
        grown = F.array_join(F.transform(
            F.filter(e["dom_mutations"], lambda m: m["value"] > 0),
            lambda m: F.concat_ws("=", m["name"], m["value"].cast("string")),
        ), ", ")
        ending = F.when(e["redirect_triggered"], "triggered redirect.").otherwise(
            "completed without redirect.")
        detail = F.concat(
            F.format_string("Action '%s' on target '%s' ", e["action"], e["target"]), ending,
            F.when(grown != "", F.concat(F.lit(" DOM mutations: "), grown, F.lit("."))).otherwise(""),
        )
        new = e["new_indicator_codes"]
        any_new = F.size(new) > 0
        return _step(
            "interaction-simulation", "interaction",
            F.concat(F.lit("Interaction step "), e["step_id"]), detail,
            F.when(any_new, "high").otherwise("low"), F.when(any_new, 8).otherwise(2),
            F.when(any_new, new).otherwise(F.array(e["step_id"])),
        )

    rows = F.transform(events, one).cast(_STEP_DDL)
    return F.when(F.size(events) > 0, F.concat(header, rows)).otherwise(F.array().cast(_STEP_DDL))


def _component_steps() -> Column:
    return F.transform(F.slice("_ranking", 1, 3), lambda r: _step(
        "reasoning", "reasoning", F.concat(F.lit("Weighted component contribution: "), r["name"]),
        F.concat(
            F.lit("Component contributed "), F.format_string("%.1f", T.py_round(-r["k"], 1)),
            F.lit(" points to final score aggregation.")),
        "info", F.greatest(F.lit(1), T.round_int(-r["k"] * 0.15)), F.array(r["name"]),
    )).cast(_STEP_DDL)


def _event(step, before, after, delta, confidence_before, confidence_after, name) -> Column:
    return F.struct(
        step["stage"].alias("stage"), step["source"].alias("source"), step["title"].alias("title"),
        step["detail"].alias("detail"), step["severity"].alias("severity"),
        before.alias("score_before"), after.alias("score_after"), delta.alias("score_delta"),
        T.py_round(confidence_before, 2).alias("confidence_before"),
        T.py_round(confidence_after, 2).alias("confidence_after"),
        name.alias("classification_after"), step["codes"].alias("evidence_codes"),
    ).cast(_EVENT_DDL)


def _emit(acc: Column, step: Column) -> Column:
    delta = F.greatest(F.lit(0), step["delta"])
    moved = F.struct(
        F.least(F.lit(100), acc["score"] + delta).alias("score"),
        next_confidence(acc["confidence"], step["severity"], step["delta"]).alias("confidence"),
    )

    def build(m: Column) -> Column:
        name = classify(m["score"])
        event = _event(step, acc["score"], m["score"], delta, acc["confidence"], m["confidence"], name)
        climb = F.struct(
            F.lit("escalation").alias("stage"), F.lit("reasoning").alias("source"),
            F.concat(F.lit("Threat escalated to "), F.upper(name)).alias("title"),
            F.format_string(
                "Accumulated evidence raised score from %d/100 to %d/100.", acc["score"], m["score"]
            ).alias("detail"),
            class_severity(name).alias("severity"), step["codes"].alias("codes"),
        )
        escalation = _event(
            climb, m["score"], m["score"], F.lit(0), m["confidence"], m["confidence"], name)
        risen = class_rank(name) > class_rank(classify(acc["score"]))
        added = F.array_compact(F.array(event, F.when(risen, escalation)))
        return F.struct(
            m["score"].alias("score"), m["confidence"].alias("confidence"),
            F.concat(acc["events"], added).alias("events"),
        ).cast(_STATE_DDL)

    return T.let(moved, build)


def with_timeline(df: DataFrame, started_at: Column | None = None) -> DataFrame:
    """Add ``timeline`` (array of events) to a table with verdict details.

    ``started_at`` gives the first event's time; later events follow second by second.
    """
    start = F.current_timestamp() if started_at is None else started_at
    parts = [
        F.array(_step(
            "collection", "system", "Investigation initialized",
            F.concat(F.lit("Started evidence collection for "), F.col("normalized_url"), F.lit(".")),
            "info", 0, F.array().cast("array<string>"),
        )).cast(_STEP_DDL),
        _bucket_steps("url"), _redirect_steps(), _bucket_steps("dom"),
    ]
    if "interaction_events" in df.columns:
        parts.append(_interaction_steps())
    parts += [_bucket_steps("content"), _bucket_steps("model"), _bucket_steps("reputation"), _component_steps()]
    zero = F.struct(
        F.lit(0).alias("score"), F.lit(0.2).alias("confidence"),
        F.array().cast(f"array<{_EVENT_DDL}>").alias("events"),
    ).cast(_STATE_DDL)
    df = df.withColumn("_steps", F.concat(*parts))
    df = sealed(df.withColumn("_state", F.aggregate("_steps", zero, _emit)), ["_state"])

    final, confidence = F.col("risk_score"), F.col("confidence")
    state = F.col("_state")
    adjust = _step(
        "reasoning", "reasoning", "Final evidence normalization",
        "Adjusted accumulated score to normalized threat score.", "info", final - state["score"],
        F.array(F.lit("normalization")),
    ).cast(_STEP_DDL[len("array<"):-1])
    lowered = F.struct(
        F.greatest(final, F.lit(0)).alias("score"),
        F.greatest(state["confidence"], confidence).alias("confidence"),
        F.concat(state["events"], F.array(_event(
            F.struct(
                F.lit("reasoning").alias("stage"), F.lit("reasoning").alias("source"),
                F.lit("Final evidence normalization").alias("title"),
                F.lit("Applied normalization cap to finalize threat score.").alias("detail"),
                F.lit("info").alias("severity"), F.array(F.lit("normalization")).alias("codes"),
            ),
            state["score"], final, F.lit(0), state["confidence"],
            F.greatest(state["confidence"], confidence), classify(final),
        ))).alias("events"),
    ).cast(_STATE_DDL)
    even = F.struct(
        state["score"].alias("score"), F.greatest(state["confidence"], confidence).alias("confidence"),
        state["events"].alias("events"),
    ).cast(_STATE_DDL)
    df = df.withColumn(
        "_final",
        F.when(final > state["score"], _emit(state, adjust)).when(final < state["score"], lowered)
        .otherwise(even),
    )
    df = sealed(df, ["_final"])
    last = F.col("_final")
    closing = F.struct(
        F.lit("conclusion").alias("stage"), F.lit("reasoning").alias("source"),
        F.concat(F.lit("Investigation concluded: "), F.upper(classify(final))).alias("title"),
        F.format_string("Final threat score computed as %d/100.", final).alias("detail"),
        class_severity(classify(final)).alias("severity"),
        F.array(F.lit("final-score")).alias("codes"),
    )
    events = F.concat(last["events"], F.array(_event(
        closing, final, final, F.lit(0), last["confidence"],
        F.greatest(last["confidence"], confidence), classify(final),
    )))
    timeline = F.transform(events, lambda e, i: F.struct(
        F.format_string("evt-%03d", i + 1).alias("event_id"),
        (start + F.make_dt_interval(secs=i)).alias("event_time"),
        *[e[n].alias(n) for n in (
            "stage", "source", "title", "detail", "severity", "score_before", "score_after",
            "score_delta", "confidence_before", "confidence_after", "classification_after",
            "evidence_codes")],
    ))
    return df.withColumn("timeline", timeline).drop("_steps", "_state", "_final")


def explode_timeline(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per timeline event."""
    return explode_rows(df, keys, "timeline", "event_no", "_e").select(
        *keys, "event_no", "_e.*")


def confidence_progression(df: DataFrame, keys: list[str]) -> DataFrame:
    """Score and confidence after each timeline event."""
    return explode_timeline(df, keys).select(
        *keys, "event_no", "event_id", "event_time", F.col("score_after").alias("score"),
        F.col("confidence_after").alias("confidence"),
        F.col("classification_after").alias("classification"), "stage",
    )
