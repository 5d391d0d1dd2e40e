"""Evaluation of scores against labels.

Risk scores are integers from 0 to 100, so every threshold metric is computed from
one small histogram (label x score): one pass over the records with map-side
combine, whatever the number of thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrisk.functions import text as T
from webrisk.operators.verdict import class_rank

EVAL_ARRAYS = ["attack_patterns", "evidence_codes", "reasoning_chain"]


def predicted_label(score: Column, name: Column, threshold: int) -> Column:
    """Score against the threshold, else class at least Suspicious."""
    return F.when(score.isNotNull(), (score >= threshold).cast("int")).when(
        name.isNotNull(), (class_rank(name) >= 1).cast("int"))


def evaluation_records(
    scored: DataFrame, labels: DataFrame, threshold: int = 40, timeout_seconds: float = 45.0,
    key: str = "url", source: str = "source_dataset",
) -> DataFrame:
    """One record per labelled URL; labels without a verdict become error records.

    ``labels`` has url, label and source; an optional ``duration_seconds`` column of the
    verdicts decides timeouts.
    """
    duration = F.col("duration_seconds") if "duration_seconds" in scored.columns else F.lit(0.0)
    v = scored.select(
        key,
        F.col("status").alias("_status"),
        duration.cast("double").alias("duration_seconds"),
        "risk_score", F.col("classification").alias("predicted_classification"), "confidence",
        F.transform("attack_patterns", lambda p: p["code"]).alias("attack_patterns"),
        F.transform("top_evidence", lambda s: s["code"]).alias("evidence_codes"),
        F.size("suppressed").alias("suppressed_detection_count"),
        F.col("reason_chain").alias("reasoning_chain"),
        *(["explanation"] if "explanation" in scored.columns else []),
    )
    joined = labels.select(key, F.col("label").alias("true_label"), F.col(source).alias("source")).join(
        v, key, "left")
    failed = F.coalesce(F.col("_status"), F.lit("error")) == "error"
    slow = F.coalesce(F.col("duration_seconds") > timeout_seconds, F.lit(False))
    none = F.array().cast("array<string>")
    out = joined.withColumns({
        "status": F.when(failed, "error").when(slow, "timeout_exceeded").otherwise("ok"),
        "timeout_exceeded": slow,
        "predicted_label": predicted_label(
            F.col("risk_score"), F.col("predicted_classification"), threshold),
        "suppressed_detection_count": F.when(failed, 0).otherwise(F.col("suppressed_detection_count")),
        **{c: F.when(failed, none).otherwise(F.coalesce(F.col(c), none)) for c in EVAL_ARRAYS},
    })
    return out.drop("_status")


def valid_rows(records: DataFrame) -> DataFrame:
    return records.filter(F.col("true_label").isin(0, 1) & F.col("risk_score").isNotNull())


def score_histogram(records: DataFrame) -> DataFrame:
    """Counts per label and score."""
    return valid_rows(records).groupBy("true_label", "risk_score").agg(F.count("*").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rates(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Add accuracy, precision, recall, f1_score and error rates to tp/fp/tn/fn columns."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    values = {
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": _ratio(fp, fp + tn),
        "false_negative_rate": _ratio(fn, fn + tp),
    }
    return df.withColumns({
        k: T.py_round(v, digits) if digits is not None else v for k, v in values.items()})


def threshold_sweep(records: DataFrame, thresholds: Sequence[int] = (20, 30, 40, 50, 60)) -> DataFrame:
    """Confusion and rates per threshold; thresholds without any valid row give zeros."""
    grid = F.array(*[F.lit(int(t)) for t in thresholds])
    by_threshold = score_histogram(records).select(
        F.explode(grid).alias("threshold"), "true_label", "risk_score", "n")
    hit, bad, n = F.col("risk_score") >= F.col("threshold"), F.col("true_label") == 1, F.col("n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")

    confusion = by_threshold.groupBy("threshold").agg(
        total(bad & hit).alias("tp"), total(~bad & hit).alias("fp"),
        total(~bad & ~hit).alias("tn"), total(bad & ~hit).alias("fn"))
    spark = records.sparkSession
    wanted = spark.range(1).select(F.explode(grid).alias("threshold"))
    full = wanted.join(confusion, "threshold", "left").na.fill(0, ["tp", "fp", "tn", "fn"])
    return rates(full)


def metrics_at_threshold(records: DataFrame, threshold: int = 40) -> DataFrame:
    return threshold_sweep(records, [threshold])


def false_positives(records: DataFrame, threshold: int) -> DataFrame:
    return valid_rows(records).filter((F.col("true_label") == 0) & (F.col("risk_score") >= threshold))


def false_negatives(records: DataFrame, threshold: int) -> DataFrame:
    return valid_rows(records).filter((F.col("true_label") == 1) & (F.col("risk_score") < threshold))


def preview(rows: DataFrame, order: Sequence[str | Column], limit: int = 30) -> DataFrame:
    """First rows of an error list in a total order."""
    return rows.orderBy(*order).limit(limit)


def run_summary(records: DataFrame) -> DataFrame:
    """Counts by status and runtime totals."""
    total = F.coalesce(F.sum("duration_seconds"), F.lit(0.0))
    return records.agg(
        F.count("*").alias("sample_count"),
        F.count_if(F.col("status") != "error").alias("success_count"),
        F.count_if(F.col("status") == "error").alias("failure_count"),
        F.count_if("timeout_exceeded").alias("timeout_exceeded_count"),
        T.py_round(total, 3).alias("total_runtime_seconds"),
        T.py_round(total / F.greatest(F.count("*"), F.lit(1)), 4).alias("average_runtime_seconds"),
    )


def score_bins(records: DataFrame, bins: int = 24) -> DataFrame:
    """Histogram of scores by label over equal bins between the smallest and largest score."""
    counts = records.filter(F.col("risk_score").isNotNull()).groupBy("true_label", "risk_score").agg(
        F.count("*").alias("n"))
    # at most a few hundred rows from here on
    lo = counts.agg(F.min("risk_score")).scalar()
    hi = counts.agg(F.max("risk_score")).scalar()
    width = (hi - lo) / F.lit(float(bins))
    slot = F.when(width > 0, F.least(
        F.floor((F.col("risk_score") - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)
    )).otherwise(0)
    return counts.withColumn("bin", slot.cast("int")).groupBy("true_label", "bin").agg(
        F.sum("n").alias("n"))


def pattern_frequency(records: DataFrame, top: int = 12, column: str = "attack_patterns") -> DataFrame:
    """Most frequent pattern codes, ties by code."""
    return (
        records.select(F.explode_outer(column).alias("code"))
        .filter(F.trim("code") != "")
        .groupBy("code").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "code").limit(top)
    )


# -- labelled page corpora ---------------------------------------------------

def corpus_rows(scored: DataFrame, corpus: DataFrame, key: str = "id") -> DataFrame:
    """Verdicts joined with a labelled corpus: matched patterns and class expectation."""
    v = scored.select(
        key, "risk_score", "classification", "confidence",
        F.transform("attack_patterns", lambda p: p["code"]).alias("predicted_patterns"),
        F.transform("top_evidence", lambda s: F.struct(
            s["code"].alias("code"), s["severity"].alias("severity"),
            s["score_impact"].alias("score_impact"))).alias("evidence"),
        F.size("suppressed").alias("suppressed_count"), "coercion_score",
        (F.size("interaction_events") if "interaction_events" in scored.columns else F.lit(0)).alias(
            "interaction_event_count"),
    )
    c = corpus.select(
        key, "label", "category", "expected_patterns", "expected_classification_min",
        "expected_classification_max")
    rows = c.join(v, key)
    got = class_rank(F.col("classification"))

    def bound(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    low = bound("expected_classification_min") | (got >= class_rank(F.col("expected_classification_min")))
    high = bound("expected_classification_max") | (got <= class_rank(F.col("expected_classification_max")))
    return rows.withColumns({
        "matched_patterns": F.array_sort(F.array_intersect("expected_patterns", "predicted_patterns")),
        "classification_expectation_met": low & high,
        "predicted_malicious": got >= 1,
        "class_rank": got,
    })


def corpus_summary(rows: DataFrame) -> DataFrame:
    """Confusion (everything not malicious counts as benign) and expectation pass rate."""
    bad, hit = F.col("label") == "malicious", F.col("predicted_malicious")
    return rows.agg(
        F.count("*").alias("sample_count"),
        F.count_if(bad & hit).alias("tp"), F.count_if(~bad & hit).alias("fp"),
        F.count_if(~bad & ~hit).alias("tn"), F.count_if(bad & ~hit).alias("fn"),
        T.py_round(
            F.count_if("classification_expectation_met") / F.greatest(F.count("*"), F.lit(1)), 3
        ).alias("expectation_pass_rate"),
    )


def corpus_by_label(rows: DataFrame) -> DataFrame:
    """Mean risk, confidence and class rank per label, and rows with interaction findings."""
    return rows.groupBy("label").agg(
        T.py_round(F.avg("risk_score"), 3).alias("average_risk"),
        T.py_round(F.avg("confidence"), 3).alias("average_confidence"),
        T.py_round(F.avg("class_rank"), 3).alias("average_class_rank"),
        F.count_if(F.col("interaction_event_count") > 0).alias("with_interaction_findings"),
    )


def pattern_coverage(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode_outer("matched_patterns").alias("code")).filter(
        "code is not null").groupBy("code").agg(F.count("*").alias("n"))


def noisy_signals(rows: DataFrame, top: int = 10) -> DataFrame:
    """Top codes that are severe on benign pages, and top low-impact codes off malicious pages."""
    e = rows.select("label", F.explode_outer("evidence").alias("e")).filter("e is not null")
    kinds = F.array_compact(F.array(
        F.when((F.col("label") == "benign") & F.col("e.severity").isin("high", "critical"),
               F.lit("benign_high_severity")),
        F.when((F.col("label") != "malicious") & (F.col("e.score_impact") <= 10),
               F.lit("noisy_low_impact")),
    ))
    counts = e.select(F.explode(kinds).alias("kind"), F.col("e.code").alias("code")).groupBy(
        "kind", "code").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "code")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def corpus_sweep(rows: DataFrame, thresholds: Sequence[int] = (25, 35, 45, 55, 65, 75)) -> DataFrame:
    """Precision and recall per threshold, three decimals."""
    records = rows.select(
        (F.col("label") == "malicious").cast("int").alias("true_label"), "risk_score")
    return threshold_sweep(records, thresholds).select(
        "threshold", "tp", "fp", "tn", "fn",
        T.py_round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 3).alias("precision"),
        T.py_round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 3).alias("recall"))
