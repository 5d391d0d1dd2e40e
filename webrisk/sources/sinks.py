"""Result sinks: evaluation files, reports, scan history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that they fit a CSV file."""
    nested = (S.ArrayType, S.MapType, S.StructType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str) -> None:
    flatten_for_csv(df).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def evaluation_report(
    records: DataFrame, frame: DataFrame, threshold: int, thresholds: list[int], previews: int = 30
) -> DataFrame:
    """One nested JSON report: overview, runtime, metrics, sweep, and first error rows."""
    from webrisk.operators import evaluate as E
    from webrisk.operators.prep import frame_stats

    def rows(df: DataFrame, name: str):
        # only small aggregates and limited previews are gathered here
        return df.agg(F.collect_list(F.struct(*df.columns))).scalar().alias(name)

    parts = [
        rows(frame_stats(frame), "dataset_overview"),
        rows(E.run_summary(records), "runtime_summary"),
        rows(E.metrics_at_threshold(records, threshold), "metrics"),
        rows(E.threshold_sweep(records, thresholds).orderBy("threshold"), "threshold_metrics"),
        rows(E.preview(E.false_positives(records, threshold), ["url"], previews), "false_positive_samples"),
        rows(E.preview(E.false_negatives(records, threshold), ["url"], previews), "false_negative_samples"),
    ]
    report = records.sparkSession.range(1).select(*parts)
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))


def write_evaluation(
    records: DataFrame, frame: DataFrame, root: str, threshold: int = 40,
    thresholds: list[int] | None = None,
) -> None:
    """All result files of a run. ``records`` should be persisted or stored by the caller."""
    from webrisk.operators import evaluate as E

    thresholds = thresholds or [20, 30, 40, 50, 60]
    write_csv(records, f"{root}/evaluation_records_csv")
    write_json_lines(records, f"{root}/evaluation_records_jsonl")
    write_csv(E.threshold_sweep(records, thresholds), f"{root}/threshold_metrics")
    write_csv(E.false_positives(records, threshold), f"{root}/false_positives")
    write_csv(E.false_negatives(records, threshold), f"{root}/false_negatives")
    run = E.run_summary(records)
    summary = E.metrics_at_threshold(records, threshold).withColumn(
        "_run", run.select(F.struct(*run.columns)).scalar()).select("*", "_run.*").drop("_run")
    write_csv(summary, f"{root}/evaluation_summary")
    evaluation_report(records, frame, threshold, thresholds).write.mode("overwrite").text(
        f"{root}/evaluation_report")


def append_history(rows: DataFrame, path: str) -> None:
    """Append scan history rows, partitioned by date."""
    rows.write.mode("append").partitionBy("scan_date").parquet(path)
