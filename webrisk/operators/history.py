"""Queries on the scan history table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk.functions import text as T

HISTORY_DDL = (
    "id bigint, user_id bigint, url string, scan_type string, risk_score int, "
    "classification string, confidence double, explanation string, llm_used boolean, "
    "detected_issues array<struct<code:string,title:string,description:string,severity:string>>, "
    "source_breakdown map<string,int>, created_at timestamp, scan_date date"
)


def history_rows(
    scored: DataFrame, user: Column, scan_id: Column, created_at: Column, scan_type: str = "url",
) -> DataFrame:
    """Turn verdicts into scan history rows."""
    parts = ["phishing_probability", "dom_suspicion", "content_scam_score", "reputation_score", "redirect_risk"]
    pairs: list[Column] = []
    for name in parts:
        pairs += [F.lit(name), F.col(name).cast("int")]
    return scored.filter(F.col("status") == "ok").select(
        scan_id.cast("bigint").alias("id"), user.cast("bigint").alias("user_id"), "url",
        F.lit(scan_type).alias("scan_type"), "risk_score", "classification", "confidence",
        "explanation", F.lit(False).alias("llm_used"), "detected_issues",
        F.create_map(*pairs).alias("source_breakdown"),
        created_at.alias("created_at"), F.to_date(created_at).alias("scan_date"),
    )


def recent_scans(history: DataFrame, user_id: int, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest scans of a user; equal times are ordered by id. A bounded top-k, not a full sort."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return (
        history.filter(F.col("user_id") == user_id)
        .orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    )


def count_for_user(history: DataFrame, user_id: int) -> DataFrame:
    return history.filter(F.col("user_id") == user_id).agg(F.count("*").alias("total"))


def class_breakdown(history: DataFrame, user_id: int | None = None) -> DataFrame:
    """Count and mean score per class, of one user or per user."""
    rows = history if user_id is None else history.filter(F.col("user_id") == user_id)
    keys = ["user_id", "classification"] if user_id is None else ["classification"]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("count"),
        T.py_round(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 2).alias("avg_risk_score"))


def dashboard(history: DataFrame, user_id: int, recent: int = 5) -> DataFrame:
    """One row: class breakdown, last scans and total of a user.

    The breakdown has four classes and the last scans are a bounded top list, so nothing
    unbounded is collected.
    """
    mine = history.filter(F.col("user_id") == user_id)
    breakdown = class_breakdown(history, user_id).agg(
        F.array_sort(F.collect_list(F.struct("classification", "count", "avg_risk_score"))).alias(
            "classification_breakdown"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_scans"),
    )
    last = recent_scans(mine, user_id, recent).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct(
            "created_at", "id", "url", "scan_type", "risk_score", "classification", "confidence")))))
    return breakdown.withColumn("recent_scans", last.scalar())


def to_delete(history: DataFrame, user_id: int, ids: Iterable[int] | None = None) -> Column:
    """Predicate of the rows to delete; ids are filtered to positive and distinct ones."""
    mine = F.col("user_id") == user_id
    if ids is None:
        return mine
    cleaned = sorted({int(i) for i in ids if int(i) > 0})
    if not cleaned:
        raise ValueError("Provide one or more history IDs, or delete all.")
    return mine & F.col("id").isin(cleaned)


def delete_scans(history: DataFrame, user_id: int, ids: Iterable[int] | None = None) -> DataFrame:
    """History without the deleted rows of a user (one, many, or all)."""
    return history.filter(~to_delete(history, user_id, ids))


def delete_report(history: DataFrame, user_id: int, ids: Iterable[int] | None = None) -> DataFrame:
    """Deleted and remaining counts of a user."""
    gone = to_delete(history, user_id, ids)
    return history.filter(F.col("user_id") == user_id).agg(
        F.count_if(gone).alias("deleted_count"), F.count_if(~gone).alias("remaining"))


def rewrite_without(
    spark, path: str, staging: str, user_id: int, ids: Iterable[int] | None = None
) -> list[str]:
    """Delete rows from a stored history by rewriting only the dates that hold any.

    The surviving rows of those dates are written to ``staging`` first and then swapped in
    with dynamic partition overwrite, so a job that dies half way loses nothing. A date
    left without rows is overwritten with an empty file set by dropping its partition.
    Returns the rewritten dates.
    """
    history = spark.read.schema(HISTORY_DDL).parquet(path)
    gone = to_delete(history, user_id, ids)
    dates = [r[0] for r in history.filter(gone).select("scan_date").distinct().collect()]
    if not dates:
        return []
    touched = history.filter(F.col("scan_date").isin(dates) & ~gone)
    touched.write.mode("overwrite").partitionBy("scan_date").parquet(staging)
    kept = spark.read.schema(HISTORY_DDL).parquet(staging)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "scan_date").parquet(path)
    left = {r[0] for r in kept.select("scan_date").distinct().collect()}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for day in dates:
        if day not in left:
            files.delete(jvm.org.apache.hadoop.fs.Path(path, f"scan_date={day.isoformat()}"), True)
    return sorted(d.isoformat() for d in dates)


def search(history: DataFrame, classification: str = "all", query: str = "") -> DataFrame:
    """Scans of a class (or all) whose url or explanation contains the query text."""
    rows = history if classification == "all" else history.filter(
        F.col("classification") == classification)
    needle = query.strip().lower()
    if not needle:
        return rows
    return rows.filter(
        F.lower(F.coalesce("url", F.lit(""))).contains(needle)
        | F.lower(F.coalesce("explanation", F.lit(""))).contains(needle))
