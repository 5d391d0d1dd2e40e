"""Cuts by rank from hash histograms, against sorted lists."""

import pytest
from pyspark.sql import functions as F

from webrisk.operators import prep


def rows(spark):
    """One label holds nine tenths of all rows."""
    return spark.range(3000).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))


def ordered(df, seed=42):
    by = {}
    for r in df.withColumn("d", prep.sample_hash(seed)).collect():
        by.setdefault(r.label, []).append((r.d, r.url))
    return {k: [u for _, u in sorted(v)] for k, v in by.items()}


@pytest.mark.parametrize("most", [10_000, 1, 0])
def test_parts_are_exact_ranks(spark, monkeypatch, most):
    monkeypatch.setattr(prep, "MOST_GROUPS", most)
    df, digest = rows(spark), prep.sample_hash(42)
    edges = lambda size: [F.lit(0).cast("long"), F.floor(size * 0.31), F.lit(500).cast("long"), F.lit(None).cast("long")]
    got = {}
    for r in prep.cut_by_rank(df, ["label"], prep.hash_bucket(digest), [digest, "url"], edges).collect():
        got[r.url] = r.part
    for names in ordered(df).values():
        limits = [0, int(len(names) * 0.31), 500]
        assert [got[u] for u in names] == [sum(i >= e for e in limits) for i in range(len(names))]
    assert len(got) == 3000


def test_rows_are_not_shuffled(spark):
    df, digest = rows(spark), prep.sample_hash(42)
    out = prep.cut_by_rank(df, ["label"], prep.hash_bucket(digest), [digest, "url"], lambda size: [F.floor(size * 0.5)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("n", [7, 1500, 5000])
def test_first_rows(spark, n):
    df, digest = rows(spark), prep.sample_hash(1)
    got = prep.top_per_group(df, ["label"], prep.hash_bucket(digest), [digest, "url"], n)
    assert {r.url for r in got.collect()} == {u for names in ordered(df, 1).values() for u in names[:n]}


def test_rows_without_key_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None), ("b", 1)], "url string, label int")
    digest = prep.sample_hash(42)
    cut = lambda d: prep.cut_by_rank(d, ["label"], prep.hash_bucket(digest), [digest, "url"], lambda size: [F.lit(1).cast("long")])
    assert [(r.url, r.part) for r in cut(df).collect()] == [("b", 0)]
    assert cut(df.where("false")).count() == 0


def test_average_precision_in_steps(spark):
    """Ties are one step; a straight line between points would give more."""
    from pyspark.ml.functions import array_to_vector

    from webrisk.operators.ml import StepwisePrecision

    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.2), (0, 0.2), (1, 0.1)]
    df = spark.createDataFrame(rows, "label int, p double").select("label", array_to_vector(F.array(1 - F.col("p"), "p")).alias("probability"))
    assert StepwisePrecision().evaluate(df) == pytest.approx((1 / 2 + 2 / 3 + 3 / 6) / 3)
    assert StepwisePrecision().evaluate(df.where("label = 0")) == 0.0
