"""Lookup misses: restart rule, exact limit, independence of micro-batches."""

import pytest
from pyspark.sql import functions as F

from webrisk.functions import text as T
from webrisk.operators import page_features as P
from webrisk.session import shared_root
from webrisk.streaming import jobs

T0 = 1_700_000_000


def _rows(spark, times):
    return spark.createDataFrame([(k, T0 + t) for k, t in times], "url string, s long").select(
        "url", F.timestamp_seconds("s").alias("ts"))


def _found(df):
    return sorted((r.url, r.ts // 1_000_000 - T0) for r in df.collect())


def test_limit_is_a_hit_and_expiry_restarts(spark):
    times = [("a", 0), ("a", 900), ("a", 901), ("a", 1801), ("a", 1802), ("b", 5), ("b", 5)]
    assert _found(jobs.first_lookups(_rows(spark, times))) == [("a", 0), ("a", 901), ("a", 1802), ("b", 5)]


def test_empty_and_null_times(spark):
    rows = _rows(spark, []).union(spark.createDataFrame([("a", None)], "url string, ts timestamp"))
    assert _found(jobs.first_lookups(rows)) == []


@pytest.mark.parametrize("per_batch", [1, 5])
def test_stream_gives_the_rows_of_the_table(spark, per_batch, tmp_path):
    times = [(f"k{i % 3}", i * 137) for i in range(60)]
    folder = f"{shared_root(spark)}/lookups-{tmp_path.name}"
    for i in range(5):
        _rows(spark, times[i * 12:(i + 1) * 12]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/in")
    query = jobs.first_lookups(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    assert _found(spark.read.parquet(f"{folder}/out")) == _found(jobs.first_lookups(_rows(spark, times)))


@pytest.mark.parametrize("pattern, text", [
    ("accounts? locked", "account locked"), ("ab*c", "ac"), ("ab{0,2}c", "ac"), ("ab+c", "abc"), ("x(y)?", "x")])
def test_gate_never_hides_a_match(spark, pattern, text):
    assert spark.range(1).select(T.matches(F.lit(text), pattern)).first()[0]


def test_page_classes_match_any_of_their_signs(spark):
    row = spark.createDataFrame([("http://x.example/", "z")], "url string, html string")
    flags = P.model_source_flags(row).first()
    assert not flags.pg_info_email and not flags.pg_iframe
    flags = P.model_source_flags(row.withColumn("html", F.lit("z?D"))).first()
    assert flags.pg_info_email and not flags.pg_iframe


def _plain(times, ttl):
    found = []
    for t in sorted(set(times)):
        if not found or t > found[-1] + ttl:
            found.append(t)
    return found


@pytest.mark.parametrize("lifetimes", [1, 2, 7, 1000])
def test_blocks_don_t_matter(spark, lifetimes):
    """A null key holds a third of all rows; gaps of all lengths, negative times, repeated times."""
    import numpy as np

    from webrisk.operators.lookups import table_misses

    rng = np.random.default_rng(lifetimes)
    ttl, rows = 100, []
    for key, n, width in ((None, 600, 9000), (1, 300, 300), (2, 300, 100_000), (3, 400, 5000), (4, 1, 10), (5, 100, 50)):
        rows += [(key, int(t)) for t in rng.integers(-width, width, n)]
    rows += [(1, None), (None, None), (3, -1), (3, -101)]
    got = {}
    for r in table_misses(spark.createDataFrame(rows, "key long, us long"), ttl, lifetimes).collect():
        got.setdefault(r.key, []).append(r.ts)
    want = {k: _plain([t for q, t in rows if q == k and t is not None], ttl) for k in {k for k, _ in rows}}
    assert {k: sorted(v) for k, v in got.items()} == want
