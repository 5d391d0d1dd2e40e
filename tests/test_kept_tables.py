"""Tables that streams keep current: parts, marks, replays; lookups of skewed keys over batches."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from webrisk.session import shared_root
from webrisk.streaming import jobs
from webrisk.streaming.tables import KeyedTable

DDL = "key string, n int"


def _path(spark):
    return f"{shared_root(spark)}/kept-{uuid.uuid4().hex[:12]}"


def _table(spark, path=None):
    return KeyedTable(spark, path or _path(spark), DDL, ["key"], parts=4)


def _rows(spark, rows):
    return spark.createDataFrame(rows, DDL)


def _held(df):
    return {r.key: r.n for r in df.collect()}


def test_upsert_replaces_keys_and_keeps_others(spark):
    t = _table(spark)
    assert _held(t.read()) == {} and t.committed() == -1
    t.upsert(_rows(spark, [("a", 1), ("b", 1), (None, 1)]), 0)
    t.upsert(_rows(spark, [("b", 2), (None, 2), ("c", 2)]), 1)
    t.upsert(_rows(spark, []), 2)
    assert _held(t.read()) == {"a": 1, "b": 2, None: 2, "c": 2} and t.committed() == 2
    assert _held(t.read(before=1)) == {"a": 1, "b": 1, None: 1}


def test_only_parts_of_changed_keys_are_written_and_old_versions_go(spark):
    t = _table(spark)
    t.upsert(_rows(spark, [(f"k{i}", 0) for i in range(40)]), 0)
    assert sorted(t.versions()) == [0, 1, 2, 3]
    for batch in (1, 2, 3):
        t.upsert(_rows(spark, [("k7", batch)]), batch)
    assert sorted(sorted(v) for v in t.versions().values()) == [[0], [0], [0], [2, 3]]
    assert _held(t.read()) == {**{f"k{i}": 0 for i in range(40)}, "k7": 3}


def test_unmarked_batches_don_t_count_and_marked_ones_aren_t_repeated(spark):
    t = _table(spark)
    t.upsert(_rows(spark, [("a", 1)]), 0)
    t._mark = lambda batch_id: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        t.upsert(_rows(spark, [("a", 5), ("b", 5)]), 1)
    again = _table(spark, t.path)
    assert _held(again.read()) == {"a": 1}
    again.upsert(_rows(spark, [("a", 5), ("b", 5)]), 1)
    again.upsert(_rows(spark, [("a", 9)]), 1)
    assert _held(again.read()) == {"a": 5, "b": 5}


def test_rows_that_are_not_kept_go_from_the_parts_met(spark):
    t = KeyedTable(spark, _path(spark), DDL, ["key"], parts=1)
    t.upsert(_rows(spark, [("a", 1), ("b", 8)]), 0)
    t.upsert(_rows(spark, [("c", 2)]), 1, keep=F.col("n") > 5)
    assert _held(t.read()) == {"b": 8, "c": 2}


def test_dashboard_equals_the_table_s(spark):
    path = _path(spark)
    rng = np.random.default_rng(5)
    rows = [(int(u) if u else None, str(c), int(s)) for u, c, s in zip(rng.integers(0, 9, 300), rng.choice(["Safe", "Critical"], 300), rng.integers(0, 101, 300), strict=True)]
    ddl = "user_id long, classification string, risk_score int"
    for i in range(3):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], ddl).coalesce(1).write.mode("append").parquet(f"{path}/in")
    for _ in range(2):  # the second start finds nothing new
        jobs.keep_breakdown(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path, parts=4).awaitTermination()
    got = jobs.breakdown_table(spark, path, parts=4).read()
    want = jobs.running_breakdown(spark.createDataFrame(rows, ddl))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("per_batch", [1, 2, 6])
def test_misses_don_t_depend_on_batches(spark, per_batch):
    """A null key holds a third of the rows; repeated and null times, keys that come back late."""
    path = _path(spark)
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 40_000, 600))
    rows = [(None if i % 3 == 0 else f"k{rng.integers(0, 5)}", int(t)) for i, t in enumerate(times)]
    rows = [("late", 0), ("edge", 0), *rows[:300], ("edge", rows[299][1]), (None, None), *rows[300:], ("late", 40_000), ("edge", 40_000)]
    frame = [spark.createDataFrame(rows[i * 101:(i + 1) * 101], "url string, s long").select("url", F.timestamp_seconds("s").alias("ts")) for i in range(6)]
    for piece in frame:
        piece.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", per_batch).parquet(f"{path}/in")
    jobs.keep_first_lookups(stream, path, parts=4).awaitTermination()
    got = sorted((r.url or "", r.ts) for r in spark.read.parquet(f"{path}/misses").collect())
    want, last = [], {}
    for url, t in rows:
        if t is not None and (url not in last or t > last[url] + 900):
            last[url] = t
            want.append((url or "", t * 1_000_000))
    assert got == sorted(want)
