"""Streaming jobs: continuous scoring, running dashboard, lookup deduplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from webrisk.functions import text as T
from webrisk.operators.history import history_rows
from webrisk.operators.lookups import table_misses
from webrisk.plans.score import ScoreOptions, score_pages
from webrisk.streaming.tables import KeyedTable


def score_stream(
    pages: DataFrame, history_path: str, checkpoint: str, user_column: str = "user_id",
    id_column: str = "page_id", time_column: str = "ts", options: ScoreOptions | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Score a page stream and store scan history.

    Scoring is stateless, so its plan is built once on the stream; a batch only writes. Each batch overwrites its own ``batch_id`` partition, so a replayed batch after a
    failure writes the same rows again instead of duplicates.
    """
    keys = [id_column, user_column, time_column]

    scored = score_pages(pages, keys=keys, options=options)
    rows = history_rows(scored, F.col(user_column), F.col(id_column), F.col(time_column), "url")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(history_path)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def running_breakdown(scans: DataFrame) -> DataFrame:
    """Count and mean score per user and class, kept current (update or complete mode).

    State is one row per user and class.
    """
    return scans.groupBy("user_id", "classification").agg(
        F.count("*").alias("count"), T.py_round(F.avg("risk_score"), 2).alias("avg_risk_score"))


def breakdown_table(spark: SparkSession, path: str, parts: int = 64) -> KeyedTable:
    """The dashboard that `keep_breakdown` keeps under a path."""
    schema = "user_id bigint, classification string, count bigint, avg_risk_score double"
    return KeyedTable(spark, f"{path}/table", schema, ["user_id", "classification"], parts)


def keep_breakdown(scans: DataFrame, path: str, parts: int = 64) -> StreamingQuery:
    """Keep the running dashboard in a table: a batch sends only the users and classes that changed, and rewrites only their parts."""
    table = breakdown_table(scans.sparkSession, path, parts)
    changed = running_breakdown(scans.select(F.col("user_id").cast("bigint").alias("user_id"), "classification", "risk_score"))
    return changed.writeStream.outputMode("update").foreachBatch(table.upsert).option(
        "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def _misses(times: np.ndarray, last: int | None, ttl: int) -> list[int]:
    """Of ascending times those not within ``ttl`` of the last miss; a time exactly ``ttl`` later is a hit."""
    out, i = [], 0
    while True:
        i = int(np.searchsorted(times, last + ttl, "right")) if last is not None else i
        if i >= len(times):
            return out
        last = int(times[i])
        out.append(last)


def first_lookups(lookups: DataFrame, ttl_seconds: int = 900, key: str = "url", ts: str = "ts") -> DataFrame:
    """Lookups that a cache with a restarting time to live does not answer: (key, ts in microseconds).

    A miss stores the answer for ``ttl_seconds``; a lookup later than that is the next miss. Works on tables and on
    streams and gives the same rows whatever the micro-batches are, as long as time does not run backwards between them.
    State is one time per key, dropped when the watermark passes its end: the next lookup is a miss either way. Tables
    are worked on in time blocks (`operators.lookups`).
    """
    ttl = ttl_seconds * 1_000_000
    kind = lookups.schema[key].dataType.simpleString()
    rows = lookups.select(F.col(key).alias("key"), F.col(ts).alias("ts"))
    if not lookups.isStreaming:
        found = table_misses(rows.select("key", F.unix_micros("ts").alias("us")), ttl)
    else:
        def step(who, parts, state):
            times = [p["us"].to_numpy() for p in parts]
            last = state.get[0] if state.exists else None
            if state.hasTimedOut:
                state.remove()
                return
            out = _misses(np.unique(np.concatenate(times)), last, ttl)
            last = out[-1] if out else last
            state.update((last,))
            state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs()) + 1)
            yield pd.DataFrame({"key": [who[0]] * len(out), "ts": out})

        timed = rows.where("ts is not null").withWatermark("ts", f"{ttl_seconds} seconds").select("key", "ts", F.unix_micros("ts").alias("us"))
        found = timed.groupBy("key").applyInPandasWithState(
            step, f"key {kind}, ts long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), "ts")


def keep_first_lookups(
    lookups: DataFrame, path: str, ttl_seconds: int = 900, key: str = "url", ts: str = "ts", parts: int = 64,
) -> StreamingQuery:
    """Write the misses of a lookup stream to ``path/misses``: (key, ts in microseconds, batch_id), whatever the skew of the keys.

    The same rows as `first_lookups`, under the same condition on time, but no task holds the rows of a key: a batch is worked on in
    time blocks like a table, and every key's last miss, kept in a `KeyedTable`, is put before its lookups as the start of
    their chain. Last misses that can't answer any more are dropped when their part is rewritten. A batch overwrites its own
    partition of the misses. Null keys are a key; null times are left out.
    """
    ttl = ttl_seconds * 1_000_000
    kind = lookups.schema[key].dataType.simpleString()
    last = KeyedTable(lookups.sparkSession, f"{path}/last", f"key {kind}, last bigint", ["key"], parts)
    timed = lookups.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(ts).alias("us"))

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= last.committed():
            return
        rows = batch.persist()
        newest = rows.agg(F.max("us")).first()[0]
        known = last.read(batch_id).select(F.col("key").alias("k"), "last")
        same = F.col("key").eqNullSafe(F.col("k"))
        after = rows.join(known, same, "left").where(F.col("last").isNull() | (F.col("us") > F.col("last"))).select("key", "us")
        starts = known.join(rows.select("key"), same, "left_semi")
        chains = after.unionByName(starts.select(F.col("k").alias("key"), F.col("last").alias("us")))
        found = table_misses(chains, ttl).join(starts, same & (F.col("ts") == F.col("last")), "left_anti")
        out = f"{path}/misses/batch_id={batch_id}"
        found.select(F.col("key").alias(key), "ts").write.mode("overwrite").parquet(out)
        misses = batch.sparkSession.read.schema(f"`{key}` {kind}, ts bigint").parquet(out)
        # a later batch holds no time before newest - ttl, so older entries answer nothing more
        last.upsert(misses.groupBy(F.col(key).alias("key")).agg(F.max("ts").alias("last")), batch_id, F.col("last") + 2 * ttl >= F.lit(newest or 0))
        rows.unpersist()

    return timed.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
