"""Streaming jobs, run over the driver tables as a file stream until it is drained."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.q_pages import PAGE_SQL
from checks.registry import register
from webrisk.session import shared_root
from webrisk.streaming import jobs


def _stream(spark, sf, name):
    """A table as a file stream. It may be a file or a folder of files: a pattern meets both, where a plain path must be a folder."""
    schema = I.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}[.]parquet")


def _drain(spark, df, mode):
    """Run a stream to its end into files of the shared folder, with its checkpoint beside them."""
    run = f"{shared_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{run}/out").awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{run}/out")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{run}/out")


def _scans(e):
    score = F.least(F.lit(100), F.floor("value")).cast("int")
    return e.select(
        "user_id", score.alias("risk_score"),
        F.when(score < 25, "Safe").when(score < 50, "Suspicious").when(score < 75, "Dangerous")
        .otherwise("Critical").alias("classification"))


BREAKDOWN = f"with {S.SCANS} select user_id, classification, count(*)::bigint as count, {S.half_even('avg(risk_score)', 2)} as avg_risk_score from sc group by all"


def _sliced(spark, sf, start, slices=4):
    """Run a job over the events as a stream of several batches, in the order of time.

    A slice is written by many tasks and then given to the job, which goes on from its checkpoint: a batch per slice,
    whatever the number of its files.
    """
    e = I.table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = e.agg(F.percentile_approx(us, [i / slices for i in range(1, slices)])).first()[0] or []
    piece = reduce(lambda n, c: n + (us > c).cast("int"), sorted(set(cuts)), F.lit(0))
    piece = F.coalesce(piece, F.lit(0))
    folder = f"{shared_root(spark)}/events-{uuid.uuid4().hex[:12]}"
    for i in range(len(set(cuts)) + 1):
        e.where(piece == i).write.mode("append").parquet(folder)
        start(spark.readStream.schema(e.schema).parquet(folder)).awaitTermination()


@register("stream_dashboard", BREAKDOWN)
def stream_dashboard(spark, sf):
    path = f"{shared_root(spark)}/dashboard-{uuid.uuid4().hex[:12]}"
    _sliced(spark, sf, lambda events: jobs.keep_breakdown(_scans(events), path, parts=16))
    return jobs.breakdown_table(spark, path, parts=16).read()


@register("stream_breakdown", BREAKDOWN)
def stream_breakdown(spark, sf):
    return _drain(spark, jobs.running_breakdown(_scans(_stream(spark, sf, "events"))), "complete")


FIRST_LOOKUPS = """
with recursive d as (select distinct user_id, epoch_us(ts) as ts from events where ts is not null),
nx as (select user_id, ts, min(ts) over (
  partition by user_id order by ts range between 900000001 following and unbounded following) as later from d),
chain as (
  select user_id, min(ts) as ts from d group by user_id
  union all select nx.user_id, nx.later from chain join nx on chain.user_id = nx.user_id and chain.ts = nx.ts
    where nx.later is not null)
select user_id as url, ts from chain
"""


def _lookups(events):
    return events.select(F.col("user_id").alias("url"), F.col("ts").cast("timestamp").alias("ts"))


@register("stream_first_lookups", FIRST_LOOKUPS)
def stream_lookups(spark, sf):
    return _drain(spark, jobs.first_lookups(_lookups(_stream(spark, sf, "events"))), "append")


@register("stream_lookup_misses", FIRST_LOOKUPS)
def stream_lookup_misses(spark, sf):
    path = f"{shared_root(spark)}/misses-{uuid.uuid4().hex[:12]}"
    _sliced(spark, sf, lambda events: jobs.keep_first_lookups(_lookups(events), path, parts=16))
    return spark.read.parquet(f"{path}/misses").select("url", "ts")


@register("first_lookups", FIRST_LOOKUPS)
def table_lookups(spark, sf):
    return jobs.first_lookups(_lookups(I.table(spark, sf, "events")))


@register("stream_scores", f"select page_id as id, page_id % 7 as user_id, risk_score, classification from ({PAGE_SQL})")
def stream_scores(spark, sf):
    from webrisk.plans.score import ScoreOptions

    run = f"{shared_root(spark)}/scores-{uuid.uuid4().hex[:12]}"
    pages = I.plant_snippets(_stream(spark, sf, "pages")).withColumns({
        "user_id": F.col("page_id") % 7, "ts": F.lit("2024-01-01").cast("timestamp")})
    query = jobs.score_stream(pages, f"{run}/history", f"{run}/checkpoint", options=ScoreOptions())
    query.awaitTermination()
    # a table without rows leaves no files to take the columns from
    return spark.read.schema("id bigint, user_id bigint, risk_score int, classification string").parquet(f"{run}/history").drop("batch_id")
