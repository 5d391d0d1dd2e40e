"""Lookups that a cache with a restarting lifetime doesn't answer, for tables of any skew.

A miss stores the answer for `ttl`; the first lookup later than that is the next miss, so the misses of a key are a chain that
starts at its first lookup. The chain is cut into time blocks. A block is entered at one of its first times (those within one
lifetime of its start, and the first one after), and for each of these one task finds the block's last miss and with it
the entry of a later block. Which entries the chain really takes is found by pointer doubling over these entries: in
each round the entries known to be taken mark those they lead to, and every pointer is replaced by its pointer's pointer. At
last every block lists its misses from its entry on. A key's rows are spread over its blocks; no task sees a whole key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webrisk.functions.plan import stored

#: Length of a block in lifetimes.
LIFETIMES = 96
#: No later entry.
NONE = -(1 << 63)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def last_misses(times: np.ndarray, ttl: int) -> np.ndarray:
    """For every time the last miss of the chain that starts there; times ascend."""
    n = len(times)
    then = np.append(np.searchsorted(times, times + ttl, "right"), n)
    last = np.append(np.arange(n), n)
    while (then[:n] < n).any():
        last = np.where(then < n, last[np.minimum(then, n)], last)
        then = then[np.minimum(then, n)]
    return times[last[:n]]


def _entries(ttl: int, span: int):
    def run(batches):
        for batch in batches:
            key, block, times, heads, second = (batch.column(i) for i in range(5))
            at, jump = [], []
            for b, mine, ahead, far in zip(block, times, heads, second, strict=True):
                t = mine.values.to_numpy()
                first = t[:np.searchsorted(t, b.as_py() * span + ttl, "right") + 1]
                leave = last_misses(t, ttl)[:len(first)] + ttl
                later = ahead.values.to_numpy() if ahead.is_valid else np.zeros(0, np.int64)
                found = np.append(later, far.as_py() if far.is_valid else NONE)[np.searchsorted(later, leave, "right")]
                at.append(first)
                jump.append(found)
            yield pa.RecordBatch.from_arrays([key, block, _lists(at), _lists(jump)], ["key", "block", "at", "jump"])

    return run


def _listed(ttl: int):
    def run(batches):
        for batch in batches:
            out = []
            for entry, mine in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                t, found = mine.values.to_numpy(), []
                i = int(np.searchsorted(t, entry))
                while i < len(t):
                    found.append(t[i])
                    i = int(np.searchsorted(t, t[i] + ttl, "right"))
                out.append(np.array(found, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out)], ["key", "misses"])

    return run


def table_misses(rows: DataFrame, ttl: int, lifetimes: int = LIFETIMES) -> DataFrame:
    """(key, ts) of the misses among rows (key, us), all times in microseconds. Null keys are a key; null times are left out."""
    kind, span = rows.schema["key"].dataType.simpleString(), ttl * lifetimes
    timed = rows.where("us is not null").withColumn("block", F.floor(F.col("us") / span).cast("long"))
    blocks = stored(timed.groupBy("key", "block").agg(F.sort_array(F.collect_set("us")).alias("times")), "blocks")

    # of a key's blocks only (block, first time) is ordered in one place: as many rows as its time span has blocks
    order = Window.partitionBy("key").orderBy("block")
    first = F.col("times")[0]
    chain = blocks.select("key", "block", first.alias("first")).select(
        F.col("key").alias("ck"), F.col("block").alias("cb"), F.lead("block").over(order).alias("next"), F.lead("first", 2).over(order).alias("second"))
    heads = blocks.select(F.col("key").alias("k"), F.col("block").alias("b"), F.slice(
        "times", F.lit(1), F.size(F.filter("times", lambda t: t <= F.col("block") * span + ttl)) + 1).alias("heads"))
    near = blocks.join(chain, F.col("key").eqNullSafe(F.col("ck")) & (F.col("block") == F.col("cb"))).join(heads, F.col("key").eqNullSafe(F.col("k")) & (F.col("next") == F.col("b")), "left")
    nodes = near.select("key", "block", "times", "heads", "second").mapInArrow(
        _entries(ttl, span), f"key {kind}, block long, at array<long>, jump array<long>")
    nodes = nodes.select("key", "block", F.explode(F.arrays_zip("at", "jump")).alias("n")).select(
        "key", "block", F.col("n.at").alias("at"), F.nullif(F.col("n.jump"), F.lit(NONE).cast("long")).alias("jump"))
    opening = blocks.groupBy("key").agg(F.min(first).alias("open"))
    nodes = stored(nodes.join(opening.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).select(
        "key", "block", "at", "jump", (F.col("at") == F.col("open")).alias("taken")), "entries")
    while nodes.where("jump is not null").limit(1).count():
        led = nodes.where("taken and jump is not null").select(F.col("key").alias("lk"), F.col("jump").alias("lt"), F.lit(True).alias("led")).distinct()
        far = nodes.select(F.col("key").alias("fk"), F.col("at").alias("ft"), F.col("jump").alias("far"))
        nodes = nodes.join(led, F.col("key").eqNullSafe(F.col("lk")) & (F.col("at") == F.col("lt")), "left")
        nodes = nodes.join(far, F.col("key").eqNullSafe(F.col("fk")) & (F.col("jump") == F.col("ft")), "left")
        nodes = stored(nodes.select("key", "block", "at", F.col("far").alias("jump"), (F.col("taken") | F.col("led").isNotNull()).alias("taken")), "entries")
    taken = nodes.where("taken").select(F.col("key").alias("k"), F.col("block").alias("b"), "at")
    entered = blocks.join(taken, F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))).select("key", "at", "times")
    return entered.mapInArrow(_listed(ttl), f"key {kind}, misses array<long>").select("key", F.explode("misses").alias("ts"))
