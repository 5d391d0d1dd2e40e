"""Line deduplication with levelled sorted runs of line hashes.

A store holds runs: tables of (hash, documents, owner), bucketed and sorted by hash. A new batch
is merge-anti-joined with the runs: only keys that no run holds enter with an owner, the others add to their
documents. The batch becomes a run of level 0. When a level holds `fanout` runs they are merged into one of the next level, so the
number of runs stays logarithmic and every key is rewritten once per level.

Batches are taken from the largest doc_id down, so the document in which a key appears first is the
largest that holds it: its owner.

Defined results: a null text is one empty line; rows without a doc_id keep all lines and
are not counted; rows that repeat a doc_id are one document; an empty table gives an empty result; columns
other than doc_id and text are passed on in a struct of their own, whatever their names. Keys are compared by a 128-bit hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrisk.llm import columns as C
from webrisk.session import shared_root

RUN = "h1 long, h2 long, n_docs long, owner long"


class LineStore:
    """Runs under one shared folder, as external bucketed tables of this session's catalog."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.root = f"{root or shared_root(spark)}/lines-{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = {}

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        # the aggregation below has already dealt the rows by hash, so every task holds a few buckets
        (run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{name}")
         .format("parquet").saveAsTable(name))
        self.levels.setdefault(level, []).append(name)

    def _rows(self, name: str) -> DataFrame:
        """A run's rows read by path: a union of bucketed tables may be grouped without the exchange that it needs."""
        return self.spark.read.schema(RUN).parquet(f"{self.root}/{name}")

    def runs(self) -> DataFrame:
        """All runs, merged key by key."""
        found = [self._rows(n) for names in self.levels.values() for n in names]
        if not found:
            return self.spark.createDataFrame([], RUN)
        return self._merge(found)

    @staticmethod
    def _merge(parts: list[DataFrame]) -> DataFrame:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        # a key has one owner, from the batch that it was fresh in
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.min("owner").alias("owner"))

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds: one merge anti join per run."""
        for names in self.levels.values():
            for n in names:
                keys = keys.join(self.spark.table(n).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, doc_id): a key's owner is recorded where it is fresh, its count always."""
        own = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
        if self.levels:
            own = C.stored(own, "line-batch")
            first = self.fresh(own)
            again = own.join(first.select("h1", "h2"), ["h1", "h2"], "left_anti")
            own = first.select("h1", "h2", "n_docs", "owner").unionByName(
                again.select("h1", "h2", "n_docs", F.lit(None).cast("long").alias("owner")))
        self._write(own, 0)
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            names = self.levels.pop(level)
            self._write(self._merge([self._rows(n) for n in names]), level + 1)
            for n in names:
                self.spark.sql(f"drop table {n}")
            level += 1


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key has at least min_chars code points."""
    text = C.whole_text()
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), C.row_key(text).alias("row"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", F.btrim("line", F.lit(C.WHITE)).alias("key")).where(
        F.char_length("key") >= min_chars)
    key = C.lower_ascii(F.col("key"))
    return keys.select("doc_id", "row", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, store: LineStore | None = None,
) -> DataFrame:
    """Per row of docs: doc_id, row, n_lines, n_dropped, the kept text, and `source_row` with all other columns.

    A key of at least min_chars code points found in at least min_docs documents loses all its lines but
    those of the largest doc_id that holds it.
    """
    spark = docs.sparkSession
    store = store or LineStore(spark)
    lines = C.stored(line_keys(docs, min_chars), "lines")
    cuts = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts), reverse=True), None]
    for top, bottom in zip(edges, edges[1:]):
        batch = lines
        if top is not None:
            batch = batch.where(F.col("doc_id") < top)
        if bottom is not None:
            batch = batch.where(F.col("doc_id") >= bottom)
        store.add(batch.select("h1", "h2", "doc_id").distinct())
    frequent = store.runs().where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner")
    drops = (lines.join(frequent, ["h1", "h2"]).where(F.col("doc_id") != F.col("owner"))
             .groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("at")))
    text = C.whole_text()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.row_key(text).alias("row"), text.alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("source_row"))
    joined = base.join(drops, ["doc_id", "row"], "left").withColumn("lines", F.split("text", "\n", -1))
    # one flag per line, built from the gaps between dropped positions: linear in the lines
    gaps = F.transform("at", lambda p, i: F.concat(F.repeat(
        F.lit("0"), p - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("at"), i - 1) + 1)), F.lit("1")))
    flags = F.split(F.rpad(F.array_join(gaps, ""), F.size("lines"), "0"), "")
    kept = F.transform(F.filter(F.arrays_zip(F.col("lines").alias("line"), flags.alias("flag")),
                                lambda x: x["flag"] == "0"), lambda x: x["line"])
    return joined.select(
        "doc_id", "row", "source_row", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))
