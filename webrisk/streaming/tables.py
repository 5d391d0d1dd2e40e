"""Tables with one row per key that a stream keeps current, batch by batch.

A table is cut into hash parts of its keys. A batch rewrites only the parts that its keys fall in: the new version of such
a part stands beside the old one, under the batch's number, and counts once the batch's mark is set. So readers never see
half a batch, a batch that is run again after a failure starts from what stood before it and gives the same rows, and one
that was already marked changes nothing. A part keeps its newest version and the one before. Numbers of batches come from
a stream's checkpoint: a table and its checkpoint belong together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART, BATCH = "kt_part", "kt_batch"


class KeyedTable:
    """One row per value of `keys` (nulls are values) under a shared folder.

    `parts` bounds what a batch rewrites around its keys, and the folders that the driver lists; it must not change over
    the life of a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path, keys, parts
        self.schema = spark.createDataFrame([], schema).schema

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path
        return folder, folder(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _found(self, pattern: str) -> list[str]:
        folder, files = self._files()
        return [str(f.getPath()) for f in files.globStatus(folder(f"{self.path}/{pattern}")) or []]

    def _remove(self, paths: list[str]) -> None:
        folder, files = self._files()
        for path in paths:
            files.delete(folder(path), True)

    def committed(self) -> int:
        """The newest batch whose rows count; -1 before the first."""
        return max((int(p.rsplit("/", 1)[1]) for p in self._found("marks/*")), default=-1)

    def versions(self) -> dict[int, dict[int, str]]:
        """Part → batch → folder, written parts only."""
        found: dict[int, dict[int, str]] = {}
        for path in self._found(f"rows/{PART}=*/{BATCH}=*"):
            part, batch = (int(name.rsplit("=", 1)[1]) for name in path.rsplit("/", 2)[1:])
            found.setdefault(part, {})[batch] = path
        return found

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The rows after the last marked batch, or as they stood before a batch; of all parts or some."""
        limit = self.committed() if before is None else min(self.committed(), before - 1)
        folders = []
        for part, batches in self.versions().items():
            seen = [b for b in batches if b <= limit]
            if seen and (parts is None or part in parts):
                folders.append(batches[max(seen)])
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def upsert(self, rows: DataFrame, batch_id: int, keep: Column | None = None) -> None:
        """Put rows, one per key, in the place of those of the same keys. Other rows of the parts met go unless `keep` holds for them."""
        if batch_id <= self.committed():
            return
        stage = f"{self.path}/staged"
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        rows.select(*self.schema.names).write.mode("overwrite").parquet(stage)
        rows = self.spark.read.schema(self.schema).parquet(stage)
        met = [r[0] for r in rows.select(part).distinct().collect()]  # at most `parts` numbers
        old = self.read(batch_id, met)
        new = rows.select(*[F.col(k).alias(f"kt_{i}") for i, k in enumerate(self.keys)])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"kt_{i}")) for i, k in enumerate(self.keys)])
        stay = old.join(new, same, "left_anti")
        if keep is not None:
            stay = stay.where(keep)
        merged = stay.unionByName(rows).withColumns({PART: part, BATCH: F.lit(batch_id)})
        # rows of a part meet in few tasks, and parts too large for one are split
        merged.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            PART, BATCH).parquet(f"{self.path}/rows")
        self._mark(batch_id)
        outdated = []
        for number, batches in self.versions().items():
            if number in met:
                outdated += [batches[b] for b in sorted(batches)[:-2]]
        self._remove([*outdated, stage])

    def _mark(self, batch_id: int) -> None:
        earlier = self._found("marks/*")
        folder, files = self._files()
        files.create(folder(f"{self.path}/marks/{batch_id}"), True).close()
        self._remove(earlier)
