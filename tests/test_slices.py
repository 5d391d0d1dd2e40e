"""Events as a stream of slices: each slice is one batch in the order of time, written by all tasks that read the table."""

from pyspark.sql import functions as F

from checks import q_stream
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_a_slice_is_one_batch_of_several_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    seen = []

    def start(stream):
        def write(batch, number):
            row = batch.selectExpr("count(*) as n", "min(ts) as low", "max(ts) as high", "count(distinct file) as files").first()
            seen.append((number, row["n"], row["low"], row["high"], row["files"]))

        return stream.withColumn("file", F.input_file_name()).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()

    q_stream._sliced(spark, str(tmp_path), start)
    assert [s[0] for s in seen] == [0, 1, 2, 3] and sum(s[1] for s in seen) == events.count()
    assert all(a[3] < b[2] for a, b in zip(seen, seen[1:]))
    assert all(s[4] > 1 for s in seen)


def test_misses_of_folders_of_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found, expected = (sorted(map(tuple, QUERIES["stream_lookup_misses"](spark, sf).collect())) for sf in (str(tmp_path), SF))
    assert found == expected
