"""Streams over tables that are folders of files, as larger tables are."""

import pytest

from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("folders"))
    for name in ("pages", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_scores", "stream_breakdown", "stream_first_lookups"])
def test_streams_read_folders(spark, folders, name):
    found, expected = (sorted(map(tuple, QUERIES[name](spark, sf).collect())) for sf in (folders, SF))
    assert expected and found == expected


def test_scores_of_a_table_without_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/pages.parquet").limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["stream_scores"](spark, str(tmp_path)).collect() == []
