"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from checks.compare import TABLES, _rows
from checks.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows, f"{name} returned nothing"
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert _rows(df.columns, rows) == _rows(columns, cur.fetchall())


def test_every_rule_fires_and_does_not_fire(spark):
    from webrisk import catalogs as K

    sf = "/root/testdata/sf0.01"
    for query, key, catalog in (
        ("url_evidence", "page_id", K.URL_RULES), ("dom_evidence", "page_id", K.DOM_RULES),
        ("content_evidence", "doc_id", K.CONTENT_RULES),
    ):
        rows = QUERIES[query](spark, sf).select(key, "code").distinct().groupBy("code").count().collect()
        total = spark.read.parquet(f"{sf}/{'pages' if key == 'page_id' else 'documents'}.parquet").count()
        counts = {r["code"]: r["count"] for r in rows}
        for code in catalog:
            assert 0 < counts.get(code, 0) < total, code
