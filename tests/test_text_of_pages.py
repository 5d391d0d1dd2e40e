"""The SQL of page_text reads character references as the query does: cut ones and the longest name too."""

import duckdb

from checks.registry import ORACLES, QUERIES

TITLES = ["a&amp", "a&am", "&quot b", "&copy2024&middot", "&copysr; &amp;amp; &ampquot;", "R&D & &lt;b&gt &unknown;", "&", "&hellip;&&amp;&"]


def test_references_without_semicolon(spark, tmp_path):
    rows = [(i, f"https://a.example/{i}", f"<html><head><title>{t}</title></head><body><p>x &amp; y</p></body></html>") for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = sorted(map(tuple, QUERIES["page_text"](spark, str(tmp_path)).collect()))
    assert found == sorted(con.execute(ORACLES["page_text"]).fetchall())
    assert found[0][1] == "a& x & y"
