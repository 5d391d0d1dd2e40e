"""Registered domains from suffix rules."""

from pyspark.sql import functions as F

from webrisk.functions.urls import split_domain
from webrisk.sources.suffixes import make_rules, parse_rules, suffix_rules


def split(spark, hosts, rules=None):
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    return {r.h: (r.subdomain, r.domain, r.suffix, r.base_domain) for r in split_domain(df, "h", rules=rules).collect()}


def test_bundled_rules(spark):
    got = split(spark, ["shop.example.photography", "photography", "co.uk", "a.co.uk", "www.ck", "x.ck", "ck", "10.0.0.7", "", "user.github.io", "A.B.Co.UK"])
    assert got["shop.example.photography"] == ("shop", "example", "photography", "example.photography")
    assert got["photography"] == ("", "", "photography", "photography") and got["co.uk"] == ("", "", "co.uk", "co.uk")
    assert got["a.co.uk"] == ("", "a", "co.uk", "a.co.uk")
    assert got["www.ck"] == ("", "www", "ck", "www.ck") and got["x.ck"] == ("", "", "x.ck", "x.ck")
    assert got["10.0.0.7"] == ("", "10.0.0.7", "", "10.0.0.7") and got[""] == ("", "", "", "")
    assert got["user.github.io"][2] == "io" and got["A.B.Co.UK"] == ("A", "B", "Co.UK", "B.Co.UK")


def test_private_domains_on_request(spark):
    assert split(spark, ["user.github.io"], suffix_rules(spark, private=True))["user.github.io"] == ("", "user", "github.io", "user.github.io")


def test_rules_from_a_list(spark, tmp_path):
    lines = ["// note", "", "zz", "*.zz  trailing words", "!free.zz", "köln", "// ===BEGIN PRIVATE DOMAINS===", "own.zz", "// ===END PRIVATE DOMAINS===", "yy"]
    assert parse_rules(lines, False) == ["zz", "*.zz", "!free.zz", "köln", "yy"] and "own.zz" in parse_rules(lines, True)
    (tmp_path / "list.dat").write_text("\n".join(lines))
    got = split(spark, ["a.b.zz", "b.zz", "zz", "a.free.zz", "shop.xn--kln-sna", "shop.köln", "a.com"], suffix_rules(spark, str(tmp_path / "list.dat")))
    assert [got[h][2] for h in ("a.b.zz", "b.zz", "zz", "a.free.zz", "shop.xn--kln-sna", "shop.köln", "a.com")] == [
        "b.zz", "b.zz", "zz", "zz", "xn--kln-sna", "köln", ""]


def test_rows_are_not_shuffled(spark):
    df = spark.range(10).select(F.concat(F.lit("a.example"), F.col("id").cast("string"), F.lit(".co.uk")).alias("h"))
    plan = split_domain(df, "h", rules=make_rules(spark, ["uk", "co.uk"]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
