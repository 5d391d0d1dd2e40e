"""Imitated brands by deletion neighbourhood, against the expression over sixteen brands and on odd rows."""

from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import urls as U
from webrisk.operators.typosquat import with_imitated_brand


def test_same_hits_as_the_expression(spark):
    import random

    rng = random.Random(5)
    labels = set(K.BRANDS) | set(K.LEGIT_BRAND_TOKENS) | {None, "", "x", "zzz"}
    for brand in K.BRANDS:
        for _ in range(12):
            i = rng.randrange(len(brand))
            labels |= {brand[:i] + brand[i + 1:], brand[:i] + "q" + brand[i:], brand[:i] + "q" + brand[i + 1:], f"my{brand.upper()}x", brand[:i] + "qq" + brand[i:]}
    df = spark.createDataFrame([(x,) for x in labels], "label string").repartition(4)
    brands = spark.createDataFrame([(b,) for b in K.BRANDS], "brand string")
    got = with_imitated_brand(df, "label", brands, K.LEGIT_BRAND_TOKENS).select("label", "imitated_brand", U.typosquat_brand(F.col("label")).alias("want")).collect()
    assert len(got) == len(labels) and [r for r in got if r.imitated_brand != r.want] == []
    assert sum(r.want is not None for r in got) > 100


def test_odd_rows(spark):
    df = spark.createDataFrame([("Paypa1",), ("paypa1",), (None,), ("",), ("a" * 300,)], "label string")
    brands = spark.createDataFrame([("PayPal",), (None,), ("",), ("b" * 64,)], "brand string")
    assert sorted((r.label or "", r.imitated_brand) for r in with_imitated_brand(df, "label", brands).collect()) == [
        ("", None), ("", None), ("Paypa1", "paypal"), ("a" * 300, None), ("paypa1", "paypal")]
    assert [r.imitated_brand for r in with_imitated_brand(df.limit(1), "label", brands.where("false")).collect()] == [None]


def test_plan_does_not_grow_per_brand(spark):
    df = spark.createDataFrame([("store12x",)], "label string")
    brands = spark.range(10_000).select(F.concat(F.lit("store"), F.col("id").cast("string")).alias("brand"))
    out = with_imitated_brand(df, "label", brands)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert out.first().imitated_brand == "store1"
