"""Signals of interaction logs as running minima: the same as the evidence rows, whatever the log's length."""

from pyspark.sql import functions as F

from webrisk.operators.interaction import interaction_evidence, interaction_results


def test_signals_match_the_evidence_rows(spark):
    fields = ["forms", "visibleCredentialFields", "iframes", "overlays"]
    count = lambda k: F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), ((F.col("step") * (k + i) + F.col("page_id")) % (4 + i)).cast("int"))])
    log = spark.range(400).select((F.col("id") % 4).alias("page_id"), F.floor(F.col("id") / 4).cast("int").alias("step")).select(
        "page_id", "step", F.lit("https://a.example.com/").alias("url_before"),
        F.when(F.col("step") % 9 == 4, "https://b.example.org/").otherwise("https://a.example.com/").alias("url_after"),
        count(3).alias("before"), count(5).alias("after"), (F.col("step") % 5).cast("int").alias("dialogs"), F.lit(0).alias("popups"))
    want = {}
    for r in interaction_evidence(log, ["page_id"]).collect():
        want.setdefault(r.page_id, set()).add((r.code, r.severity, r.score_impact))
    full = interaction_results(log, ["page_id"]).collect()
    lean = interaction_results(log, ["page_id"], events=False)
    assert {r.page_id: {(s.code, s.severity, s.score_impact) for s in r.interaction_signals} for r in full} == want
    assert all([e.step for e in r.interaction_events] == list(range(100)) for r in full)
    assert {r.page_id: r.interaction_signals for r in lean.collect()} == {r.page_id: r.interaction_signals for r in full}
    assert "collect_list" not in lean._jdf.queryExecution().optimizedPlan().toString() and lean.first().interaction_events == []
