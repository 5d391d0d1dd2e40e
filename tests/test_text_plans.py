"""Exploding the issues of a text does not repeat its searches in a filter at the scan."""

from checks.registry import QUERIES


def test_issues_search_a_text_once(spark):
    plans = [QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() for q in ("text_scores", "text_issues")]
    once, issues = (p.count("(?<![A-Za-z].)") for p in plans)
    assert issues == once == 1
