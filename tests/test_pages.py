"""Page parsing and end-to-end scoring."""

import pytest
from pyspark.sql import functions as F

from webrisk.operators.html import page_elements, page_text, parse_pages
from webrisk.operators.interaction import interaction_results
from webrisk.operators.intel import intel_results
from webrisk.plans.score import ScoreOptions, score_pages, score_texts, threat_report

#: Built from the snippets of FIXTURES §3: id, url, visible text, html.
SECRET = '<input type="password" name="password">'
PAGES = [
    ("two_forms", "https://shop.example.com/p/17", "urgent act now: account suspended, verify your account",
     f'<body><form action="https://collect.example.test/x"><input name="email">{SECRET}</form>'
     f'<form style="display:none" action="/x">{SECRET}</form></body>'),
    ("forwards", "https://shop.example.net/p/18", "Unusual activity detected on the shelf.",
     '<head><meta http-equiv="refresh" content="3;url=https://cdn0.example.test/"></head>'
     '<body><div class=modal style="position:fixed;z-index:9">stock list</div><script>location.href="/next"</script></body>'),
    ("asks", "https://shop.example.org/p/19", "Prices include tax.",
     "<body><script>Notification.requestPermission(); document.oncontextmenu = f; d.requestFullscreen()</script></body>"),
    ("trusted", "https://shop.okta.com/oauth2/stock", "Stock list of the shop",
     '<body><script>location.href="/example"</script></body>'),
    ("plain", "https://shop.example.com/p/20", "Closed on Sundays.", "<body><p>Closed on Sundays.</p></body>"),
    ("empty", "https://shop.example.com/p/21", "", ""),
    ("bad", "https://shop.example.com:70000/p", "Prices", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id string, url string, page_text string, html string")


@pytest.fixture(scope="module")
def scored(pages):
    df = score_pages(pages, options=ScoreOptions(model_sees_page=False, with_timeline=True),
                     started_at=F.lit("2024-01-01").cast("timestamp"))
    return {r.page_id: r for r in df.collect()}


def test_parser_edges(spark):
    rows = [
        (1, "<FORM ACTION=/x><INPUT TYPE=password></FORM><input name=a>"),
        (2, "<form><div><input name=b></div><p>un&amp;closed"),
        (3, "<script>var a='<form>';</script><style>p{}</style><p> x </p>y<!-- c -->z"),
        (4, ""), (5, None), (6, "<div><form><input></div><input>"),
        (7, "<form id=o><form id=i><input></form></form>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string")
    els = {}
    for r in page_elements(df).collect():
        els.setdefault(r.page_id, []).append((r.tag, r.form_seq, dict(r.attrs)))
    assert els[1] == [("form", None, {"action": "/x"}), ("input", 0, {"type": "password"}), ("input", None, {"name": "a"})]
    assert els[2][2] == ("input", 0, {"name": "b"})
    assert [e[0] for e in els[3]] == ["script", "style", "p"]
    assert els[6][2][1] == 1 and els[6][3][1] is None
    assert 4 not in els and 5 not in els
    assert parse_pages(df).filter("page_id = 7").first().elements[2].forms == [0, 1]
    text = {r.page_id: r.page_text for r in page_text(df).collect()}
    assert text[2] == "un&closed" and text[3] == "x y z" and text[4] is None and text[5] is None


def test_verdicts(scored):
    row = scored["two_forms"]
    assert row.classification == "Suspicious"
    assert {s.code for s in row.dom_signals} == {
        "dom-external-credential-post", "dom-hidden-credential-form", "dom-multiple-credential-forms"}
    assert {p.code for p in row.attack_patterns} >= {"credential-harvesting", "fake-account-verification"}
    assert [p.code for p in scored["forwards"].attack_patterns] == ["redirect-based-phishing"]
    assert len(scored["asks"].dom_signals) == 3 and scored["asks"].risk_score <= scored["asks"].risk_cap == 20
    assert scored["plain"].classification == "Safe" and scored["plain"].risk_cap == 20
    assert scored["bad"].status == "error" and scored["bad"].risk_score is None
    assert scored["empty"].dom_signals == []


def test_trusted_domain_suppresses(scored):
    row = scored["trusted"]
    assert row.is_trusted and row.trust_category == "trusted-provider"
    redirect = next(s for s in row.dom_signals if s.code == "dom-scripted-redirect-logic")
    assert redirect.severity == "low" and redirect.score_impact == 6
    assert redirect.confidence == pytest.approx(0.61) and redirect.reliability == pytest.approx(0.66)
    assert redirect.escalation_contribution >= 11 and len(row.suppressed) == 1
    assert "calibration_note" in redirect.analyst_details


def test_invariants(scored):
    for row in scored.values():
        if row.status == "error":
            continue
        assert 0 <= row.risk_score <= 100
        if row.risk_cap is not None:
            assert row.risk_score <= row.risk_cap
        events = row.timeline
        assert events[0].title == "Investigation initialized" and events[-1].score_after == row.risk_score
        assert [e.event_id for e in events] == [f"evt-{i + 1:03d}" for i in range(len(events))]
        for a, b in zip(events, events[1:]):
            assert b.confidence_after >= a.confidence_after
        assert events[-1].confidence_after <= 0.99


def test_timeline_confidence_by_brute_force(scored):
    boost = {"critical": 0.11, "high": 0.09, "medium": 0.07, "low": 0.04, "info": 0.02}
    for row in scored.values():
        if row.status == "error":
            continue
        running = 0.2
        for e in row.timeline:
            if e.stage in ("escalation", "conclusion") or e.detail.startswith("Applied normalization"):
                continue
            running = min(0.97, running + boost[e.severity] + min(0.08, e.score_delta * 0.002))
            assert e.confidence_after == pytest.approx(round(running, 2), abs=1e-9)


def test_model_probability_and_page_visibility(spark, pages):
    df = pages.withColumn("url_probability_in", F.lit(0.97))
    rows = {r.page_id: r for r in score_pages(df).collect()}
    assert all(r.url_score > 60 for r in rows.values())
    assert "model-url-fallback" not in {s.code for s in rows["two_forms"].model_signals}
    assert "mailto" in {s.code for s in rows["two_forms"].model_signals}


def test_findings_and_interactions(spark, pages):
    payloads = spark.createDataFrame(
        [(PAGES[4][1], "virustotal", '{"data":{"attributes":{"stats":{"malicious":4}}}}', "2024-01-01 00:00:00")],
        "url string, provider string, payload string, ts string")
    log = spark.createDataFrame(
        [("plain", s, PAGES[4][1], "https://other.example.org/", {"forms": 0}, {"forms": 2, "visibleCredentialFields": 1}, 0, 0)
         for s in (1, 2)],
        "page_id string, step int, url_before string, url_after string, before map<string,int>, "
        "after map<string,int>, dialogs int, popups int")
    df = score_pages(
        pages, findings=intel_results(payloads), interactions=interaction_results(log, ["page_id"]),
        options=ScoreOptions(with_timeline=True))
    rows = {r.page_id: r for r in df.collect()}
    plain = rows["plain"]
    assert plain.intel_score == 88 and plain.reputation_score == 88
    assert len(plain.interaction_events) == 2
    codes = [s.code for s in plain.dom_signals]
    assert codes == ["interaction-triggered-redirect", "interaction-hidden-credential-reveal",
                     "interaction-dynamic-form-injection"]
    assert "multi-step-phishing-flow" in {p.code for p in plain.attack_patterns}
    assert any(e.stage == "interaction-simulation" for e in plain.timeline)
    assert len(rows) == len(PAGES) and rows["trusted"].intel_score == 0


def test_text_mode_and_report(spark, pages, scored):
    texts = spark.createDataFrame([(1, "verify your account now, payment failed"), (2, " ")], "id long, text string")
    rows = {r.id: r for r in score_texts(texts, ["id"]).collect()}
    assert rows[1].text_score == 40 and rows[2].text_score == 0
    assert rows[1].model_signals[0].code == "model-text-scam-likelihood"
    report = threat_report(score_pages(pages.limit(1)), ["page_id"]).first().report
    assert '"threat_level"' in report and '"technical_findings"' in report


def test_match_preview_joins_groups(spark):
    from webrisk.operators.text_rules import content_evidence

    text = "Act within 5 minutes. Urgent! Account locked."
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = {r.code: r for r in content_evidence(df, ["id"]).collect()}
    urgency = rows["content-urgency-pressure"]
    assert urgency.value == "2" and urgency.score_impact == 14
    assert urgency.description == "Detected 2 phishing-linked language matches (within 5 minutes minutes, urgent)."
    assert "(account locked locked)" in rows["content-scare-tactics"].description


def test_fix_codes_option(spark, pages):
    html = "<html><body><script>d.requestFullscreen()</script></body></html>"
    df = spark.createDataFrame([(1, "https://a.example.com/", html)], "page_id long, url string, html string")
    off = score_pages(df, options=ScoreOptions(model_sees_page=False)).first()
    on = score_pages(df, options=ScoreOptions(model_sees_page=False, fix_codes=True)).first()
    assert off.strong_rows == 0 and on.strong_rows == 1


def test_filter_on_verdict_stays_above_the_pipeline(spark, pages):
    df = score_pages(pages).filter("risk_score >= 20").select("page_id", "risk_score")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000
    assert df.count() >= 1
