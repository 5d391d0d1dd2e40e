"""Inputs derived from the driver tables for the registered queries.

The raw tables fire almost no rule, so every page, document and event is given a
planted variant by arithmetic on its id. All rows take part; nothing is filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webrisk.functions.urls import url_host
from webrisk.operators.signals import SIGNALS_DDL, fired, signal


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cases(k: Column, values: dict[int, Column | str], default: Column) -> Column:
    expr = None
    for key, value in values.items():
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(k == key, v) if expr is None else expr.when(k == key, v)
    return expr.otherwise(default)


def planted_urls(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, url: one of fourteen URL shapes per page."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    i = F.col("page_id").cast("string")
    h = url_host(F.col("url"))
    shapes = {
        1: F.concat(F.lit("http://10.0."), (F.col("page_id") % 200).cast("string"), F.lit(".7/x")),
        2: F.concat(F.lit("https://user@"), h, F.lit("/")),
        3: F.concat(F.lit("https://bit.ly/x"), i),
        4: "https://a.b.c.shop.example.com/",
        5: "https://a.b.c.d.e.shop.example.com/",
        6: "https://q7x9zk2vj4wm8p1t5r.example.com/",
        7: F.concat(F.lit("https://store"), i, F.lit(".xyz/")),
        8: "https://xn--pypl-53dc.example.com/",
        9: "https://paypa1.com/",
        10: F.concat(F.lit("https://"), h, F.lit("/?redirect=1&token=2")),
        11: F.concat(F.lit("https://"), h, F.lit("/" + "%41" * 14)),
        12: F.concat(F.lit("https://"), h, F.lit("/a/b/c/d/e/f")),
        13: F.concat(F.lit("https://"), h, F.lit(":8080/")),
    }
    return pages.select("page_id", cases(F.col("page_id") % 14, shapes, F.col("url")).alias("url"))


PASSWORD = '<input type="password" name="password">'
EMAIL = '<input name="email">'
SNIPPETS = {
    1: f'<form action="">{PASSWORD}</form>',
    2: f'<form action="https://collect.example.test/x">{EMAIL}{PASSWORD}</form>',
    3: ('<form action="http://', f'/p">{PASSWORD}</form>'),
    4: f'<form action="/x" style="display:none">{PASSWORD}</form>',
    5: '<form action="/x"><input type=password hidden></form>',
    6: f'<form class="overlay" action="/x">{EMAIL}{PASSWORD}</form>',
    7: f'<form action="/x">{PASSWORD}</form><form action="/x">{PASSWORD}</form>',
    8: '<iframe width="0" src="/a"></iframe><iframe src="/b"></iframe><iframe src="/c"></iframe>',
    9: '<meta http-equiv="refresh" content="5;url=/n">',
    10: "".join(f'<script src="https://cdn{i}.example.test/a.js"></script>' for i in range(6)),
    11: "<script>eval(x);location.href='/n';f.addEventListener('submit',g)</script>",
    12: "<script>navigator.clipboard.readText();Notification.requestPermission();"
        "document.oncontextmenu=f;d.requestFullscreen();alert(1)</script>",
    13: "<p>paypal account suspended, act now</p>",
    14: '<div class="modal" style="position:fixed;z-index:9">x</div>',
    15: "<div hidden>h</div>" * 12,
}


def planted_pages(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, url, html: one of sixteen snippets right after <body>."""
    return plant_snippets(table(spark, sf, "pages"))


def plant_snippets(pages: DataFrame) -> DataFrame:
    h = url_host(F.col("url"))
    snippets = {
        k: F.concat(F.lit(v[0]), h, F.lit(v[1])) if isinstance(v, tuple) else F.lit(v)
        for k, v in SNIPPETS.items()
    }
    snippet = cases(F.col("page_id") % 16, snippets, F.lit(""))
    return pages.select(
        "page_id", "url",
        F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), snippet)).alias("html"))


PHRASES = {
    1: "urgent act now", 2: "account suspended", 3: "claim your prize winner",
    4: "verify your account", 5: "payment failed", 6: "security team dear customer",
    7: "READ THIS NOTE NOW !!!!!!",
}


def planted_texts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text: one of eight phrases appended to every document."""
    docs = table(spark, sf, "documents")
    phrase = cases(F.col("doc_id") % 8, PHRASES, F.lit(""))
    return docs.select("doc_id", F.concat_ws(" ", "text", phrase).alias("text"))


def scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scan history rows from the event table."""
    score = F.least(F.lit(100), F.floor("value")).cast("int")
    name = F.when(score < 25, "Safe").when(score < 50, "Suspicious").when(score < 75, "Dangerous").otherwise("Critical")
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), "user_id",
        F.concat(F.lit("https://site"), (F.col("user_id") % 97).cast("string"),
                 F.lit(".example.com/"), F.col("event_id").cast("string")).alias("url"),
        F.when(F.col("event_type") == "click", "url").when(F.col("event_type") == "view", "page")
        .otherwise("other").alias("scan_type"),
        score.alias("risk_score"), name.alias("classification"),
        F.round(F.least(F.lit(0.99), F.col("value") / 500 + 0.15), 2).alias("confidence"),
        F.concat(F.lit("scan of a "), F.col("event_type"), F.lit(" event")).alias("explanation"),
        F.col("ts").alias("created_at"), F.to_date("ts").alias("scan_date"),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation records from scans: a label, and missing scores and unknown labels for some."""
    s = scans(spark, sf)
    i = F.col("id")
    return s.select(
        "id", "url",
        F.when(i % 31 == 0, -1).when((i * 7 + F.col("risk_score")) % 100 < F.col("risk_score"), 1)
        .otherwise(0).alias("true_label"),
        F.when(i % 29 == 0, None).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(i % 29 == 0, "error").when(i % 37 == 0, "timeout_exceeded").otherwise("ok").alias("status"),
        (i % 37 == 0).alias("timeout_exceeded"),
        ((i % 64).cast("double") / 64).alias("duration_seconds"),
        F.array_compact(F.array(
            F.when(i % 2 == 0, F.lit("credential-harvesting")),
            F.when(i % 3 == 0, F.lit("redirect-based-phishing")),
            F.when(i % 5 == 0, F.lit("brand-impersonation")),
        )).alias("attack_patterns"),
    )


def labeled_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URL records with duplicates and invalid rows, in three sources, from the event table."""
    e = table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    url = F.concat(
        F.when(i % 4 == 0, "http://").otherwise("https://"), F.lit("host"), u.cast("string"),
        F.lit("-"), (i % 53).cast("string"), F.lit(".example.com/"), (i % 7).cast("string"))
    return e.select(
        F.when(i % 41 == 0, None).otherwise(url).alias("url"),
        (u % 3 == 0).cast("int").alias("label"),
        F.concat(F.lit("feed"), (u % 3).cast("string")).alias("source_dataset"),
        F.concat(F.lit("/data/feed"), (u % 3).cast("string"), F.lit(".txt")).alias("source_file"),
        i.alias("line_no"))


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """id, label, phishing_probability with ties, predicted_label."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    p = (i * 7919 % 1000).cast("double") / 1000
    return e.select(
        i.alias("id"), ((i * 31 % 1000) < (i * 7919 % 1000)).cast("int").alias("label"),
        p.alias("phishing_probability"), (p >= 0.5).cast("int").alias("predicted_label"))


# (bucket, source, code, title, severity, category, impact, confidence, reliability, description)
EVIDENCE = [
    ("url", "url", "url-non-https", "Plain transport", "medium", "transport", 11, 0.84, 0.74, "no encryption"),
    ("url", "url", "url-suspicious-tld", "Odd ending", "medium", "infrastructure", 12, 0.78, 0.74, "odd"),
    ("url", "url", "url-typosquat-pattern", "Look-alike", "high", "spoofing", 23, 0.88, 0.74, "alike"),
    ("url", "url", "url-deep-path", "Deep path", "medium", "structure", 9, 0.67, 0.74, "deep"),
    ("dom", "dom", "dom-external-credential-post", "Foreign post", "critical", "credential-harvest", 30, 0.96, 0.74, "goes elsewhere"),
    ("dom", "dom", "dom-external-credential-post", "Foreign post", "critical", "credential-harvest", 28, 0.90, 0.55, "to the contact page"),
    ("dom", "dom", "dom-meta-refresh-redirect", "Refresh", "medium", "delivery", 12, 0.78, 0.74, "refresh"),
    ("dom", "dom", "dom-scripted-redirect-logic", "Scripted", "medium", "delivery", 11, 0.73, 0.74, "script"),
    ("dom", "dom", "dom-suspicious-event-listeners", "Hooks", "medium", "behavioral-manipulation", 14, 0.78, 0.74, "hooks"),
    ("dom", "dom", "dom-notification-abuse", "Prompts", "medium", "behavioral-manipulation", 12, 0.74, 0.74, "prompts"),
    ("dom", "dom", "dom-deceptive-popup-pattern", "Popups", "medium", "social-engineering", 12, 0.71, 0.74, "popups"),
    ("dom", "dom", "dom-account-suspension-language", "Suspended", "high", "social-engineering", 18, 0.84, 0.74, "locked out"),
    ("dom", "dom", "dom-urgency-banner-language", "Urgent", "medium", "social-engineering", 11, 0.72, 0.74, "hurry"),
    ("dom", "interaction", "interaction-popup-scare-flow", "Scare", "medium", "social-engineering", 14, 0.78, 0.73, "scare"),
    ("content", "content", "content-urgency-pressure", "Pressure", "medium", "social-engineering", 12, 0.71, 0.74, "now"),
    ("content", "content", "content-scare-tactics", "Fear", "high", "social-engineering", 17, 0.71, 0.74, "fear"),
    ("content", "content", "content-fake-reward", "Prize", "medium", "fraud-lure", 11, 0.71, 0.74, "prize"),
    ("content", "content", "content-payment-pressure", "Pay", "medium", "financial-fraud", 13, 0.71, 0.74, "pay"),
    ("content", "content", "content-impersonation-language", "Posing", "medium", "spoofing", 10, 0.71, 0.74, "posing"),
    ("content", "content", "content-emotional-amplification", "Shouting", "low", "social-engineering", 8, 0.62, 0.74, "loud"),
    ("reputation", "reputation", "reputation-virustotal-malicious", "Reported", "high", "virustotal", 22, 0.9, 0.9, "reported"),
    ("model", "model", "model-url-phishing-probability", "Model", "low", "url-model", 9, 0.5, 0.5, "raw score"),
    ("model", "model", "mailto", "Mail markers", "medium", "url-model", 13, 0.72, 0.68, "mail"),
]


def present(j: int) -> Column:
    """Which template rows a page carries."""
    return (F.col("page_id") * (j + 3) + j * j) % 5 < 2


def planted_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Five signal arrays and all score inputs of the fusion, from page_id arithmetic."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    i = F.col("page_id")
    arrays = {}
    for bucket in ("url", "dom", "content", "reputation", "model"):
        arrays[f"{bucket}_signals"] = fired([
            (present(j), signal(code, title, text, sev, src, cat, impact, conf, rel))
            for j, (b, src, code, title, sev, cat, impact, conf, rel, text) in enumerate(EVIDENCE)
            if b == bucket
        ]).cast(SIGNALS_DDL)
    hops = (i % 5).cast("int")
    return pages.withColumns({
        **arrays,
        "normalized_url": F.col("url"),
        "is_trusted": i % 6 == 0,
        "oauth_context": i % 2 == 0, "mfa_context": i % 3 == 0,
        "notification_context": i % 4 == 0, "analytics_context": i % 5 == 0,
        "redirect_chain": F.slice(F.array(*[F.lit(f"https://hop{n}.example.com/") for n in range(4)]), 1, hops),
        "url_score": (i * 37 % 101).cast("int"),
        "model_loaded": i % 3 != 0,
        "calibrated_url_score": (i * 13 % 90).cast("int"),
        "url_confidence": (i % 64).cast("double") / 64,
        "text_score": (i * 11 % 80).cast("int"), "text_confidence": (i % 32).cast("double") / 32,
        "intel_score": (i * 17 % 60).cast("int"), "intel_confidence": (i % 16).cast("double") / 16,
        "text_sub_scores": F.create_map(
            F.lit("urgency_pressure"), (i % 37).cast("int"), F.lit("reward_lure"), (i % 11).cast("int")),
        "suppressed": F.array().cast("array<int>"),
        "trust_score": F.when(i % 6 == 0, 55).otherwise(0),
    })


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded provider payloads, three providers over a few hundred urls."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    v = F.floor("value").cast("int")
    provider = F.when(i % 3 == 0, "virustotal").when(i % 3 == 1, "urlscan").otherwise("abuseipdb")
    vt = F.format_string(
        '{"data":{"attributes":{"stats":{"malicious":%d,"suspicious":%d,"harmless":%d,"undetected":%d}}}}',
        v % 4, i % 3, i % 50, i % 20)
    us = F.when(i % 7 == 0, F.lit('{"uuid":"u1","result":"https://r.example.com","message":"ok"}')).when(
        i % 5 == 0, F.lit('{"message":"queued"}')).otherwise(
        F.format_string('{"verdicts":{"overall":{"score":%d}}}', v % 120))
    ab = F.format_string(
        '{"data":{"abuseConfidenceScore":%d,"totalReports":%d,"usageType":"hosting"}}', v % 101, i % 60)
    return e.select(
        i.alias("id"),
        F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com/")).alias("url"),
        provider.alias("provider"), F.col("ts"),
        F.when(provider == "virustotal", vt).when(provider == "urlscan", us).otherwise(ab).alias("payload"),
        F.lit("10.1.2.3").alias("ip"),
        F.when(i % 23 == 0, F.lit("timed out")).alias("error"),
    )


COUNTERS = ["forms", "iframes", "visibleCredentialFields", "hiddenCredentialFields",
            "suspiciousOverlays", "hiddenElements", "urgencyTextHits"]


def interaction_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three recorded steps per page."""
    pages = table(spark, sf, "pages").select("page_id")
    log = pages.select("page_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step"))
    i, s = F.col("page_id"), F.col("step")

    def counters(shift: int) -> Column:
        pairs: list[Column] = []
        for j, name in enumerate(COUNTERS):
            pairs += [F.lit(name), ((i * (j + 2) + s * (j + 1 + shift) + shift * j) % 3).cast("int")]
        return F.create_map(*pairs)

    host = F.concat(F.lit("https://p"), i.cast("string"), F.lit(".example.com/"))
    after = (
        F.when((i + s) % 5 == 0, F.concat(host, F.lit("login")))
        .when((i + s) % 7 == 0, F.lit("https://elsewhere.example.net/"))
        .when((i + s) % 11 == 0, F.lit("https://accounts.google.com/x"))
        .when((i + s) % 13 == 0, F.concat(host, F.lit("home"))).otherwise(host)
    )
    return log.withColumns({
        "url_before": host, "url_after": after, "before": counters(0), "after": counters(1),
        "dialogs": (i % 2).cast("int"), "popups": ((i + s) % 3 == 0).cast("int"),
    })


def click_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded click targets: selectors x matches per page."""
    pages = table(spark, sf, "pages").select("page_id")
    grid = pages.select(
        "page_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("selector_no")
    ).select("page_id", "selector_no", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("match_no"))
    i, n, m = F.col("page_id"), F.col("selector_no"), F.col("match_no")
    words = {0: "Verify account", 1: "Learn more", 2: "Sign in with Google", 3: "Continue", 4: "Next"}
    links = {0: "/login", 1: "/privacy", 2: "/secure/help", 3: "/home"}
    return grid.withColumns({
        "selector": F.when(n % 2 == 0, F.concat(F.lit("button:has-text('"), n.cast("string"), F.lit("')")))
        .otherwise(F.concat(F.lit("a#"), n.cast("string"))),
        "text": cases((i + n + m) % 6, words, F.lit("")),
        "href": cases((i * 3 + n + 2 * m) % 5, links, F.lit("")),
    })


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus rows joined with verdicts as ``evaluate.corpus_rows`` would give them."""
    s = scans(spark, sf)
    i = F.col("id")
    label = F.when(i % 5 == 0, "ambiguous").when((i * 7 + F.col("risk_score")) % 100 < F.col("risk_score"), "malicious").otherwise("benign")
    return s.select(
        "id", label.alias("label"), F.lit("c").alias("category"),
        F.array_compact(F.array(
            F.when(i % 2 == 0, F.lit("credential-harvesting")), F.when(i % 3 == 0, F.lit("brand-impersonation")),
        )).alias("expected_patterns"),
        F.when(i % 4 == 0, "Suspicious").alias("expected_classification_min"),
        F.when(i % 4 == 1, "Suspicious").alias("expected_classification_max"),
        "risk_score", "classification", "confidence",
        F.array_compact(F.array(
            F.when(i % 6 == 0, F.lit("brand-impersonation")), F.when(i % 4 == 0, F.lit("credential-harvesting")),
        )).alias("p_codes"),
        F.array_compact(F.array(
            F.when(i % 2 == 0, F.struct(F.lit("mailto").alias("code"), F.lit("medium").alias("severity"), F.lit(13).alias("score_impact"))),
            F.when(i % 3 == 0, F.struct(F.lit("url-deep-path").alias("code"), F.lit("medium").alias("severity"), F.lit(9).alias("score_impact"))),
            F.when(i % 7 == 0, F.struct(F.lit("url-ip-host").alias("code"), F.lit("high").alias("severity"), F.lit(24).alias("score_impact"))),
        )).alias("e_rows"),
    )
