"""The thirty page features over pages built from page_id, so that every value of every feature occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import register
from webrisk import catalogs as K
from webrisk.operators.page_features import page_features_30

#: page_id % 8 -> (scheme, host, rest of the URL)
URLS = {
    0: ("https", "site.example.com", "/p"), 1: ("http", "10.1.2.7", "/"), 2: ("https", "a.b.c.site.example.com", ":8080/"),
    3: ("https", "a.b.example.com", "/" + "q" * 40), 4: ("https", "shop.xyz", "/" + "q" * 70),
    5: ("https", "https-login.example.com", "/a//b"), 6: ("https", "bit.ly", "/x"), 7: ("https", "www.example.org", "/user@x"),
}
#: page_id % 5 -> (created, expires); today is 2020-12-31
DATES = {0: (None, None), 1: ("2020-01-01", "2020-04-01"), 2: ("2020-01-01", "2020-09-01"), 3: ("2020-01-01", "2022-01-01"), 4: ("2020-01-01", None)}
CHAINS = {0: 1, 1: 3, 2: 6}  # page_id % 3 -> hops
IMAGES = {0: (0, 0), 1: (2, 0), 2: (1, 2), 3: (0, 3)}  # page_id % 4 -> own, foreign
ANCHORS = {0: (0, 0), 1: (2, 0), 2: (1, 1), 3: (0, 2), 4: (3, 1)}  # page_id % 5 -> safe, unsafe
FORMS = {0: None, 1: "", 2: "https://collect.other.test/x", 3: "own"}  # page_id % 4 -> action


def _pick(table, modulus, of):
    out = None
    for k, v in table.items():
        value = of(v)
        value = value if hasattr(value, "alias") else F.lit(value)
        condition = F.col("page_id") % modulus == k
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def built_pages(spark, sf):
    """page_id, url, html, redirect_chain, created, expires; every eleventh page was not fetched."""
    host = F.col("host")
    own, foreign = F.concat(F.lit('"https://'), host, F.lit('/i.png"')), F.lit('"https://cdn.other.test/i.png"')
    tag = lambda name, attribute, value: F.concat(F.lit(f"<{name} {attribute}="), value, F.lit(">"))
    many = lambda n, piece: F.repeat(piece, n) if n else F.lit("")
    safe = F.concat(F.lit('"'), F.col("url"), F.lit('"'))
    html = F.concat(
        F.lit("<html><head>"), F.when(F.col("page_id") % 2 == 0, tag("link", "href", own)).otherwise(tag("link", "href", foreign)),
        F.when(F.col("page_id") % 6 == 0, F.lit("<script>x onmouseover y</script>")).otherwise(F.lit("")), F.lit("</head><body>"),
        _pick(IMAGES, 4, lambda v: F.concat(many(v[0], tag("img", "src", own)), many(v[1], tag("img", "src", foreign)))),
        _pick(ANCHORS, 5, lambda v: F.concat(many(v[0], tag("a", "href", safe)), many(v[1], F.lit('<a href="#">')))),
        _pick(FORMS, 4, lambda v: F.lit("") if v is None else F.concat(F.lit("<form action="), safe if v == "own" else F.lit(f'"{v}"'), F.lit("></form>"))),
        F.when(F.col("page_id") % 7 == 0, F.lit("<p>contextmenu</p>")).otherwise(F.lit("")),
        F.when(F.col("page_id") % 9 == 0, F.lit("<p>alert(1)</p>")).otherwise(F.lit("")), F.lit("</body></html>"))
    pages = I.table(spark, sf, "pages").select("page_id", _pick(URLS, 8, lambda v: v[1]).alias("host"),
                                               _pick(URLS, 8, lambda v: f"{v[0]}://{v[1]}{v[2]}").alias("url"))
    return pages.select(
        "page_id", "url", F.when(F.col("page_id") % 11 != 0, html).alias("html"),
        _pick(CHAINS, 3, lambda n: F.array_repeat(F.lit("https://hop.example.com/"), n)).alias("redirect_chain"),
        _pick(DATES, 5, lambda v: F.lit(v[0]).cast("date")).alias("created"), _pick(DATES, 5, lambda v: F.lit(v[1]).cast("date")).alias("expires"))


def _by(modulus, values):
    return f"case page_id % {modulus} " + " ".join(f"when {k} then {v}" for k, v in values.items()) + " end"


def _page(value):
    return f"case when page_id % 11 = 0 then 0 else {value} end"


ADDRESS = {k: f"{a}://{b}{c}" for k, (a, b, c) in URLS.items()}
MONTHS = {0: None, 1: 3, 2: 8, 3: 24, 4: 11}
SIX, TWELVE = ({k: 1 if m and m >= least else -1 for k, m in MONTHS.items()} for least in (6, 12))
NAMED = "(page_id % 2 = 0 or page_id % 4 in (1, 2, 3) or page_id % 5 in (1, 2, 4))"  # a page that names its own host
LINKED = {k: a + b for k, (a, b) in ANCHORS.items()}
FEATURES = {
    "using_ip": _by(8, {k: -1 if k == 1 else 1 for k in URLS}),
    "long_url": _by(8, {k: 1 if len(u) < 54 else 0 if len(u) <= 75 else -1 for k, u in ADDRESS.items()}),
    "short_url": _by(8, {k: -1 if k == 6 else 1 for k in URLS}),
    "symbol": _by(8, {k: -1 if k == 7 else 1 for k in URLS}),
    "redirecting": _by(8, {k: -1 if k == 5 else 1 for k in URLS}),
    "prefix_suffix": _by(8, {k: -1 if k == 5 else 1 for k in URLS}),
    "sub_domains": _by(8, {0: 1, 1: 1, 2: -1, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}),
    "https": _by(8, {k: -1 if k == 1 else 1 for k in URLS}),
    "domain_reg_len": _by(5, TWELVE), "age_of_domain": _by(5, SIX), "dns_recording": _by(5, SIX),
    "favicon": _page("case when page_id % 2 = 0 then 1 else -1 end"),
    "non_std_port": _by(8, {k: -1 if k == 2 else 1 for k in URLS}),
    "https_domain_url": _by(8, {k: -1 if k == 5 else 1 for k in URLS}),
    # shares of own images, unsafe anchors and own heads, in the bands of each feature
    "request_url": _page(_by(4, {0: 1, 1: -1, 2: 0, 3: 1})),
    "anchor_url": _page(_by(5, {0: -1, 1: 1, 2: 0, 3: -1, 4: 1})),
    "links_in_script_tags": _page("case when page_id % 2 = 0 then -1 else 1 end"),
    "server_form_handler": _page(_by(4, {0: 1, 1: -1, 2: 0, 3: 1})),
    "info_email": "case when page_id % 11 = 0 then 1 else -1 end",
    "abnormal_url": f"case when page_id % 11 <> 0 and page_id % 5 <> 0 and {NAMED} then 1 else -1 end",
    "website_forwarding": _by(3, {0: 1, 1: 0, 2: -1}),
    "status_bar_cust": "case when page_id % 11 <> 0 and page_id % 6 = 0 then 1 else -1 end",
    "disable_right_click": "case when page_id % 11 <> 0 and page_id % 7 = 0 then 1 else -1 end",
    "using_popup_window": "case when page_id % 11 <> 0 and page_id % 9 = 0 then 1 else -1 end",
    "iframe_redirection": "case when page_id % 11 = 0 then -1 else 1 end",
    "website_traffic": "0", "page_rank": "0",
    "google_index": "0",
    "links_pointing_to_page": f"case when page_id % 11 = 0 then 1 else {_by(5, {k: 1 if n == 0 else 0 if n <= 2 else -1 for k, n in LINKED.items()})} end",
    "stats_report": _by(8, {k: -1 if k in (1, 4) else 1 for k in URLS}),
}


@register("page_features_30_built", "select page_id, " + ", ".join(f"{FEATURES[n]} as f_{n}" for n in K.FEATURES30) + " from pages")
def features30_built(spark, sf):
    out = page_features_30(built_pages(spark, sf), ["page_id"], created="created", expires="expires", today=F.lit("2020-12-31").cast("date"))
    return out.select("page_id", *[f"f_{n}" for n in K.FEATURES30])
