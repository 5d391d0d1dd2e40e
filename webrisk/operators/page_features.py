"""Thirty ternary URL+page features, their issues, and the URL score built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.functions import urls as U
from webrisk.operators import html as H
from webrisk.operators.text_rules import ISSUES_DDL


def model_source_flags(df: DataFrame, html: str = "html") -> DataFrame:
    """Pattern features of the raw page source; evaluated before the parse."""
    source = F.coalesce(F.col(html), F.lit(""))
    p = K.FEATURES30_PAGE_PATTERNS
    host = U.url_host(U.with_scheme(F.coalesce(F.col("url"), F.lit(""))))
    df = df.withColumn("_lower_source", F.lower(source))
    return df.withColumns({
        "pg_present": source != "",
        "pg_info_email": source.rlike(p["info_email"]),
        "pg_status_bar": F.when(source.contains("onmouseover"), source.rlike(p["status_bar"])).otherwise(False),
        "pg_right_click": F.when(
            source.contains("event") | source.contains("contextmenu"), source.rlike(p["right_click"])
        ).otherwise(False),
        "pg_popup": source.contains(p["popup"]),
        "pg_iframe": source.rlike(p["iframe"]),
        "pg_anchor_links": T.count_text(F.col("_lower_source"), p["anchor_links"]),
        "pg_names_host": F.col("_lower_source").contains(host),
    }).drop("_lower_source")


def without_page(df: DataFrame) -> DataFrame:
    """Page flags of a URL that was scored without fetching its page."""
    return df.withColumns({
        "pg_present": F.lit(False), "pg_info_email": F.lit(False), "pg_status_bar": F.lit(False),
        "pg_right_click": F.lit(False), "pg_popup": F.lit(False), "pg_iframe": F.lit(False),
        "pg_anchor_links": F.lit(0), "pg_names_host": F.lit(False),
    })


def domain_age_months(created: Column, expires: Column, today: Column) -> Column:
    """Months from creation to expiry, or to today without an expiry; NULL if unknown."""
    end = F.coalesce(expires, today)
    return (F.year(end) - F.year(created)) * 12 + F.month(end) - F.month(created)


def _share(flags: Column) -> tuple[Column, Column]:
    return F.size(F.filter(flags, lambda x: x)) * 100.0, F.size(flags)


def _banded(flags: Column, empty: int, low: float, high: float) -> Column:
    """1 below ``low`` percent, 0 below ``high``, else -1; ``empty`` without items."""
    part, total = _share(flags)
    percent = part / F.greatest(total, F.lit(1))
    return F.when(total == 0, empty).when(percent < low, 1).when(percent < high, 0).otherwise(-1)


def with_page_features(
    df: DataFrame,
    created: str | None = None,
    expires: str | None = None,
    today: Column | None = None,
    elements: str = "elements",
) -> DataFrame:
    """Add one ``f_<name>`` column per feature, ``url_issues``, ``privacy_score`` and
    ``confidence_hint``.

    Expects the columns of ``url_rules.with_url_context``, the ``pg_*`` flags,
    ``elements`` and ``redirect_chain``. Registration dates are optional columns.
    """
    url, host, scheme = F.col("normalized_url"), F.col("hostname"), F.col("scheme")
    page = F.col("pg_present")
    tags = F.coalesce(F.col(elements), F.array().cast(df.schema[elements].dataType))
    chain = F.size("redirect_chain")

    def own(link: Column) -> Column:
        return link.contains(url) | link.contains(host) | (T.count_of(link, ".") == 1)

    def links(names: tuple[str, ...], attribute: str, test) -> Column:
        found = F.filter(tags, lambda e: e["tag"].isin(*names) & H.has_attr(e, attribute))
        return F.transform(found, lambda e: test(H.attr(e, attribute)))

    def unsafe(href: Column) -> Column:
        low = F.lower(href)
        return (
            href.contains("#") | low.contains("javascript") | low.contains("mailto")
            | ~(href.contains(url) | href.contains(host))
        )

    if created is None:
        age = F.lit(None).cast("int")
        has_whois = F.lit(False)
    else:
        day = F.current_date() if today is None else today
        until = F.col(expires) if expires else F.lit(None).cast("date")
        age = domain_age_months(F.col(created), until, day)
        has_whois = F.col(created).isNotNull()

    df = df.withColumns({
        "_fav": links(("link",), "href", own),
        "_req": links(("img", "audio", "embed", "iframe"), "src", own),
        "_anchors": links(("a",), "href", unsafe),
        "_srcs": links(("script",), "src", own),
        "_actions": F.transform(
            F.filter(tags, lambda e: (e["tag"] == "form") & H.has_attr(e, "action")),
            lambda e: H.attr(e, "action"),
        ),
        "_age": age,
        "_numeric_host": F.replace(host, F.lit("."), F.lit("")).rlike(r"^\p{Nd}+$"),
    })
    form_verdict = F.array_compact(F.transform(
        "_actions",
        lambda a: F.when(a.isin("", "about:blank"), -1).when(~a.contains(url) & ~a.contains(host), 0),
    ))
    months = F.col("_age")
    old_enough = F.when(F.coalesce(months >= 6, F.lit(False)), 1).otherwise(-1)

    def sign(bad: Column) -> Column:
        return F.when(bad, -1).otherwise(1)

    def sign_good(good: Column) -> Column:
        return F.when(good, 1).otherwise(-1)

    def on_page(value: Column) -> Column:
        return F.when(page, value).otherwise(0)

    last_slashes = F.length(url) - F.instr(F.reverse(url), "//") - 1
    depth = F.col("_model_depth")
    df = df.withColumn(
        "_model_depth",
        F.size(F.filter(T.non_empty_parts(F.col("subdomain"), r"\."), lambda p: p != "www")),
    )
    risky_tld = F.lit(False)
    for tld in K.FEATURES30_TLDS:
        risky_tld = risky_tld | host.endswith(f".{tld}")
    values = {
        "using_ip": sign(F.col("is_ip")),
        "long_url": F.when(F.length(url) < 54, 1).when(F.length(url) <= 75, 0).otherwise(-1),
        "short_url": sign(url.rlike(K.FEATURES30_SHORTENERS)),
        "symbol": sign(url.contains("@")),
        "redirecting": sign(url.contains("//") & (last_slashes > 6)),
        "prefix_suffix": sign(host.contains("-")),
        "sub_domains": F.when(depth <= 1, 1).when(depth == 2, 0).otherwise(-1),
        "https": sign_good(scheme == "https"),
        "domain_reg_len": sign_good(F.coalesce(months >= 12, F.lit(False))),
        "favicon": on_page(sign_good(F.exists("_fav", lambda x: x))),
        "non_std_port": sign(F.coalesce(F.col("port") > 0, F.lit(False))),
        "https_domain_url": sign(host.contains("https")),
        "request_url": on_page(_banded(F.col("_req"), 1, 22.0, 61.0)),
        "anchor_url": on_page(_banded(F.col("_anchors"), -1, 31.0, 67.0)),
        "links_in_script_tags": on_page(_banded(F.concat("_fav", "_srcs"), -1, 17.0, 81.0)),
        "server_form_handler": on_page(F.coalesce(F.try_element_at(form_verdict, F.lit(1)), F.lit(1))),
        "info_email": sign(F.col("pg_info_email")),
        "abnormal_url": sign_good(page & (host != "") & has_whois & F.col("pg_names_host")),
        "website_forwarding": F.when(chain <= 1, 1).when(chain <= 4, 0).otherwise(-1),
        "status_bar_cust": sign_good(F.col("pg_status_bar")),
        "disable_right_click": sign_good(F.col("pg_right_click")),
        "using_popup_window": sign_good(F.col("pg_popup")),
        "iframe_redirection": sign_good(F.col("pg_iframe")),
        "age_of_domain": old_enough,
        "dns_recording": old_enough,
        "website_traffic": F.when(host == "", -1).otherwise(0),
        "page_rank": F.when(host == "", -1).otherwise(0),
        "google_index": F.when(F.col("base_domain") == "", -1).otherwise(0),
        "links_pointing_to_page": F.when(F.col("pg_anchor_links") == 0, 1)
        .when(F.col("pg_anchor_links") <= 2, 0).otherwise(-1),
        "stats_report": sign((host == "") | F.col("_numeric_host") | risky_tld),
    }
    df = df.withColumns({f"f_{name}": values[name].cast("int") for name in K.FEATURES30})

    def f(name: str) -> Column:
        return F.col(f"f_{name}")

    raised = {
        "using_ip": f("using_ip") == -1,
        "short_url": f("short_url") == -1,
        "symbol": f("symbol") == -1,
        "redirecting": f("redirecting") == -1,
        "prefix_suffix": f("prefix_suffix") == -1,
        "sub_domains": f("sub_domains") == -1,
        "https": f("https") == -1,
        "domain_reg_len": F.coalesce(months < 12, F.lit(False)),
        "non_std_port": f("non_std_port") == -1,
        "info_email": f("info_email") == -1,
        "website_forwarding": f("website_forwarding") != 1,
        "stats_report": f("stats_report") == -1,
    }
    hint = (
        F.lit(0.35) + F.when(raised["using_ip"], 0.1).otherwise(0.0)
        + F.when(raised["short_url"], 0.08).otherwise(0.0)
        + F.when(raised["symbol"], 0.08).otherwise(0.0)
    )
    df = df.withColumns({
        "url_issues": issue_array([(cond, K.URL_MODEL_ISSUES[name]) for name, cond in raised.items()]),
        "privacy_score": F.least(F.lit(100), F.lit(10) + F.when(raised["https"], 18).otherwise(0)),
        "confidence_hint": F.least(F.lit(0.95), hint),
    })
    return df.drop(
        "_fav", "_req", "_anchors", "_srcs", "_actions", "_age", "_model_depth"
    )


def issue_array(rows: list[tuple[Column, tuple[str, str, str, str]]]) -> Column:
    """Array of the issues whose condition holds."""
    return F.array_compact(F.array(*[
        F.when(cond, F.struct(
            F.lit(code).alias("code"), F.lit(title).alias("title"),
            F.lit(description).alias("description"), F.lit(severity).alias("severity")))
        for cond, (code, title, description, severity) in rows
    ])).cast(ISSUES_DDL)


def with_url_score(df: DataFrame, probability: str | None = None) -> DataFrame:
    """Add url_score, url_confidence, model_loaded; extend url_issues and privacy_score.

    ``probability`` names a column with a trained model's phishing probability. Rows
    where it is NULL (or without the column) fall back to the share of risky features.
    """
    risky = sum((F.when(F.col(f"f_{n}") == -1, 1).otherwise(0) for n in K.FEATURES30), F.lit(0))
    heuristic = F.least(F.lit(0.95), F.lit(0.25) + risky * 0.02)
    if probability is None:
        df = df.withColumns({"model_loaded": F.lit(False), "url_probability": heuristic})
    else:
        given = F.col(probability)
        df = df.withColumns({
            "model_loaded": given.isNotNull(),
            "url_probability": F.coalesce(T.clamp(given, 0.0, 1.0), heuristic),
        })
    url, host = F.col("normalized_url"), F.col("hostname")
    raised = {
        "long": (F.length(url) > 75, 12),
        "at": (url.contains("@"), 20),
        "hyphens": (T.count_of(host, "-") >= 3, 12),
        "non_https": (F.col("scheme") != "https", 10),
        "numeric": (F.col("_numeric_host"), 18),
    }
    bonus = sum((F.when(c, p).otherwise(0) for c, p in raised.values()), F.lit(0))
    p = F.col("url_probability")
    df = df.withColumns({
        "_url_bonus": bonus,
        "url_issues": F.concat(
            F.col("url_issues"),
            issue_array([(raised[n][0], K.URL_SCORE_ISSUES[n]) for n in raised]),
        ),
        "privacy_score": F.least(
            F.lit(100), F.col("privacy_score") + F.when(raised["non_https"][0], 18).otherwise(0)
        ),
        "url_confidence": T.py_round(
            F.least(F.lit(0.99), F.greatest(p, F.col("confidence_hint"))), 2
        ),
    })
    return df.withColumn(
        "url_score",
        F.least(
            F.lit(100),
            T.round_int(T.round_int(p * 100) * 0.75 + F.col("_url_bonus") * 0.25),
        ),
    ).drop("_url_bonus", "_numeric_host")


def page_features_30(
    pages: DataFrame,
    keys: list[str],
    url: str = "url",
    html: str = "html",
    created: str | None = None,
    expires: str | None = None,
    today: Column | None = None,
    probability: str | None = None,
) -> DataFrame:
    """One row per page: the 30 features, issues, privacy score, hint, and URL score."""
    from webrisk.operators.url_rules import with_url_context

    extra = [c for c in (created, expires, probability) if c]
    df = pages.select(*keys, F.col(url).alias("url"), html, *extra)
    if "redirect_chain" in pages.columns:
        df = pages.select(*keys, F.col(url).alias("url"), html, "redirect_chain", *extra)
    else:
        df = df.withColumn("redirect_chain", F.array().cast("array<string>"))
    df = H.parse_pages(model_source_flags(df, html), html)
    df = with_url_score(
        with_page_features(with_url_context(df), created, expires, today), probability
    )
    return df.select(
        *keys, *[f"f_{n}" for n in K.FEATURES30], "url_issues", "privacy_score", "confidence_hint",
        "url_probability", "model_loaded", "url_score", "url_confidence",
    )
