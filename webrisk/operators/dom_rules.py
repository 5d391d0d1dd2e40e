"""Page evidence: structural rules over the start tags, pattern rules over the source.

Source patterns are evaluated before the parse, so the page source is read once by
the JVM and sent once to the parser, and never travels back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.functions import urls as U
from webrisk.operators import html as H
from webrisk.operators.signals import SIGNALS_DDL, explode_signals, extracted, fired


def source_flags(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``src_<rule>`` flags and the analytics flag, computed on the raw page source."""
    df = df.withColumn("_source", F.lower(F.coalesce(F.col(html), F.lit(""))))
    source = F.col("_source")
    flags = {f"src_{code}": T.matches(source, pattern) for code, pattern in K.SCRIPT_PATTERNS.items()}
    flags["has_html"] = source != ""
    flags["analytics_context"] = T.contains_any(source, K.ANALYTICS_WORDS)
    return df.withColumns(flags).drop("_source")


def brand_mentions(lowered_text: Column, hostname: Column) -> Column:
    """Brands named in the lower-cased text but not part of the host, alphabetically."""
    return F.array_compact(F.array(*[
        F.when(lowered_text.contains(b) & ~hostname.contains(b), F.lit(b)) for b in K.BRANDS
    ]))


def _credential_input(i: Column) -> Column:
    name = F.lower(H.attr(i, "name"))
    return (F.lower(H.attr(i, "type")) == "password") | T.contains_any(name, K.CREDENTIAL_INPUT_NAMES)


def _form_summary(elements: Column) -> Column:
    """Forms with their credential inputs; inputs are narrowed to those inside a form first."""
    inputs = F.transform(
        F.filter(elements, lambda e: (e["tag"] == "input") & (F.size(e["forms"]) > 0)),
        lambda i: F.struct(
            i["forms"].alias("forms"),
            _credential_input(i).alias("credential"),
            ((F.lower(H.attr(i, "type")) == "password") & H.is_hidden(i)).alias("hidden_password"),
        ),
    )

    def summarize(form: Column) -> Column:
        def count(flag: str) -> Column:
            return F.size(F.filter(
                inputs, lambda i: i[flag] & F.array_contains(i["forms"], form["seq"])
            ))

        return F.struct(
            T.strip(H.attr(form, "action")).alias("action"),
            H.is_hidden(form).alias("hidden"),
            F.lower(H.attr(form, "style")).alias("style"),
            F.lower(H.attr(form, "class")).alias("class_text"),
            count("credential").alias("credentials"),
            count("hidden_password").alias("hidden_passwords"),
        )

    return F.transform(H.tags(elements, "form"), summarize)


def with_dom_facts(df: DataFrame) -> DataFrame:
    """Counts and form summaries the DOM rules decide on."""
    elements = F.coalesce(F.col("elements"), F.array().cast(df.schema["elements"].dataType))
    df = df.withColumn("_dom_lower", F.lower(F.coalesce(F.col("dom_text"), F.lit(""))))
    df = df.withColumns({
        "_forms": _form_summary(elements),
        "_iframes": F.transform(
            H.tags(elements, "iframe"),
            lambda e: T.strip(H.attr(e, "width")).isin("0", "1")
            | T.strip(H.attr(e, "height")).isin("0", "1")
            | H.attr(e, "style").rlike(K.HIDDEN_STYLE),
        ),
        "_refresh": F.exists(
            H.tags(elements, "meta"), lambda e: F.lower(H.attr(e, "http-equiv")) == "refresh"
        ),
        "_scripts": F.transform(
            H.tags(elements, "script"),
            lambda e: (T.strip(H.attr(e, "src")) != "")
            & U.is_external(T.strip(H.attr(e, "src")), F.col("hostname")),
        ),
        "_hidden_elements": F.size(F.filter(
            elements, lambda e: ~e["tag"].isin("script", "style", "meta", "link") & H.is_hidden(e)
        )),
        "_modals": F.size(F.filter(
            elements,
            lambda e: T.contains_any(F.lower(H.attr(e, "class")), K.MODAL_WORDS)
            & F.lower(H.attr(e, "style")).contains("position:fixed")
            & F.lower(H.attr(e, "style")).contains("z-index"),
        )),
        "_brand_mentions": brand_mentions(F.col("_dom_lower"), F.col("hostname")),
    })
    credential_forms = F.filter(F.col("_forms"), lambda f: f["credentials"] > 0)
    return df.withColumns({
        "_credential_forms": credential_forms,
        "_hidden_passwords": F.aggregate(
            F.col("_forms"), F.lit(0), lambda n, f: n + f["hidden_passwords"]
        ),
    })


def with_dom_signals(df: DataFrame) -> DataFrame:
    """Add ``dom_signals``; pages without source get an empty array."""

    def rule(code, *args, value=None, details=None, context=None):
        r = K.DOM_RULES[code]
        description = F.format_string(r[5], *args) if args else r[5]
        return extracted(
            code, r[0], description, r[1], "dom", r[2], r[3], r[4],
            value=value, details=details, context=context,
        )

    host = F.col("hostname")
    forms, iframes, scripts = F.col("_credential_forms"), F.col("_iframes"), F.col("_scripts")
    hidden_forms = F.size(F.filter(forms, lambda f: f["hidden"]))
    overlays = F.size(F.filter(
        forms,
        lambda f: (f["style"].contains("position:fixed") | f["class_text"].contains("overlay"))
        & (f["credentials"] >= 2),
    ))
    hidden_frames = F.size(F.filter(iframes, lambda x: x))
    external_scripts = F.size(F.filter(scripts, lambda x: x))
    lowered_text = F.col("_dom_lower")

    def form_signal(f: Column) -> Column:
        action = f["action"]
        lowered = F.lower(action)
        return (
            F.when(
                action.isin("", "about:blank") | lowered.startswith("javascript:"),
                rule("dom-credential-form-blank-action",
                     context="Credential collection form action is empty/script-driven.",
                     details={"form_action": F.when(action == "", "(empty)").otherwise(action)}))
            .when(
                U.is_external(action, host),
                rule("dom-external-credential-post", action,
                     context="Credential form submits to unrelated origin, high-confidence harvest behavior.",
                     details={"form_action": action, "source_hostname": host}))
            .when(
                (F.col("scheme") == "https") & lowered.startswith("http://"),
                rule("dom-downgraded-form-post",
                     context="Sensitive credential flow downgraded from HTTPS page to HTTP endpoint.",
                     details={"form_action": action, "source_scheme": F.col("scheme")}))
        )

    mentions = F.col("_brand_mentions")
    rules = [
        (hidden_forms > 0, rule("dom-hidden-credential-form", value=hidden_forms)),
        (F.col("_hidden_passwords") > 0, rule("dom-hidden-password-field", value=F.col("_hidden_passwords"))),
        (overlays > 0, rule("dom-invisible-login-overlay", value=overlays)),
        (F.size(forms) >= 2, rule("dom-multiple-credential-forms", value=F.size(forms))),
        (F.size(iframes) >= 3, rule("dom-iframe-abuse", F.size(iframes), value=F.size(iframes))),
        (hidden_frames > 0, rule("dom-invisible-iframe", value=hidden_frames)),
        (F.col("_refresh"), rule("dom-meta-refresh-redirect")),
        ((external_scripts >= 5)
         & (external_scripts / F.greatest(F.size(scripts), F.lit(1)) >= 0.7),
         rule("dom-external-script-load", external_scripts, F.size(scripts))),
    ]
    rules += [(F.col(f"src_{code}"), rule(code)) for code in K.SCRIPT_PATTERNS]
    rules += [
        (F.size(mentions) > 0,
         rule("dom-brand-impersonation-cues", F.array_join(F.slice(mentions, 1, 4), ", "))),
    ]
    rules += [
        (T.matches(lowered_text, pattern), rule(code)) for code, pattern in K.PAGE_TEXT_PATTERNS.items()
    ]
    rules += [
        (F.col("_modals") > 0, rule("dom-fake-modal-injection", value=F.col("_modals"))),
        (F.col("_hidden_elements") >= 12,
         rule("dom-excessive-hidden-elements", value=F.col("_hidden_elements"))),
    ]
    per_form = F.array_compact(F.transform(forms, form_signal)).cast(SIGNALS_DDL)
    found = F.concat(per_form, fired(rules))
    return df.withColumn(
        "dom_signals", F.when(F.col("has_html"), found).otherwise(F.array().cast(SIGNALS_DDL))
    ).drop(
        "_dom_lower", "_forms", "_iframes", "_refresh", "_scripts", "_hidden_elements", "_modals",
        "_brand_mentions", "_credential_forms", "_hidden_passwords", "has_html",
        *[f"src_{code}" for code in K.SCRIPT_PATTERNS],
    )


def dom_evidence(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """Long table of page evidence, one row per fired rule (and per offending form)."""
    df = source_flags(pages.select(*keys, url, html), html)
    df = H.parse_pages(df, html)
    df = df.withColumn("normalized_url", U.with_scheme(F.coalesce(F.col(url), F.lit(""))))
    df = U.split_url(df, "normalized_url")
    return explode_signals(with_dom_signals(with_dom_facts(df)), keys, ["dom"])
