"""URL parsing and normalisation as column expressions.

``parse_url`` is not used: it raises or returns NULL on URLs that the feature
definitions accept (``_`` or ``|`` in places, bare domains), keeps host case, and
has no notion of path parameters. One RFC 3986 regular expression cuts the URL
into pieces in a single pass; everything else is cheap string work on the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions.text import let, non_empty_parts, strip
from webrisk.sources.suffixes import SuffixRules, suffix_rules

_SEP = "\u0001"
_RFC3986 = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_HEX_GROUPS = r"[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*"


def clean_url(raw: Column) -> Column:
    """Drop leading control characters and blanks, and all tabs and line breaks."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[\x00-\x20]+|[\t\r\n]", "")


def has_http_prefix(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def with_scheme(raw: Column) -> Column:
    """Prefix ``https://`` unless the text already starts with http(s)://."""
    return F.when(has_http_prefix(raw), raw).otherwise(F.concat(F.lit("https://"), raw))


def _pieces(url: Column) -> Column:
    text = clean_url(url)
    cut = F.regexp_replace(text, _RFC3986, f"$1{_SEP}$2{_SEP}$3{_SEP}$4{_SEP}$5")
    return F.split(cut, _SEP)


def _host_and_port(netloc: Column) -> tuple[Column, Column]:
    info = F.regexp_extract(netloc, r"([^@]*)$", 1)
    bracketed = info.contains("[")
    host = F.when(bracketed, F.regexp_extract(info, r"\[([^\]]*)", 1)).otherwise(
        F.regexp_extract(info, r"^([^:]*)", 1)
    )
    port = F.when(bracketed, F.regexp_extract(info, r"\][^:]*:(.*)$", 1)).otherwise(
        F.regexp_extract(info, r"^[^:]*:(.*)$", 1)
    )
    return host, port


def split_url(df: DataFrame, url: str = "url", prefix: str = "") -> DataFrame:
    """Add scheme, netloc, hostname, port, path, query, fragment and two flags.

    ``hostname`` is lower-cased and without port, brackets and credentials. ``port``
    is NULL when absent. ``bad_port`` marks a port that is not a number up to 65535,
    ``bad_netloc`` unbalanced brackets. Missing pieces are empty strings.
    """
    p = prefix
    df = df.withColumn(f"{p}_pieces", _pieces(F.col(url)))
    pieces = F.col(f"{p}_pieces")
    path = F.regexp_replace(pieces[2], r"(?s)^((?:.*/)?[^/;]*);[^/]*$", "$1")
    df = df.withColumns({
        f"{p}scheme": F.lower(pieces[0]),
        f"{p}netloc": pieces[1],
        f"{p}path": path,
        f"{p}query": pieces[3],
        f"{p}fragment": pieces[4],
    })
    netloc = F.col(f"{p}netloc")
    host, port = _host_and_port(netloc)
    df = df.withColumns({
        f"{p}hostname": F.lower(host),
        f"{p}_port_text": port,
        f"{p}bad_netloc": netloc.contains("[") != netloc.contains("]"),
    })
    text = F.col(f"{p}_port_text")
    number = F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))
    df = df.withColumns({
        f"{p}port": F.when(number <= 65535, number),
        f"{p}bad_port": (text != "") & ~F.coalesce(number <= 65535, F.lit(False)),
    })
    return df.drop(f"{p}_pieces", f"{p}_port_text")


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(clean_url(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean_url(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_path(url: Column) -> Column:
    raw = F.regexp_extract(
        clean_url(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )
    return F.regexp_replace(raw, r"(?s)^((?:.*/)?[^/;]*);[^/]*$", "$1")


def url_host(url: Column) -> Column:
    """Lower-cased host name of a URL, '' when there is none."""
    return let(url_netloc(url), lambda n: F.lower(_host_and_port(n)[0]))


def normalize_url(raw: Column) -> Column:
    """Trim, prefix https:// when needed; NULL for blanks and URLs without a host part."""
    text = strip(F.coalesce(raw, F.lit("")))
    full = with_scheme(text)
    return F.when((text != "") & (url_netloc(full) != ""), full)


def normalize_url_strict(raw: Column) -> Column:
    """Like :func:`normalize_url`, but only http and https survive."""
    full = normalize_url(raw)
    return F.when(url_scheme(full).isin("http", "https"), full)


def extract_domain(url: Column) -> Column:
    """Lower-cased authority cut at its first colon; credentials are kept."""
    netloc = F.lower(url_netloc(url))
    return F.when(netloc != "", F.regexp_extract(netloc, r"^([^:]*)", 1))


def normalize_domain(url: Column) -> Column:
    """Deduplication key: authority (or first path part), no port, lower, no leading www."""
    first_path = F.regexp_extract(url_path(url), r"^([^/]*)", 1)
    authority = F.when(url_netloc(url) != "", url_netloc(url)).otherwise(first_path)
    bare = F.lower(F.regexp_extract(authority, r"^([^:]*)", 1))
    return F.regexp_replace(bare, r"^www\.", "")


def is_well_formed(url: Column) -> Column:
    """Has a scheme, has an authority or path, and an authority for http(s)."""
    scheme, netloc, path = url_scheme(url), url_netloc(url), url_path(url)
    return (
        (scheme != "")
        & ((netloc != "") | (path != ""))
        & ~(scheme.isin("http", "https") & (netloc == ""))
        & (netloc.contains("[") == netloc.contains("]"))
    )


def is_ip_host(host: Column) -> Column:
    """Valid IPv4 (octet range, no leading zeros) or IPv6 text form."""
    v6 = F.regexp_replace(host, r"(?<=:)" + _IPV4[1:], "0:0")
    groups = F.size(F.filter(F.split(v6, ":"), lambda g: g != ""))
    full = v6.rlike(rf"^{_HEX_GROUPS}$") & (groups == 8)
    short = v6.rlike(rf"^(?:{_HEX_GROUPS})?::(?:{_HEX_GROUPS})?$") & (groups <= 7)
    return host.rlike(_IPV4) | (host.contains(":") & (full | short))


def looks_like_ipv4(host: Column) -> Column:
    """Four dot-separated numbers, no range check."""
    return host.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$")


def is_external(target: Column, hostname: Column) -> Column:
    """Target points to a host that is neither this host nor a parent or child of it."""
    here = F.lower(hostname)

    def body(there: Column) -> Column:
        related = (
            (there == here)
            | there.endswith(F.concat(F.lit("."), here))
            | here.endswith(F.concat(F.lit("."), there))
        )
        return (there != "") & (here != "") & ~related

    return let(url_host(target), body)


def is_suspicious_redirect(before: Column, after: Column) -> Column:
    """Navigation that left the host (identity providers excepted) or moved to a sensitive path."""
    host_before, host_after = url_host(before), url_host(after)
    identity = F.lit(False)
    for token in K.REDIRECT_IDENTITY_HOSTS:
        identity = identity | host_after.contains(token)
    same_host = F.lower(url_path(after)).rlike(K.REDIRECT_PATH_WORDS) & (url_path(before) != url_path(after))
    return (
        F.when(before == after, False)
        .when((host_before == "") | (host_after == ""), True)
        .when(host_before != host_after, ~identity)
        .otherwise(same_host)
    )


def suffix_source_host(url: Column) -> Column:
    """Host text used for the suffix split: case kept, credentials, port and final dots dropped."""
    rest = F.regexp_replace(clean_url(url), r"^(?:[A-Za-z0-9+.\-]+:)?//", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    info = F.regexp_extract(authority, r"([^@]*)$", 1)
    host = F.when(info.startswith("["), F.regexp_extract(info, r"\[([^\]]*)", 1)).otherwise(
        F.regexp_extract(info, r"^([^:]*)", 1)
    )
    return F.regexp_replace(host, r"^\s+|\.+$|\s+$", "")


def split_domain(df: DataFrame, host: str, prefix: str = "", rules: SuffixRules | None = None) -> DataFrame:
    """Add subdomain, domain, suffix and base_domain (domain plus suffix) of a host column.

    The ending of a host is looked up with one, two and more labels in the rule tables, which are a few thousand rows and go to
    every executor, so rows stay where they are. The longest rule wins, a wildcard takes one label more, an exception one
    less. Hosts without a rule and addresses have the suffix ''.
    """
    p, rules = prefix, rules or suffix_rules(df.sparkSession)
    h = F.col(host)
    df = df.withColumns({f"{p}_ip": is_ip_host(h), f"{p}_labels": F.split(F.lower(h), r"\.")})
    labels, n = F.col(f"{p}_labels"), F.size(f"{p}_labels")
    found = []
    for k, level in enumerate(rules.levels, 1):
        key, hit = f"{p}_key{k}", f"{p}_hit{k}"
        taken = F.when(F.col("exception"), k - 1).when(F.col("wild"), k + 1).otherwise(k)
        table = level.select(F.col("suffix").alias(key), F.struct(taken.alias("wide"), "exact", "exception").alias(hit))
        ending = F.when((n >= k) & ~F.col(f"{p}_ip"), F.array_join(F.slice(labels, F.greatest(n - (k - 1), F.lit(1)), k), "."))
        df = df.withColumn(key, ending).join(F.broadcast(table), key, "left")
        found.append((k, F.col(hit)))
    exception = F.coalesce(*(F.when(hit["exception"], k - 1) for k, hit in reversed(found)))
    # a wildcard needs a label to take; without one its own rule counts, if there is one
    widths = [F.when(hit["wide"] <= n, hit["wide"]).when(hit["exact"], k) for k, hit in found]
    width = F.coalesce(exception, F.greatest(*widths, F.lit(0), F.lit(0)))
    df = df.withColumn(f"{p}_width", width).withColumn(
        f"{p}suffix", F.when(F.col(f"{p}_width") > 0, F.array_join(F.slice(F.split(h, r"\."), F.greatest(n - F.col(f"{p}_width") + 1, F.lit(1)), n), ".")).otherwise(""))
    df = df.drop(f"{p}_labels", f"{p}_width", *(f"{p}_{x}{k}" for k, _ in found for x in ("key", "hit")))
    suffix = F.col(f"{p}suffix")
    rest = F.when(suffix == "", h).otherwise(
        F.expr(f"substring(`{host}`, 1, greatest(length(`{host}`) - length(`{p}suffix`) - 1, 0))")
    )
    df = df.withColumn(f"{p}_rest", rest)
    rest = F.col(f"{p}_rest")
    df = df.withColumns({
        f"{p}domain": F.when(F.col(f"{p}_ip"), rest).otherwise(F.regexp_extract(rest, r"([^.]*)$", 1)),
        f"{p}subdomain": F.when(F.col(f"{p}_ip"), F.lit("")).otherwise(
            F.regexp_replace(rest, r"\.?[^.]*$", "")
        ),
    })
    base = F.concat_ws(
        ".",
        F.when(F.col(f"{p}domain") != "", F.col(f"{p}domain")),
        F.when(suffix != "", suffix),
    )
    return df.withColumn(f"{p}base_domain", base).drop(f"{p}_rest", f"{p}_ip")


def subdomain_depth(subdomain: Column) -> Column:
    """Subdomain levels without www."""
    return F.size(F.filter(non_empty_parts(subdomain, r"\."), lambda p: F.lower(p) != "www"))


def typosquat_brand(domain: Column) -> Column:
    """Brand a registered label imitates, else NULL.

    Brands are tried alphabetically: an equal label ends the search, containing the
    brand or being one edit away is a hit.
    """
    label = F.lower(domain)
    verdict = None
    for brand in K.BRANDS:
        near = (F.levenshtein(label, F.lit(brand), 1) == 1)
        hit = label.contains(brand) | near
        if verdict is None:
            verdict = F.when(label == brand, F.lit("")).when(hit, F.lit(brand))
        else:
            verdict = verdict.when(label == brand, F.lit("")).when(hit, F.lit(brand))
    verdict = verdict.otherwise(F.lit(""))
    return F.when(
        (label != "") & ~label.isin(K.LEGIT_BRAND_TOKENS), F.nullif(verdict, F.lit(""))
    )
