"""SQL fragments shared by the oracles (DuckDB dialect)."""

from __future__ import annotations

from checks.inputs import PHRASES, SNIPPETS
from webrisk import catalogs as K


def lst(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def case(expr: str, table: dict, default: str) -> str:
    body = " ".join(f"when {k!r} then {v}" if isinstance(k, str) else f"when {k} then {v}" for k, v in table.items())
    return f"case {expr} {body} else {default} end"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def hits(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {text(pattern)}))"


def half_even(x: str, digits: int) -> str:
    """Round half even on the exact binary value."""
    s = f"{10 ** digits}.0"
    hi = f"(floor(abs({x}) * 1048576.0) / 1048576.0)"
    q = f"floor({hi} * {s})"
    rest = f"(({hi} * {s} - {q} - 0.5) + (abs({x}) - {hi}) * {s})"
    return (f"(sign({x}) * ({q} + case when {rest} > 0 or ({rest} = 0 and ({q})::bigint % 2 = 1) "
            f"then 1.0 else 0.0 end) / {s})")


def rint(x: str) -> str:
    return f"round_even({x}, 0)::bigint"


H = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PLANTED_URLS = f"""
pu as (
  select page_id, case page_id % 14
    when 1 then 'http://10.0.' || (page_id % 200) || '.7/x'
    when 2 then 'https://user@' || {H} || '/'
    when 3 then 'https://bit.ly/x' || page_id
    when 4 then 'https://a.b.c.shop.example.com/'
    when 5 then 'https://a.b.c.d.e.shop.example.com/'
    when 6 then 'https://q7x9zk2vj4wm8p1t5r.example.com/'
    when 7 then 'https://store' || page_id || '.xyz/'
    when 8 then 'https://xn--pypl-53dc.example.com/'
    when 9 then 'https://paypa1.com/'
    when 10 then 'https://' || {H} || '/?redirect=1&token=2'
    when 11 then 'https://' || {H} || '/' || repeat('%41', 14)
    when 12 then 'https://' || {H} || '/a/b/c/d/e/f'
    when 13 then 'https://' || {H} || ':8080/'
    else url end as url
  from pages)"""
PIECES = """
p0 as (
  select *, regexp_extract(url, '^([a-z]+)://', 1) as scheme,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as netloc,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path,
    regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) as query,
    regexp_extract(url, '#(.*)$', 1) as fragment
  from pu),
p1 as (
  select *, regexp_extract(netloc, '([^@]*)$', 1) as info from p0),
p2 as (
  select *, lower(regexp_extract(info, '^([^:]*)', 1)) as host,
    try_cast(nullif(regexp_extract(info, ':([0-9]+)$', 1), '') as integer) as port
  from p1),
p3 as (
  select *, regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') as ip,
    string_split(host, '.') as labels from p2),
u as (
  select *, case when ip then '' else labels[-1] end as suffix,
    case when ip then host else labels[-2] end as domain,
    case when ip then '' else array_to_string(labels[1:len(labels) - 2], '.') end as subdomain,
    case when ip then 0 else len(labels) - 2 end as sub_n
  from p3)"""
URLS = f"with {PLANTED_URLS}, {PIECES}"


def entropy(x: str) -> str:
    return f"coalesce(list_aggregate(string_split({x}, ''), 'entropy'), 0.0)"


def chars_in(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, {text(chars)}, '')))"


def _snippet_sql() -> str:
    parts = []
    for k, v in SNIPPETS.items():
        value = f"{text(v[0])} || {H} || {text(v[1])}" if isinstance(v, tuple) else text(v)
        parts.append(f"when {k} then {value}")
    return "case page_id % 16 " + " ".join(parts) + " else '' end"


PLANTED_PAGES = f"""
pp as (
  select page_id, url, {H} as host,
    replace(html, '<body>', '<body>' || {_snippet_sql()}) as html
  from pages)"""
_PHRASE = "case doc_id % 8 " + " ".join(f"when {k} then {text(v)}" for k, v in PHRASES.items()) + " else '' end"
PLANTED_TEXTS = f"pt as (select doc_id, text || ' ' || {_PHRASE} as text from documents)"
SCANS = """
sc as (
  select *, case when risk_score < 25 then 'Safe' when risk_score < 50 then 'Suspicious'
    when risk_score < 75 then 'Dangerous' else 'Critical' end as classification
  from (
    select event_id as id, user_id,
      'https://site' || (user_id % 97) || '.example.com/' || event_id as url,
      case event_type when 'click' then 'url' when 'view' then 'page' else 'other' end as scan_type,
      least(100, floor(value))::int as risk_score,
      round(least(0.99, value / 500 + 0.15), 2) as confidence,
      'scan of a ' || event_type || ' event' as explanation, ts as created_at
    from events))"""
RECORDS = f"""{SCANS}, rec as (
  select id, url,
    case when id % 31 = 0 then -1 when (id * 7 + risk_score) % 100 < risk_score then 1 else 0 end as true_label,
    case when id % 29 = 0 then null else risk_score end as risk_score,
    case when id % 29 = 0 then 'error' when id % 37 = 0 then 'timeout_exceeded' else 'ok' end as status,
    id % 37 = 0 as timeout_exceeded, (id % 64)::double / 64 as duration_seconds,
    list_filter([case when id % 2 = 0 then 'credential-harvesting' end,
      case when id % 3 = 0 then 'redirect-based-phishing' end,
      case when id % 5 = 0 then 'brand-impersonation' end], lambda x: x is not null) as attack_patterns
  from sc), val as (select * from rec where true_label in (0, 1) and risk_score is not null)"""
LABELED = """
lu as (
  select case when event_id % 41 = 0 then null else
      case when event_id % 4 = 0 then 'http://' else 'https://' end || 'host' || user_id || '-' ||
      (event_id % 53) || '.example.com/' || (event_id % 7) end as url,
    (user_id % 3 = 0)::int as label, 'feed' || (user_id % 3) as source_dataset,
    '/data/feed' || (user_id % 3) || '.txt' as source_file, event_id as line_no
  from events)"""
PROBS = """
pr as (
  select event_id as id, ((event_id * 31 % 1000) < (event_id * 7919 % 1000))::int as label,
    (event_id * 7919 % 1000)::double / 1000 as p,
    ((event_id * 7919 % 1000)::double / 1000 >= 0.5)::int as predicted
  from events)"""
TOTALS = """
    sum(case when y = 1 and h then n else 0 end)::bigint as tp,
    sum(case when y = 0 and h then n else 0 end)::bigint as fp,
    sum(case when y = 0 and not h then n else 0 end)::bigint as tn,
    sum(case when y = 1 and not h then n else 0 end)::bigint as fn"""


def ratio(a: str, b: str) -> str:
    return f"(case when {b} > 0 then ({a})::double / ({b}) else 0.0 end)"


def rate_columns(wrap) -> str:
    parts = {
        "accuracy": ratio("tp + tn", "tp + fp + tn + fn"), "precision": ratio("tp", "tp + fp"),
        "recall": ratio("tp", "tp + fn"), "f1_score": ratio("2 * tp", "2 * tp + fp + fn"),
        "false_positive_rate": ratio("fp", "fp + tn"), "false_negative_rate": ratio("fn", "fn + tp"),
    }
    return ", ".join(f"{wrap(v)} as {k}" for k, v in parts.items())


__all__ = [n for n in dir() if not n.startswith("_")] + ["K"]
