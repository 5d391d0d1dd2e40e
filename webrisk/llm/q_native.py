"""Queries of the operators that use DataFrame functions only: chats, lines, decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrisk.llm.chat_format import ChatTemplate, format_chats, read_chats
from webrisk.llm.decontaminate import contamination
from webrisk.llm.line_dedup import drop_repeated_lines
from webrisk.llm.registry import register, table

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ESCAPED = "replace(replace(replace(text, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e')"
CHAT_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o as (select *, row_number() over w - 1 as i, lag(role, 1, 'start') over w as state
  from t window w as (partition by conv_id order by turn, role, text)),
v as (
  select conv_id, coalesce(min(i) filter (state || '>' || role not in
      ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')), -1)::int as bad_turn, arg_max(role, i) as last_role
  from o group by conv_id)
select conv_id, any_value(bad_turn) as bad_turn, any_value(bad_turn < 0 and last_role in ('user', 'assistant')) as valid, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('### ' || role || ': ' || {ESCAPED} || '</turn>') + 1)::bigint as formatted_chars
from t join v using (conv_id) group by conv_id
"""
LINE_SQL = f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (
  select r, doc_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as pos from docs),
k as (
  select *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (
  select key, max(doc_id) as owner from k where length(key) >= 40
  group by key having count(distinct doc_id) >= 5),
j as (select k.*, f.key is not null and k.doc_id <> f.owner as gone from k left join f on k.key = f.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by r, doc_id
"""
WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LEAK_SQL = f"""
with i as (select item_id, {WORDS} as w from benchmark where item_id is not null),
ig as (
  select distinct item_id, k, array_to_string(w[s:s + k - 1], ' ') as g
  from (select item_id, w, least(len(w), 5) as k, unnest(range(1, len(w) - least(len(w), 5) + 2)) as s from i where len(w) > 0)),
n as (select item_id, k, count(*) as n from ig group by all),
d as (select doc_id, {WORDS} as w from documents),
dg as (
  select distinct doc_id, k, array_to_string(w[s:s + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, (select distinct k from ig) where len(w) >= k)),
m as (
  select doc_id, item_id from dg join ig using (k, g) join n using (item_id, k)
  group by doc_id, item_id, n.n having count(*) * 5 >= n.n * 4)
select d.doc_id, count(m.item_id)::bigint as n_items,
  coalesce(string_agg(m.item_id::varchar, ',' order by m.item_id), '') as item_ids, count(m.item_id) = 0 as kept
from d left join m on d.doc_id = m.doc_id group by d.doc_id
"""


@register("op4_chat_format", CHAT_SQL)
def chat_format(spark, sf_dir):
    t = ChatTemplate()
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = read_chats(format_chats(turns, t), t)
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
    return back.select("conv_id", "formatted", "valid", "bad_turn", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss")).select(
        "conv_id", "valid", "bad_turn", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


@register("op5_line_dedup", LINE_SQL)
def line_dedup(spark, sf_dir):
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op10_decontaminate", LEAK_SQL)
def decontaminate(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("item_ids"), "kept")
