"""Queries of the operators on corpus statistics, vectors and personal data: phrases, whitening, PII."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrisk.llm.phrases import collocations
from webrisk.llm.pii import KINDS, find_pii
from webrisk.llm.registry import register, table
from webrisk.llm.whitening import whiten

PHRASE_SQL = """
with t as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
p as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from t),
f1 as (select lang, x as g, count(*) as f from (select lang, unnest(w) as x from p) group by all),
n as (select lang, sum(f)::bigint as n from f1 group by lang),
s as (select lang, w, unnest(range(1, len(w))) as i from p),
f2 as (select lang, w[i] as w1, w[i + 1] as w2, count(*) as f from s group by all having count(*) >= 10),
f3 as (select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3, count(*) as f from s where i + 2 <= len(w) group by all having count(*) >= 10),
up as (
  select lang, w1, w2, max(f) as most from (
    select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all),
c2 as (
  select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.f as a, a1.f as l, a2.f as r,
    (1000000::hugeint * f2.f * f2.f) // (a1.f::hugeint * a2.f) as score
  from f2 join f1 a1 on a1.lang = f2.lang and a1.g = f2.w1 join f1 a2 on a2.lang = f2.lang and a2.g = f2.w2
  left join up on up.lang = f2.lang and up.w1 = f2.w1 and up.w2 = f2.w2
  where up.most is null or 100 * up.most < 50 * f2.f),
c3 as (
  select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 as phrase, f3.f as a, a1.f as l1, b2.f as r1, b1.f as l2, a3.f as r2,
    (1000000::hugeint * f3.f * f3.f) // (a1.f::hugeint * b2.f) as s1, (1000000::hugeint * f3.f * f3.f) // (b1.f::hugeint * a3.f) as s2
  from f3 join f1 a1 on a1.lang = f3.lang and a1.g = f3.w1 join f1 a3 on a3.lang = f3.lang and a3.g = f3.w3
  join f2 b1 on b1.lang = f3.lang and b1.w1 = f3.w1 and b1.w2 = f3.w2
  join f2 b2 on b2.lang = f3.lang and b2.w1 = f3.w2 and b2.w2 = f3.w3),
c as (
  select lang, phrase, a, l, r, score from c2 union all
  select lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) from c3),
k as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from c)
select k.lang, rank, phrase, a, l, r, n, score::bigint as score from k join n on n.lang = k.lang where rank <= 2000
"""


@register("op11_phrase_mining", PHRASE_SQL)
def phrase_mining(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@register("op12_embedding_whitening")
def embedding_whitening(spark, sf_dir):
    out = whiten(table(spark, sf_dir, "embeddings"), k=8)
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "part")
    return out.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", parts).select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"), "identity_error")


@register("op13_pii")
def pii(spark, sf_dir):
    out = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "doc_id", *(count(kind) for kind, k in KINDS.items() if k.base), F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))
