"""Queries of the operators on word hashes: near duplicates, licences, quality, substrings."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrisk.llm.license_scan import scan_licences
from webrisk.llm.near_dedup import near_duplicates
from webrisk.llm.quality import judge
from webrisk.llm.registry import register, table
from webrisk.llm.substrings import dedup_substrings


@register("op1_minhash_dedup")
def minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@register("op7_license_scan")
def license_scan(spark, sf_dir):
    out = scan_licences(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"))


@register("op8_quality_rules")
def quality_rules(spark, sf_dir):
    import public_tokenizers

    out = judge(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "token_entropy")


@register("op9_substring_dedup")
def substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
