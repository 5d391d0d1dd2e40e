"""Queries of the operators with models and vocabularies: toxicity, token counts, pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrisk.llm.pieces import decode, encode
from webrisk.llm.registry import register, table
from webrisk.llm.token_count import count_tokens
from webrisk.llm.toxicity import fit_toxicity, score_toxicity


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


@register("op2_toxicity")
def toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op6_token_count")
def token_count(spark, sf_dir):
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@register("op3_sentencepiece")
def sentencepiece(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs, path), path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
