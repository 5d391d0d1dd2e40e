"""A training-data pipeline over `documents`; each stage applies one operator of webrisk.llm.

Each stage works on what its predecessor kept, and all but the last return the columns of their input. Rows without
doc_id pass the stages that compare documents. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrisk.llm import columns as C
from webrisk.llm.decontaminate import find_leaks
from webrisk.llm.line_dedup import drop_repeated_lines
from webrisk.llm.near_dedup import near_duplicates
from webrisk.llm.pieces import encode
from webrisk.llm.toxicity import fit_toxicity, score_toxicity

#: Similarity of word shingles from which documents count as copies, in percent.
SIMILARITY = 80
VOCABULARY = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 and more go."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, "_toxicity").where(F.col("_toxicity") < 0.5).drop("_toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated over documents go; text and n_chars follow. All documents stay."""
    out = drop_repeated_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"source_row.`{c}`")).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicate texts those of the smallest doc_id stay. Rows are judged by their own text."""
    gone = near_duplicates(docs, percent=SIMILARITY, by_text=True).where(~F.col("kept")).select("doc_id", F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", C.row_key(C.whole_text())).join(gone, ["doc_id", "_row"], "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", C.row_key(C.whole_text())).join(leaks, ["doc_id", "_row"], "left_anti").select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every kept text."""
    import public_tokenizers

    encoded = encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic), ("line dedup", drop_lines), ("near dedup", drop_copies),
    ("decontamination", drop_leaks), ("sentencepiece", encode_pieces),
]
#: Scores, sketches and encodings have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
