"""Column helpers shared by the operators: characters, words, shingles, row identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk.session import shared_root

#: White space of all operators: space and the controls from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+", -1))


def starts(items: str, width: int) -> Column:
    """The starts of all windows of this width over an array column; none when it is shorter."""
    last = F.size(items) - width
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))


def row_key(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(text)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
