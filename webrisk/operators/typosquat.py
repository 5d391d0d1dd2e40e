"""Labels that imitate a brand, for brand tables of any size.

A brand is met by its deletion neighbourhood: two words are one edit apart only if they become equal when at most one sign is
left out of each. So brands and labels are expanded to these words, joined on equality, and the pairs that meet are checked with
`levenshtein`. Brands inside a label meet the same way, by the label's substrings. The plan has the same two joins for ten
brands or a million, and only distinct labels are expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest label of a host name.
LABEL = 63


def _without_one(word: Column) -> Column:
    """The word and all words with one of its signs left out."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cut))


def _substrings(word: Column, shortest: Column, longest: Column) -> Column:
    n = F.length(word)
    last = F.least(n, longest)
    sizes = F.when(last >= shortest, F.sequence(shortest, F.greatest(last, shortest)))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(word, i, k)))))


def with_imitated_brand(df: DataFrame, label: str, brands: DataFrame, exempt: list[str] | tuple[str, ...] = (), out: str = "imitated_brand") -> DataFrame:
    """Add the brand that a label imitates, else null. `brands` has a column `brand`.

    Of all brands that a label equals, contains or is one edit away from, the alphabetically first decides: if it is the label
    itself, nothing is imitated. Labels are compared in lower case; null, empty and exempt labels imitate nothing. Brands longer
    than 63 signs, null and empty ones are ignored.
    """
    known = brands.select(F.lower("brand").alias("brand")).where((F.length("brand") > 0) & (F.length("brand") <= LABEL)).distinct()
    sizes = known.agg(F.min(F.length("brand")).alias("low"), F.max(F.length("brand")).alias("high"))
    bare = F.lower(F.col(label))
    labels = df.select(bare.alias("label")).where(F.length("label") > 0)
    labels = (labels.where(~F.col("label").isin(*exempt)) if exempt else labels).distinct()
    low, high = (F.coalesce(sizes.select(c).scalar(), F.lit(LABEL + 1)) for c in ("low", "high"))
    # `inside`: the word is a piece of the label and must be a brand itself; otherwise the brand may have lost a sign too
    tagged = lambda words, inside: F.transform(words, lambda w: F.struct(F.lit(inside).alias("inside"), w.alias("word")).cast(
        "struct<inside:boolean,word:string>"))
    labels = labels.withColumns({"low": low, "high": high})
    pieces = F.coalesce(_substrings(F.col("label"), F.col("low"), F.col("high")), F.array().cast("array<string>"))
    asked = labels.select("label", F.explode(F.concat(tagged(pieces, True), tagged(_without_one(F.col("label")), False))).alias("p")).select("label", "p.*")
    index = known.select("brand", F.explode(_without_one(F.col("brand"))).alias("word"))
    met = asked.join(index, "word").where(F.when(F.col("inside"), F.col("word") == F.col("brand")).otherwise(
        F.levenshtein("label", "brand", 1) == 1))
    first = met.groupBy("label").agg(F.min("brand").alias("_first"))
    found = first.where(F.col("_first") != F.col("label")).select(F.col("label").alias("_label"), F.col("_first").alias(out))
    return df.join(found, bare == F.col("_label"), "left").drop("_label")

