"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Texts become sets of five-word shingles (A-Z lower-cased); an item with fewer words is one shingle of
all its words, looked for in windows of that length. Items are partitioned by the size of their set. A document
that holds a share c of an item's n shingles misses at most n - ceil(c n) of them, so of any
n - ceil(c n) + 1 shingles it holds one. Each item therefore keeps that many of its smallest hash values, the number
being that of the partition's largest size. Document shingles are joined with the kept values, at any document
length; what meets is verified by exact containment of the shingle strings.

Only DataFrame functions. Defined results: null or empty texts and items without an id match nothing; repeated items
count once; rows that repeat a doc_id are judged by their own text; empty tables give empty or all-clean
results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk.llm import columns as C

WIDTH = 5
#: A table of kept hash values up to this many rows (24 bytes each) is sent to all executors; above, the join shuffles.
SENT_VALUES = 200_000


def _worded(df: DataFrame, key: list[Column]) -> DataFrame:
    return df.select(*key, C.words(C.lower_ascii(C.whole_text())).alias("words"))


def _hashed(width: int) -> Column:
    return F.transform(C.starts("hashes", width), lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + j) for j in range(width)]))


def _strings(width: int) -> Column:
    return F.array_distinct(F.transform(
        C.starts("words", width), lambda i: F.concat_ws(" ", *[F.get(F.col("words"), i + j) for j in range(width)])))


def item_sketches(items: DataFrame, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Per item: item_id, width, shingles (strings), n, partition (power of two above n), and the values it keeps."""
    num, den = share
    sized = (_worded(items.where(F.col("item_id").isNotNull()), [F.col("item_id").cast("long").alias("item_id")])
             .where(F.size("words") > 0).distinct()
             .withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
             .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))))
    by_width = [F.when(F.col("width") == k, F.struct(_strings(k).alias("shingles"), F.array_distinct(_hashed(k)).alias("values")))
                for k in range(1, WIDTH + 1)]
    sized = sized.select("item_id", "width", F.coalesce(*by_width).alias("s")).select(
        "item_id", "width", "s.shingles", "s.values", F.size("s.shingles").alias("n"))
    top = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")))).cast("int")
    misses = top - F.ceil(top * num / den).cast("int")
    return sized.withColumn("partition", top).withColumn("kept", F.slice(F.array_sort("values"), F.lit(1), misses + 1)).drop("values")


def find_leaks(docs: DataFrame, items: DataFrame, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, row, item_id, n_found, n_item): documents that hold at least the share of an item's shingles."""
    num, den = share
    sketches = C.stored(item_sketches(items, share), "items")
    kept = sketches.select("item_id", "width", F.explode("kept").alias("h"))
    facts = kept.agg(F.count("*"), F.collect_set("width")).first()
    if facts[0] <= SENT_VALUES:
        kept = F.broadcast(kept)
    text = C.whole_text()
    key = [F.col("doc_id").cast("long").alias("doc_id"), C.row_key(text).alias("row")]
    hashed = _worded(docs.where(F.col("doc_id").isNotNull()), key).withColumn(
        "hashes", F.transform("words", lambda w: F.xxhash64(w)))
    met = None
    for width in sorted(facts[1]):
        found = (hashed.select("doc_id", "row", F.explode(_hashed(width)).alias("h"))
                 .join(kept.where(F.col("width") == width), "h").select("doc_id", "row", "item_id"))
        met = found if met is None else met.unionByName(found)
    if met is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, row long, item_id long, n_found long, n_item long")
    candidates = met.distinct().groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    # texts are joined, not their words: a text is smaller
    texts = docs.where(F.col("doc_id").isNotNull()).select(*key, text.alias("text")).join(candidates, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    words = _worded(texts, [F.col("doc_id"), F.col("row"), F.col("items")])
    all_widths = F.array_distinct(F.concat(*[_strings(k) for k in sorted(facts[1])]))
    pairs = words.select("doc_id", "row", all_widths.alias("held"), F.explode("items").alias("item_id")).join(
        sketches.select("item_id", "shingles", "n"), "item_id")
    counted = pairs.select("doc_id", "row", "item_id", F.size(F.array_intersect("shingles", "held")).cast("long").alias("n_found"),
                           F.col("n").cast("long").alias("n_item"))
    return counted.where(F.col("n_found") * den >= F.col("n_item") * num).distinct()


def contamination(docs: DataFrame, items: DataFrame, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Per row of docs: doc_id, row, items found (sorted), kept (no item found)."""
    leaks = find_leaks(docs, items, share).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.row_key(C.whole_text()).alias("row"))
    return rows.join(leaks, ["doc_id", "row"], "left").select(
        "doc_id", "row", F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.col("items").isNull().alias("kept"))
