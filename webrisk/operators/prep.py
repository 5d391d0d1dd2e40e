"""Dataset preparation: deduplication, sampling, splits, balancing, statistics.

A label or a source can hold half of all rows, so nothing here ranks a whole one. Quotas (`cut_by_rank`) are taken from a
histogram: the counts of fine hash buckets tell in which bucket of a group each cut falls, and only the rows of
those buckets are ranked; then every row knows its side by itself and stays where it is. Where every row needs its number,
``group_rank`` ranks inside the buckets and shifts by the running count of the buckets before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrisk.functions import urls as U
from webrisk.functions.plan import stored

HASH_BUCKET_DIGITS = 3  # 4096 buckets per group
FILE_BLOCK = 65536  # lines per bucket in load order
COARSE_BLOCKS = 4096  # buckets per coarse bucket


def sample_hash(seed: int, column: str = "url") -> Column:
    """Deterministic sampling order: md5 of seed and value."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(column)))


def hash_bucket(digest: Column) -> Column:
    """Leading digits of a digest; ordering by bucket agrees with ordering by digest."""
    return F.substring(digest, 1, HASH_BUCKET_DIGITS)


#: Spark's default of spark.sql.optimizer.windowGroupLimitThreshold.
SMALL_SAMPLE = 1000
#: Groups up to which their cuts are sent to the executors; beyond, cuts and rows are joined like any two tables.
MOST_GROUPS = 10_000


def _bucket_offsets(rows: DataFrame, keys: list[str], coarse: Column | None) -> DataFrame:
    """Per group and bucket (column _bucket): _n rows, _offset rows before it, group_size.

    Counts are running sums inside each coarse bucket plus running sums over the coarse buckets, so no
    window holds more than a few thousand small rows however many buckets a group has.
    """
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    if coarse is None:  # a few thousand buckets per group
        counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        return counts.withColumns({
            "_offset": F.coalesce(F.sum("_n").over(upto(*keys).orderBy("_bucket")), F.lit(0)),
            "group_size": F.sum("_n").over(Window.partitionBy(*keys))})
    rows = rows.withColumn("_coarse", coarse)
    counts = rows.groupBy(*keys, "_coarse", "_bucket").agg(F.count("*").alias("_n"))
    fine = counts.withColumn("_in_coarse", F.coalesce(
        F.sum("_n").over(upto(*keys, "_coarse").orderBy("_bucket")), F.lit(0)))
    tops = counts.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_n")).select(
        *keys, "_coarse",
        F.coalesce(F.sum("_n").over(upto(*keys).orderBy("_coarse")), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("group_size"))
    return fine.join(tops, [*keys, "_coarse"]).select(
        *keys, "_bucket", "_n", (F.col("_in_coarse") + F.col("_before")).alias("_offset"), "group_size")


def group_rank(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rank_in_group",
    coarse: Column | None = None,
) -> DataFrame:
    """Exact 1-based rank within ``keys`` in the order (bucket, *order); also adds ``group_size``.

    ``coarse`` must order like ``bucket`` and be constant inside it. With hash buckets the rows should be unique by the
    hashed value (deduplicate first): copies share a hash and therefore a bucket.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_inside", F.row_number().over(inside))
        .join(_bucket_offsets(rows, keys, coarse).drop("_n"), [*keys, "_bucket"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_bucket")
    )


def _small(df: DataFrame) -> tuple[DataFrame, bool]:
    """The table as a local one to broadcast, if it has at most MOST_GROUPS rows, and whether it has."""
    found = df.limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        return df, False
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return F.broadcast(df.sparkSession.createDataFrame(found, schema)), True


def cut_by_rank(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str | Column], edges: Callable[[Column], list[Column]],
    name: str = "part", coarse: Column | None = None,
) -> DataFrame:
    """Cut every group at the given ranks of the ascending order (bucket, *order): adds the number of edges that a row lies behind.

    ``edges`` gives ascending ranks from the group's size (and its keys); a null edge has all rows before it. Two small jobs
    run at once: the histogram, and the ranking of the buckets in which cuts fall, of which only the last row before each cut is kept.
    The result compares rows with those and moves none. ``df`` is read three times: store what is costly. Rows without a key value are
    dropped; the order must tell rows apart.
    """
    rows = df.withColumns({
        "_bucket": bucket,
        "_order": F.struct(*(F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)))})
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    ranks = edges(F.col("group_size"))
    at = F.col("_rank")
    cuts = _bucket_offsets(rows, keys, coarse).select(*keys, "_bucket", "_n", "_offset", F.posexplode(F.array(*ranks)).alias("_i", "_rank")).filter(
        (F.col("_offset") <= at) & (at < F.col("_offset") + F.col("_n"))).select(*keys, "_bucket", "_i", (at - F.col("_offset")).alias("_left"))
    cuts, few = _small(cuts)
    inside = rows.select(*keys, "_bucket", "_order").join(
        cuts.filter("_left > 0").select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi")
    numbered = inside.withColumn("_left", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_order")).cast("long"))
    cuts = cuts.join(numbered, [*keys, "_bucket", "_left"], "left")
    one = lambda i: F.max(F.when(F.col("_i") == i, F.struct("_bucket", "_order"))).alias(f"_cut{i}")
    cuts = cuts.groupBy(*keys).agg(*(one(i) for i in range(len(ranks))))
    cuts = _small(cuts)[0] if few else cuts
    behind = [
        F.when(F.col("_bucket") > c["_bucket"], 1).when(
            (F.col("_bucket") == c["_bucket"]) & (c["_order"].isNull() | (F.col("_order") > c["_order"])), 1).otherwise(0)
        for c in (F.col(f"_cut{i}") for i in range(len(ranks)))]
    return rows.join(cuts, keys, "left").withColumn(name, sum(behind, F.lit(0)).cast("int")).drop(
        "_bucket", "_order", *(f"_cut{i}" for i in range(len(ranks))))


def top_per_group(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str | Column], n: int, coarse: Column | None = None
) -> DataFrame:
    """First ``n`` rows of every group.

    Up to the number of rows for which Spark limits a window before its shuffle, two windows do: within buckets, then within
    groups, where a task sends at most ``n`` rows of a group. More rows are cut by rank.
    """
    if n > SMALL_SAMPLE:
        return cut_by_rank(df, keys, bucket, order, lambda size: [F.lit(n).cast("long")], "_part", coarse).filter("_part = 0").drop("_part")
    rows = df.withColumn("_bucket", bucket)
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    for by in ([*keys, "_bucket"], keys):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_bucket", *order))).filter(F.col("_n") <= n)
    return rows.drop("_n", "_bucket")


def load_buckets(file_col: str, line_col: str) -> tuple[Column, Column]:
    """Buckets and coarse buckets of the load order (file, line)."""
    part = lambda size: F.struct(F.col(file_col), F.floor(F.col(line_col) / size).alias("block"))
    return part(FILE_BLOCK), part(FILE_BLOCK * COARSE_BLOCKS)


def first_rows_per_source(
    df: DataFrame, n: int, source: str = "source_dataset", order: tuple[str, ...] = ("source_file", "line_no")
) -> DataFrame:
    """First ``n`` rows of each source in load order."""
    file_col, line_col = order
    bucket, coarse = load_buckets(file_col, line_col)
    return top_per_group(df, [source], bucket, [F.col(line_col)], n, coarse)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key. Spark limits every task to one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedupe_urls(df: DataFrame) -> DataFrame:
    """Drop rows without a usable URL, then keep the first row per URL in load order."""
    return keep_first(
        df.filter(F.col("url").isNotNull()), ["url"], [F.col("source_file"), F.col("line_no")])


def load_summary(df: DataFrame) -> DataFrame:
    """Per file: kept rows, invalid rows, duplicate rows (before the global deduplication)."""
    per_url = df.groupBy("source_dataset", "source_file", "url").agg(F.count("*").alias("n"))
    valid = F.col("url").isNotNull()
    return per_url.groupBy("source_dataset", "source_file").agg(
        F.count_if(valid).alias("rows"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("invalid_rows"),
        F.coalesce(F.sum(F.when(valid, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
    )


def dataset_quality(summary: DataFrame) -> DataFrame:
    """Totals over the file summaries."""
    return summary.agg(
        F.sum("rows").alias("total_input_rows"), F.sum("invalid_rows").alias("total_invalid"),
        F.sum("duplicate_rows").alias("total_duplicates"))


def combine_datasets(first: DataFrame, *others: DataFrame, seed: int | None = 42) -> DataFrame:
    """Union in the given order, keep the first row per url, optionally order by sampling hash."""
    merged = first.withColumn("_part", F.lit(0))
    for i, other in enumerate(others, 1):
        merged = merged.unionByName(other.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    order = [F.col("_part")] + [F.col(c) for c in ("source_file", "line_no") if c in merged.columns]
    kept = keep_first(merged, ["url"], order).drop("_part")
    return kept if seed is None else kept.orderBy(sample_hash(seed), "url")


def dedupe_domains(df: DataFrame) -> DataFrame:
    """Keep the first row per normalized domain; phishing rows come first and win."""
    df = df.withColumn("normalized_domain", U.normalize_domain(F.col("url")))
    order = [F.desc("label")] + [F.col(c) for c in ("source_dataset", "source_file", "line_no") if c in df.columns]
    return keep_first(df, ["normalized_domain"], [*order, F.col("url")])


def balanced_sample(df: DataFrame, n: int, balance: bool = True, seed: int = 42) -> DataFrame:
    """Per source: n/2 rows of each class (or n rows), in sampling order."""
    digest = sample_hash(seed)
    keys = ["source_dataset", "label"] if balance else ["source_dataset"]
    rows = df.filter(F.col("label").isin(0, 1)) if balance else df
    size = n // 2 if balance else n
    return top_per_group(rows, keys, hash_bucket(digest), [digest, F.col("url")], size)


def train_test_sample(df: DataFrame, train: int, test: int, balance: bool = True, seed: int = 42) -> DataFrame:
    """Disjoint train and test samples per source, marked in ``split``.

    Balanced: the first train/2 of each class train, the next test/2 test. Otherwise the
    rows stay in load order and are cut at the train share of the source.
    """
    if balance:
        digest = sample_hash(seed)
        k, m = train // 2, test // 2
        cut = cut_by_rank(
            df.filter(F.col("label").isin(0, 1)), ["source_dataset", "label"], hash_bucket(digest), [digest, F.col("url")],
            lambda size: [F.lit(k).cast("long"), F.lit(k + m).cast("long")], "_part")
    else:
        bucket, coarse = load_buckets("source_file", "line_no")

        def edges(size: Column) -> list[Column]:
            first = F.floor(size * F.lit(train / (train + test)))
            return [first, first + test]

        cut = cut_by_rank(df, ["source_dataset"], bucket, [F.col("line_no")], edges, "_part", coarse)
    return cut.filter("_part < 2").withColumn("split", F.when(F.col("_part") == 0, "train").otherwise("test")).drop("_part")


def stratified_split(
    df: DataFrame, ratios: tuple[float, ...] = (0.7, 0.15, 0.15),
    names: tuple[str, ...] = ("train", "validation", "test"), seed: int = 42,
) -> DataFrame:
    """Split every label by the ratios, in sampling order; adds ``split``."""
    if not math.isclose(sum(ratios), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"Split ratios must sum to 1.0, got {sum(ratios)}")
    digest = sample_hash(seed)

    def edges(size: Column) -> list[Column]:
        out, edge = [], F.lit(0).cast("long")
        for ratio in ratios[:-1]:
            edge = edge + F.floor(size * F.lit(ratio) + 0.5)
            out.append(edge)
        return out

    cut = cut_by_rank(df, ["label"], hash_bucket(digest), [digest, "url"], edges, "_part")
    return cut.withColumn("split", F.element_at(F.array(*(F.lit(n) for n in names)), F.col("_part") + 1)).drop("_part")


def balance_training(df: DataFrame, ratio: float = 0.6, seed: int = 42) -> DataFrame:
    """Cut the larger class of the train split to the target share of phishing rows, in sampling order.

    Expects the output of :func:`stratified_split` with the same seed; other splits keep their imbalance.
    """
    train = df.filter((F.col("split") == "train") & F.col("label").isin(0, 1))
    p, b = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    target_b = F.floor(p * F.lit(1 - ratio) / F.lit(ratio))
    target_p = F.floor(b * F.lit(ratio) / F.lit(1 - ratio))
    # one aggregate: label -> rows of its train split that stay
    limits = train.agg(F.create_map(
        F.lit(0), F.when(b > target_b, target_b), F.lit(1), F.when(b <= target_b, target_p))).scalar()
    limit = lambda size: [F.try_element_at(limits, F.col("label").cast("int")).cast("long")]
    digest = sample_hash(seed)
    kept = cut_by_rank(train, ["label"], hash_bucket(digest), [digest, "url"], limit, "_part").filter("_part = 0").drop("_part")
    rest = df.filter(F.coalesce(F.col("split") != "train", F.lit(True)) | ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)))
    return kept.unionByName(rest)


def split_overlap(df: DataFrame, key: str = "normalized_domain") -> DataFrame:
    """Keys that occur in more than one split."""
    return df.groupBy(key).agg(F.min("split").alias("_a"), F.max("split").alias("_b")).filter(
        "_a <> _b").select(key)


def verify_no_overlap(df: DataFrame, key: str = "normalized_domain") -> None:
    """Raise when a key occurs in more than one split."""
    n = split_overlap(df, key).count()
    if n:
        raise ValueError(f"Found {n} domains in more than one split")


def malformed_counts(df: DataFrame) -> DataFrame:
    """Number of kept and filtered rows of the well-formedness filter."""
    ok = U.is_well_formed(F.col("url"))
    return df.agg(F.count_if(ok).alias("kept_rows"), F.count_if(~ok).alias("filtered_rows"))


def dataset_statistics(df: DataFrame) -> DataFrame:
    """One row: totals, class shares, URL length moments, https share, split sizes and shares."""
    def size(split: str) -> Column:
        return F.count_if(F.col("split") == split)

    def share(split: str) -> Column:
        hits = F.count_if((F.col("split") == split) & (F.col("label") == 1))
        return F.try_divide(hits, size(split))

    total = F.count("*")
    length = F.length("url")
    return df.agg(
        total.alias("total_samples"),
        F.count_if(F.col("label") == 1).alias("phishing_count"),
        F.count_if(F.col("label") == 0).alias("benign_count"),
        F.try_divide(F.count_if(F.col("label") == 1), total).alias("phishing_share"),
        F.try_divide(F.count_if(F.col("label") == 0), total).alias("benign_share"),
        F.avg(length).alias("url_length_mean"), F.stddev_samp(length).alias("url_length_std"),
        F.min(length).cast("double").alias("url_length_min"),
        F.max(length).cast("double").alias("url_length_max"),
        F.try_divide(F.count_if(F.col("url").startswith("https://")), total).alias("https_share"),
        *[size(s).alias(f"{s}_size") for s in ("train", "validation", "test")],
        *[share(s).alias(f"{s}_phishing_share") for s in ("train", "validation", "test")],
    )


def frame_stats(df: DataFrame, source: str = "source_dataset") -> DataFrame:
    """Rows and label counts per source."""
    return df.groupBy(source).agg(
        F.count("*").alias("rows"), F.count_if(F.col("label") == 0).alias("benign_0"),
        F.count_if(F.col("label") == 1).alias("phishing_1"))


def prepare_dataset(
    phishing: DataFrame, benign: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
    train_phishing_ratio: float = 0.6, seed: int = 42,
) -> DataFrame:
    """Label, filter, deduplicate by domain, split and balance; one row per kept URL.

    Validation and test keep their natural class mix. Domains are unique after the
    deduplication, so splits cannot overlap; ``verify_no_overlap`` checks it.
    """
    labeled = phishing.withColumn("label", F.lit(1)).unionByName(
        benign.withColumn("label", F.lit(0)), allowMissingColumns=True)
    kept = stored(dedupe_domains(labeled.filter(U.is_well_formed(F.col("url")))), "prepared")
    sizes = {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()}  # two labels
    to_train, to_validation = (
        {k: sum(math.floor(n * r + 0.5) for r in ratios[:i]) for k, n in sizes.items()} for i in (1, 2))
    left = dict(to_train)
    p, b = to_train.get(1, 0), to_train.get(0, 0)
    spare = math.floor(p * (1 - train_phishing_ratio) / train_phishing_ratio)
    if b > spare:
        left[0] = spare
    else:
        left[1] = math.floor(b * train_phishing_ratio / (1 - train_phishing_ratio))
    by_label = lambda ranks: F.when(F.col("label") == 1, ranks.get(1, 0)).otherwise(ranks.get(0, 0)).cast("long")
    digest = sample_hash(seed)
    cut = cut_by_rank(kept, ["label"], hash_bucket(digest), [digest, "url"], lambda size: [by_label(r) for r in (left, to_train, to_validation)], "_part")
    names = F.array(F.lit("train"), F.lit(None).cast("string"), F.lit("validation"), F.lit("test"))
    return cut.filter("_part <> 1").withColumn("split", F.element_at(names, F.col("_part") + 1)).drop("_part")
