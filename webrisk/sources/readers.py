"""Readers for URL feeds, labelled CSVs, ranked domains and page corpora.

Feeds have no row numbers; ``line_no`` is the position of a row in its file and gives
the load order that keep-first and first-n operators rely on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webrisk import catalogs as K
from webrisk.functions import text as T
from webrisk.functions import urls as U

STANDARD_COLUMNS = ["url", "domain", "label", "label_text", "source_dataset", "raw_value"]
CORPUS_DDL = (
    "id string, label string, category string, url string, text string, html string, "
    "expected_patterns array<string>, expected_classification_min string, "
    "expected_classification_max string"
)


#: Files up to which their headers are sent to the executors.
MOST_FILES = 10_000


def infer_label(file_name: Column) -> Column:
    """Label from the file name; phishing hints win, everything else is benign."""
    return F.when(T.contains_any(F.lower(file_name), K.PHISH_NAME_HINTS), 1).otherwise(0)


def file_name(path: Column) -> Column:
    return F.try_url_decode(F.regexp_extract(path, r"([^/]*)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def scan_position() -> Column:
    """Position of a row in its file: block start plus the row number inside the task.

    A task reads a block in order and a block holds fewer rows than bytes, so positions
    grow along the file even when it is split over many tasks.
    """
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def _lines(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """source_file, line_no, value of every line below the paths.

    Without an explicit encoding, a line that is not valid UTF-8 is read as Latin-1.
    """
    reader = spark.read.option("ignoreCorruptFiles", True)
    reader = reader.option("encoding", encoding) if encoding else reader
    value = F.col("value")
    if not encoding:
        value = F.when(F.is_valid_utf8(value), value).otherwise(
            F.decode(value.cast("binary"), "ISO-8859-1"))
    return reader.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("source_file"), scan_position().alias("line_no"),
        value.alias("value"))


def standard_records(raw: DataFrame, value: str = "raw_value") -> DataFrame:
    """Standard URL records from (source_file, line_no, raw_value); bad values keep a NULL url."""
    url = U.normalize_url(F.col(value))
    label = infer_label(file_name(F.col("source_file")))
    return raw.select(
        url.alias("url"), U.extract_domain(url).alias("domain"), label.alias("label"),
        F.when(label == 1, "malicious").otherwise("benign").alias("label_text"),
        file_stem(F.col("source_file")).alias("source_dataset"), F.col(value).alias("raw_value"),
        "source_file", "line_no",
    )


def read_url_lines(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """Headerless text: one URL or domain per line, blank lines dropped."""
    lines = _lines(spark, path, encoding).withColumn("raw_value", T.strip(F.col("value")))
    return standard_records(lines.filter("raw_value <> ''"))


def read_phish_feed(spark: SparkSession, url_feed=None, domain_feed=None) -> DataFrame:
    """Phishing URLs of a full-URL feed, then of a domain feed with http:// added."""
    parts = []
    if url_feed:
        parts.append(_lines(spark, url_feed).withColumn("url", T.strip(F.col("value"))))
    if domain_feed:
        value = T.strip(F.col("value"))
        parts.append(_lines(spark, domain_feed).withColumn(
            "url",
            F.when(value == "", value).when(U.has_http_prefix(value), value)
            .otherwise(F.concat(F.lit("http://"), value))))
    if not parts:
        raise ValueError("Give a URL feed or a domain feed")
    rows = [
        p.filter("url <> ''").select(
            "url", F.lit(1).alias("label"),
            F.concat(F.lit(f"{i}-"), file_stem(F.col("source_file"))).alias("source_dataset"),
            "source_file", "line_no")
        for i, p in enumerate(parts)
    ]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def read_ranked_domains(spark: SparkSession, path) -> DataFrame:
    """Headerless rank,domain list of benign sites; https:// is added."""
    df = spark.read.schema("rank long, domain string").csv(path)
    return df.select(
        F.concat(F.lit("https://"), F.col("domain")).alias("url"), F.lit(0).alias("label"),
        F.lit("ranked-domains").alias("source_dataset"),
        F.col("_metadata.file_path").alias("source_file"), F.col("rank").alias("line_no"))


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate that exists, ignoring case."""
    existing = {c.lower(): c for c in columns}
    for name in candidates:
        if name.lower() in existing:
            return existing[name.lower()]
    return None


def _csv(spark: SparkSession, path) -> DataFrame:
    """CSV with header, every value as text; a semicolon or tab header is recognised."""
    first = spark.read.text(path).limit(1).first()
    header = first[0] if first else ""
    sep = max([",", ";", "\t", "|"], key=header.count) if header and "," not in header else ","
    return spark.read.option("header", True).option("sep", sep).csv(path).withColumns({
        "source_file": F.col("_metadata.file_path"),
        "line_no": scan_position(),
    })


def _is_numeric_column(df: DataFrame, column: str) -> bool:
    """All non-NULL values of the column are numbers."""
    row = df.agg(
        F.count(column).alias("n"), F.count_if(F.col(f"`{column}`").try_cast("double").isNotNull()).alias("ok")
    ).first()
    return row.n == row.ok


def read_url_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a URL or domain column found by name, or by position.

    Without a known name: a numeric first column means the second holds domains,
    otherwise the first holds URLs.
    """
    df = _csv(spark, path)
    data = [c for c in df.columns if c not in ("source_file", "line_no")]
    column = pick_column(data, K.URL_COLUMN_NAMES) or pick_column(data, K.DOMAIN_COLUMN_NAMES)
    if column is None:
        column = data[1] if len(data) >= 2 and _is_numeric_column(df, data[0]) else data[0]
    value = F.coalesce(F.col(f"`{column}`"), F.lit("nan"))
    return standard_records(df.select("source_file", "line_no", value.alias("raw_value")))


def _csv_headers(lines: DataFrame) -> DataFrame:
    """Per file: position of its header line, separator, lower-case column names, and the place of the URL or domain column, if named."""
    first = lines.groupBy("source_file").agg(F.min("line_no").alias("header_at"), F.min_by("value", "line_no").alias("header"))
    counts = F.transform(T.string_array([",", ";", "\t", "|"]), lambda c: F.struct(
        F.when((c == ",") & F.col("header").contains(","), 1 << 30).otherwise(F.length("header") - F.length(F.replace("header", c))).alias("n"), c.alias("c")))
    best = F.element_at(F.filter(counts, lambda x: x["n"] == F.array_max(F.transform(counts, lambda y: y["n"]))), 1)["c"]
    first = first.withColumn("sep", best)
    cells = F.split(F.col("header"), F.concat(F.lit("["), F.col("sep"), F.lit("]")))
    first = first.withColumn("names", F.transform(cells, lambda c: F.lower(F.btrim(c, F.lit('" \r\ufeff')))))
    named = F.coalesce(*(F.nullif(F.array_position("names", n.lower()), F.lit(0)) for n in (*K.URL_COLUMN_NAMES, *K.DOMAIN_COLUMN_NAMES)))
    return first.select("source_file", "header_at", "sep", F.size("names").alias("width"), named.alias("named"))


def read_url_csvs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Any number of CSV files with any headers as standard records, by the rules of `read_url_csv`, in one plan.

    One scan finds every file's header, separator and URL column; in the other, a line is parsed with its file's separator
    and gives the cell its file asks for. Files that cannot be read give no rows (see `unread_files`).
    """
    raw = spark.read.option("ignoreCorruptFiles", True).text(list(paths)).select(
        F.col("_metadata.file_path").alias("source_file"), scan_position().alias("line_no"), "value").filter(F.trim("value") != "")
    headers = _csv_headers(raw)
    near = F.broadcast if len(paths) <= MOST_FILES else lambda df: df
    width = headers.agg(F.max("width")).first()[0] or 1
    fields = ", ".join(f"c{i} string" for i in range(width))
    rows = raw.join(near(headers), "source_file").filter(F.col("line_no") > F.col("header_at"))
    cells = None
    for sep in (",", ";", "\t", "|"):
        parsed = F.from_csv("value", fields, {"sep": sep})
        cells = F.when(F.col("sep") == sep, parsed) if cells is None else cells.when(F.col("sep") == sep, parsed)
    rows = rows.withColumn("cells", cells).withColumn("cells", F.array(*(F.col(f"cells.c{i}") for i in range(width))))
    first = F.get("cells", F.lit(0))
    numeric = rows.filter("named is null").groupBy("source_file").agg(
        (F.count_if(first.isNotNull()) == F.count_if(first.try_cast("double").isNotNull())).alias("numeric"))
    rows = rows.join(near(numeric), "source_file", "left")
    place = F.coalesce("named", F.when(F.col("numeric") & (F.col("width") >= 2), 2).otherwise(1).cast("long"))
    value = F.coalesce(F.get("cells", (place - 1).cast("int")), F.lit("nan"))
    return standard_records(rows.select("source_file", "line_no", value.alias("raw_value")))


def read_labeled_csv(
    spark: SparkSession, path: str, label: int, source: str, candidates: Sequence[str]
) -> DataFrame:
    """CSV standardised to url, label, source with explicit candidate columns."""
    df = _csv(spark, path)
    column = pick_column(df.columns, candidates)
    if column is None:
        raise ValueError(f"Unable to locate a URL column in source '{source}'. Columns: {df.columns}")
    value = F.coalesce(F.col(f"`{column}`"), F.lit("nan"))
    return df.select(
        U.normalize_url_strict(value).alias("url"), F.lit(int(label)).alias("label"),
        F.lit(source).alias("source"), F.lit(source).alias("source_dataset"), "source_file", "line_no")


def read_preset(spark: SparkSession, path: str, preset: str) -> DataFrame:
    """One of the presets phishtank, openphish, benign."""
    label, candidates = K.LABELED_CSV_PRESETS[preset]
    return read_labeled_csv(spark, path, label, preset, candidates)


def read_corpus(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """JSON array of labelled pages; missing texts are empty, a missing list is an empty array.

    A JSON array is read by one task per file. Large corpora should be stored as JSON lines
    and read with ``multi_line=False``, which Spark splits.
    """
    df = spark.read.schema(CORPUS_DDL).option("multiLine", multi_line).json(path)
    return df.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in ("url", "text", "html")},
        "expected_patterns": F.coalesce("expected_patterns", F.array().cast("array<string>")),
    })


def read_json_urls(spark: SparkSession, path, multi_line: bool = True, keep_invalid: bool = False) -> DataFrame:
    """Page corpus as standard URL records; unknown labels become -1.

    Records without a usable URL, broken ones among them, are dropped or kept with a NULL url.
    """
    df = spark.read.schema(CORPUS_DDL).option("multiLine", multi_line).option("ignoreCorruptFiles", True).json(path).select(
        "*", F.col("_metadata.file_path").alias("source_file"),
        scan_position().alias("line_no"))
    url = U.normalize_url(F.col("url"))
    text = F.coalesce("label", F.lit("unknown"))
    return df.select(
        url.alias("url"), U.extract_domain(url).alias("domain"),
        F.when(text == "malicious", 1).when(text == "benign", 0).otherwise(-1).alias("label"),
        text.alias("label_text"), file_stem(F.col("source_file")).alias("source_dataset"),
        F.coalesce("url", F.lit("")).alias("raw_value"), "source_file", "line_no",
    ).filter(F.lit(keep_invalid) | F.col("url").isNotNull())


def list_dataset_files(spark: SparkSession, root: str) -> list[str]:
    """txt, csv and json files below a folder, sorted; result and report folders are skipped.

    Only names are listed (driver metadata), no content is read.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    skip = r"/(results|reports|__pycache__)/"
    rows = names.filter(  # file names only, metadata of the scan
        F.lower("path").rlike(r"\.(txt|csv|json)$") & ~F.col("path").rlike(skip)
    ).collect()
    return sorted(r[0] for r in rows)


def _array_files(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those of the JSON files whose first sign is a bracket."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(paths).filter(F.trim("value") != "").select(
        "value", F.col("_metadata.file_path").alias("f"), scan_position().alias("at"))
    first = lines.groupBy("f").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), "at").alias("sign"))
    return {r.f for r in first.filter("sign = '['").collect()}  # names of files, as the scan itself has them


def load_all(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All dataset files below a folder: merged records (first row per url wins), and the per-file summary.

    The plan has one branch per form (lists, CSV, JSON arrays, JSON lines), however many files there are. Records that cannot
    be read are counted as invalid rows of their file; a file that cannot be read at all is missing in the summary, and
    `unread_files` names it.
    """
    from webrisk.operators.prep import dedupe_urls, load_summary

    files = list_dataset_files(spark, root)
    of = lambda ending: [f for f in files if f.lower().endswith(ending)]
    parts = []
    if of(".txt"):
        parts.append(read_url_lines(spark, of(".txt")))
    if of(".csv"):
        parts.append(read_url_csvs(spark, of(".csv")))
    if of(".json"):
        arrays = _array_files(spark, of(".json"))
        for whole in (True, False):
            chosen = [f for f in of(".json") if (f in arrays) == whole]
            if chosen:
                parts.append(read_json_urls(spark, chosen, whole, keep_invalid=True))
    if not parts:
        raise ValueError(f"No datasets loaded from {root}")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return dedupe_urls(merged), load_summary(merged)


def unread_files(spark: SparkSession, root: str, summary: DataFrame) -> DataFrame:
    """source_file of every dataset file below the folder that gave no row: empty or unreadable."""
    listed = spark.createDataFrame([(f,) for f in list_dataset_files(spark, root)], "source_file string")
    return listed.join(summary, "source_file", "left_anti")
