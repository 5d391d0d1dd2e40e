"""The evidence record and helpers to build arrays of it.

A page carries its evidence as five arrays of this struct (url, dom, content,
reputation, model). The arrays are bounded by the page itself, so building,
adjusting and fusing evidence are narrow jobs without any shuffle.
``explode_signals`` turns them into the long evidence table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk.functions import text as T
from webrisk.functions.plan import explode_rows

SIGNAL_DDL = (
    "struct<code:string,title:string,description:string,severity:string,source:string,"
    "category:string,score_impact:int,confidence:double,reliability:double,"
    "reasoning_context:string,escalation_contribution:int,source_module:string,"
    "analyst_details:map<string,string>,value:string>"
)
SIGNALS_DDL = f"array<{SIGNAL_DDL}>"
BUCKETS = ["url", "dom", "content", "reputation", "model"]
EXTRACTED_RELIABILITY = 0.74


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def signal(
    code, title, description, severity, source, category, impact, confidence, reliability,
    context=None, contribution=None, module=None, details: dict | None = None, value=None,
) -> Column:
    """One evidence struct; plain Python values become literals."""
    if details:
        pairs: list[Column] = []
        for key, item in details.items():
            pairs += [F.lit(key), _col(item).cast("string")]
        detail_map = F.create_map(*pairs)
    else:
        detail_map = F.lit(None)
    fields = [
        _col(code).alias("code"),
        _col(title).alias("title"),
        _col(description).alias("description"),
        _col(severity).alias("severity"),
        _col(source).alias("source"),
        _col(category).alias("category"),
        _col(impact).cast("int").alias("score_impact"),
        _col(confidence).cast("double").alias("confidence"),
        _col(reliability).cast("double").alias("reliability"),
        _col(context).cast("string").alias("reasoning_context"),
        _col(impact if contribution is None else contribution).cast("int").alias("escalation_contribution"),
        _col(module).cast("string").alias("source_module"),
        detail_map.cast("map<string,string>").alias("analyst_details"),
        _col(value).cast("string").alias("value"),
    ]
    return F.struct(*fields).cast(SIGNAL_DDL)


def extracted(code, title, description, severity, source, category, impact, confidence, **more) -> Column:
    """Evidence found by the extractor rules: impact in 1..35, confidence at most .99."""
    impact = T.clamp(_col(impact), 1, 35) if isinstance(impact, Column) else max(1, min(35, impact))
    if isinstance(confidence, Column):
        confidence = T.clamp(confidence, 0.0, 0.99)
    return signal(
        code, title, description, severity, source, category, impact, confidence,
        EXTRACTED_RELIABILITY, module="signal_extractor", **more,
    )


def fired(rules: Sequence[tuple[Column, Column]]) -> Column:
    """Array of the signals whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, sig) for cond, sig in rules])).cast(SIGNALS_DDL)


def no_signals() -> Column:
    return F.array().cast(SIGNALS_DDL)


def has_code(signals: Column, codes: Sequence[str]) -> Column:
    wanted = list(codes)
    return F.exists(signals, lambda s: s["code"].isin(wanted))


def is_severe(severity: Column) -> Column:
    return severity.isin("high", "critical")


def search_text(s: Column) -> Column:
    """Text in which weak-context words are looked up."""
    return F.lower(F.concat_ws(" ", s["code"], s["title"], s["description"], s["category"]))


def explode_signals(df: DataFrame, keys: Sequence[str], buckets: Sequence[str] = BUCKETS) -> DataFrame:
    """Long evidence table: keys, bucket, seq (order over all buckets) and the signal fields."""
    def tag(bucket: str) -> Column:
        return F.transform(
            F.col(f"{bucket}_signals"),
            lambda s: F.struct(F.lit(bucket).alias("bucket"), s.alias("s")),
        )

    tagged = F.concat(*[tag(b) for b in buckets])
    return explode_rows(df, keys, tagged, "seq", "_e").select(
        *keys, F.col("_e.bucket").alias("bucket"), "seq", "_e.s.*"
    )
