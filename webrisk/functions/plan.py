"""Plan helpers for long chains of derived columns.

Catalyst pushes a filter below a projection by writing the definition of every
column into the predicate. Over dozens of dependent projections that grows
exponentially. A generator is a natural stop: a predicate on generated columns stays
above it, and ``explode`` in its outer form adds no inferred size predicate.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrisk.session import shared_root


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and lost executors cost nothing of it."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sealed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Emit ``columns`` through a one-row generator; all other columns pass by untouched.

    Filters on the emitted columns stop here, filters on the others still reach the scan.
    """
    wanted = [c for c in df.columns if c in set(columns)]
    rest = [c for c in df.columns if c not in set(columns)]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*wanted))))


def explode_rows(df: DataFrame, keys: Sequence[str], array: str | Column, position: str = "_pos", value: str = "_item") -> DataFrame:
    """One row per array element with its position; rows with an empty array give none."""
    column = F.col(array) if isinstance(array, str) else array
    return df.select(*keys, F.posexplode_outer(column).alias(position, value)).filter(
        F.col(position).isNotNull())
