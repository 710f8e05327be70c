"""The dialect's relational operators on DataFrames, for programs that do without SQL text.

Each is a plan for Catalyst; none collects or loops over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross"}


def join(left: DataFrame, right: DataFrame, on: Column | None, kind: str = "INNER") -> DataFrame:
    """Any join of the dialect; equalities in ``on`` become hash or merge keys."""
    return left.crossJoin(right) if kind == "CROSS" else left.join(right, on, JOINS[kind])


def semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of left with a partner (IN, EXISTS)."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of left without a partner (NOT EXISTS)."""
    return left.join(right, on, "left_anti")


def anti_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN: nothing if right holds a null, no row whose key is null unless right is empty.

    One pass over right for two flags, then a plain hash or merge anti join, where a null-aware
    one could only broadcast.
    """
    found = left.join(right.select(F.col(other).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
    nulls = right.agg(F.count_if(F.col(other).isNull())).scalar()
    rows = right.agg(F.count(F.lit(1))).scalar()
    return found.where((nulls == 0) & ((rows == 0) | F.col(key).isNotNull()))


def ordering(column: str, descending: bool = False, nulls: str | None = None) -> Column:
    """A sort key with the dialect's defaults: nulls last if ascending, first if descending."""
    first = (nulls or ("FIRST" if descending else "LAST")) == "FIRST"
    c = F.col(column)
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last())


def order_by(df: DataFrame, keys: Sequence[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sort; with a limit each task keeps limit + offset rows at most."""
    out = df.orderBy(*keys)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def distinct(df: DataFrame) -> DataFrame:
    """Rows once each; nulls are equal to one another."""
    return df.distinct()
