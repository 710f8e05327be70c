"""Foreign Parquet tables, and files out."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from ..errors import EngineError
from ..functions import scalar
from ..plans import types as t
from ..plans.lower import Table


def register(spark: SparkSession, path: str, name: str, view: str, dates: Collection[str] = ()) -> Table:
    """A read-only table over a Parquet path; columns of types the dialect lacks are left out.

    The dialect has no timestamps.  They are seen as text (2024-05-01 10:00:00), or as dates if they are named
    in ``dates``; a time of day in such a column is then an error, so nothing is cut off.  All else is
    seen as it is, so filters and column choice reach the scan.
    """
    df = spark.read.parquet(path)
    kept = [(f, t.of_spark(f.dataType)) for f in df.schema.fields]
    as_date = {d.lower() for d in dates}
    columns: list[Column] = []
    seen: list[tuple[str, t.Type]] = []
    for f, kind in kept:
        if kind is None:
            continue
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (st.TimestampType, st.TimestampNTZType)):
            if f.name.lower() in as_date:
                kind = t.DATE
                quoted = scalar.name(f.name)
                column = F.expr(f"CASE WHEN {quoted} IS NULL OR {quoted} = date_trunc('DAY', {quoted}) THEN CAST({quoted} AS DATE) ELSE CAST(raise_error('{f.name.replace(chr(39), '')} holds a time of day') AS DATE) END")
            else:
                column = column.cast("string")
        columns.append(column.alias(f.name))
        seen.append((f.name, kind))
    wrong = as_date - {f.name.lower() for f, _ in kept if isinstance(f.dataType, (st.TimestampType, st.TimestampNTZType))}
    if wrong:
        raise EngineError("InvalidArgument", f"{', '.join(sorted(wrong))}: no timestamp of {name}")
    df.select(*columns).createOrReplaceTempView(view)
    return Table(name, view, seen)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
