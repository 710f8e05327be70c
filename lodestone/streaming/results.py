"""Results as a stream of frames: meta, row, complete.

Rows are fetched partition by partition, so a slow reader holds the next partitions back and the
driver never keeps the whole result.
"""

from __future__ import annotations

import datetime
import decimal
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame


def plain(value):
    """A value as JSON has it: decimals and dates as text."""
    if isinstance(value, (decimal.Decimal, datetime.date)):
        return str(value)
    return value


def frames(df: DataFrame, names: list[str], types: list[str], limit: int | None = None) -> Iterator[dict]:
    yield {"frame": "meta", "columns": names, "columnTypes": types}
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        if limit is not None and n >= limit:
            yield {"frame": "complete", "rows": n, "truncated": True}
            return
        yield {"frame": "row", "values": [plain(v) for v in row]}
        n += 1
    yield {"frame": "complete", "rows": n, "truncated": False}


def ndjson(df: DataFrame, names: list[str], types: list[str], limit: int | None = None) -> Iterator[str]:
    for f in frames(df, names, types, limit):
        yield json.dumps(f, ensure_ascii=False)
