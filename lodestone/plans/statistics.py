"""Table statistics: one pass for the scalar figures, one pass with one shuffle for the frequent values of all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.results import plain

TOP, BUCKETS = 8, 8


def collect(df: DataFrame, columns: list, place: str) -> dict:
    """Rows, and for each column: nulls, distinct values, least, greatest, most frequent, bounds.

    place is a folder for the counts of values.  Distinct counts and bounds are approximate (HyperLogLog++ and Greenwald-Khanna), so the pass
    keeps small state at any size; the frequent values are exact, and go by their text where they are equally frequent.
    """
    asked = [F.count(F.lit(1)).alias("rows")]
    for i, (c, k) in enumerate(columns):
        asked += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c, 0.01).alias(f"d{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"g{i}")]
        if k.numeric:
            asked.append(F.percentile_approx(c, [b / BUCKETS for b in range(1, BUCKETS)]).alias(f"p{i}"))
    row = df.agg(*asked).first()
    out = {"rows": row["rows"], "columns": {}}
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("value")) for i, (c, _) in enumerate(columns)])
    counts = df.select(F.inline(each)).where("value IS NOT NULL").groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    counts.write.parquet(place)
    counts = df.sparkSession.read.parquet(place)
    read = {"INT": int, "BIGINT": int, "FLOAT": float, "BOOL": lambda x: x == "true"}
    for i, (c, k) in enumerate(columns):
        top = counts.where(F.col("i") == i).orderBy(F.desc("n"), F.asc("value")).limit(TOP).collect()
        frequent = [(read.get(k.name, str)(r["value"]), r["n"]) for r in top]
        out["columns"][c] = {
            "nulls": row["rows"] - row[f"n{i}"],
            "distinct": min(row[f"d{i}"], row[f"n{i}"]),
            "least": plain(row[f"l{i}"]),
            "greatest": plain(row[f"g{i}"]),
            "frequent": [[plain(r[0]), r[1]] for r in frequent],
            "bounds": [plain(x) for x in row[f"p{i}"] or []] if k.numeric else [],
        }
    return out
