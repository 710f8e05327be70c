"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree such as domain, language, source.  A budget of tokens runs down
the tree: at each node the children share it by weight, none beyond its capacity (its tokens
times ``max_epochs``), and what one cannot use goes to its siblings.  Since a child's capacity
counts all below it, a shortage is made up among siblings first, and only what a whole family lacks
reaches the ancestors' other children.  All amounts are whole numbers, rounded down.

A leaf's budget is as many whole epochs over its documents as fit, and of the next epoch the prefix
whose tokens fit, in an order drawn by hash from seed, epoch and document.  The prefix sums are
taken over a tree of 4096 buckets of that order first, so a leaf that holds most rows is no single
task: only the bucket in which the prefix ends is put in order itself.

Everything is DataFrame operations.  Defined results: documents without tokens (null or empty
texts) are never drawn; null levels count as an empty name; repeated rows are drawn one by one, in the order of
their other columns as JSON; an empty table gives an empty result; with a budget above all capacity each document is drawn
``max_epochs`` times.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, packed, sized, written

BUCKET_DIGITS = 3  # hexadecimal digits of the order: 4096 buckets
Weights = Mapping[str, int]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _weight(column: str, weights: Weights) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Weights], budget: Callable[[Column], Column], max_epochs: int) -> DataFrame:
    """The budget of each leaf (levels..., budget), level by level from the top down.

    budget gives that of the root from the sum of all tokens.  In a family those children are filled whose capacity is within
    their share by weight of what is left; that leaves more to the others, and goes on until no further one is
    filled.  Each round is a sum for each family, joined back, whatever the number of children: no family is put in order.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rooted = leaves.withColumn("root", F.lit(0))
    parents, families = leaves.agg(budget(F.sum("tokens")).cast("long").alias("b")).withColumn("root", F.lit(0)), 1
    for depth, level in enumerate(levels):
        above = ["root", *levels[:depth]]
        nodes = rooted.groupBy(*above, level).agg((F.sum("tokens") * max_epochs).alias("cap")).withColumn("w", _weight(level, weights.get(level, {})))
        nodes = nodes.join(sized(parents, families), above)
        state = written(nodes.select(*above, level, "cap", "w", "b", F.lit(False).alias("full")), "mix-nodes")
        while True:
            taken, open_ = F.sum(F.when(F.col("full"), F.col("cap"))), F.sum(F.when(~F.col("full"), F.col("w")))
            sums = state.groupBy(*above).agg((F.max("b") - F.coalesce(taken, F.lit(0))).alias("left"), F.coalesce(open_, F.lit(0)).alias("rest"))
            fits = (F.col("rest") > 0) & (F.col("w") > 0) & (wide("cap") * wide("rest") <= wide("w") * wide("left"))
            after = state.select(*above, level, "cap", "w", "b", "full").join(sized(sums, families), above).select(*above, level, "cap", "w", "b", (F.col("full") | fits).alias("full"), F.col("full").alias("was"), "left", "rest")
            old, state = state, written(after, "mix-nodes")
            dropped(old)
            if state.where("full AND NOT was").isEmpty():
                break
        share = F.expr("CASE WHEN rest = 0 THEN 0L ELSE CAST(CAST(w AS DECIMAL(19,0)) * CAST(left AS DECIMAL(19,0)) div CAST(rest AS DECIMAL(19,0)) AS BIGINT) END")
        parents = state.select(*above, level, F.when(F.col("full"), F.col("cap")).otherwise(share).alias("b"))
        families = state.count()
    return parents.select(*levels, F.col("b").alias("budget"))


def _starts(sums: DataFrame, names: Sequence[str], digits: int) -> DataFrame:
    """Sums (names, __k, __s) with ``__start``, the sum over all smaller __k of the same names.

    __k are hexadecimal numbers of so many digits.  Sums go up a tree with 16 children at each node
    and starts come down, so no window holds more than 16 rows.
    """
    if digits == 1:
        before = Window.partitionBy(*names).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("__start", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    own = sums.withColumn("__up", F.left("__k", F.lit(digits - 1)))
    above = own.groupBy(*names, F.col("__up").alias("__k")).agg(F.sum("__s").alias("__s"))
    above = _starts(above, names, digits - 1).select(*names, F.col("__k").alias("__up"), F.col("__start").alias("__first"))
    before = Window.partitionBy(*names, "__up").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    inside = own.withColumn("__in", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    placed = inside.join(above, [*names, "__up"]).withColumn("__start", F.col("__first") + F.col("__in"))
    return placed.select(*names, "__k", "__s", "__start")


def draw(
    docs: DataFrame,
    levels: Sequence[str] = ("domain", "lang", "source"),
    weights: Mapping[str, Weights] | None = None,
    share: tuple[int, int] = (3, 5),
    max_epochs: int = 3,
    seed: int = 42,
    keep_text: bool = True,
) -> DataFrame:
    """Columns of docs with ``epoch`` and ``n_tokens``, one row for each time a document is drawn.

    ``share`` of all tokens, as numerator and denominator, is the budget.  docs needs doc_id, text
    and the levels; its columns epoch and n_tokens, if any, are replaced.
    """
    names = [f"level{i}" for i in range(len(levels))]
    gone = [c for c in docs.columns if c.lower() in ("epoch", "n_tokens") or (c == "text" and not keep_text)]
    text, own = F.coalesce("text", F.lit("")), [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(levels, names)]
    counted = docs.select(packed(docs, *gone), F.col("doc_id").cast("string").alias("id"), *own, word_count(text).alias("n"), F.md5(text).alias("t")).where("n > 0")
    counted = written(counted, "mix")
    leaves = written(counted.groupBy(*names).agg(F.sum("n").alias("tokens")), "leaves")

    def budget(total: Column) -> Column:
        return F.call_function("div", total * share[0], F.lit(share[1]))

    by_level = {n: (weights or {}).get(c, {}) for c, n in zip(levels, names)}
    plan = budgets(leaves, names, by_level, budget, max_epochs).join(leaves, names)
    plan = written(plan.selectExpr(*names, "budget div tokens AS full", "budget % tokens AS rest"), "budgets")
    dropped(leaves)

    rows = counted.join(sized(plan, plan.count()), names)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce("id", F.lit("null")), F.col("t")))
    rows = rows.withColumn("key", key).withColumn("bucket", F.left("key", F.lit(BUCKET_DIGITS)))
    sums = rows.groupBy(*names, "bucket").agg(F.sum("n").alias("__s"))
    sums = _starts(sums.withColumnRenamed("bucket", "__k"), names, BUCKET_DIGITS)
    sums = sums.select(*names, F.col("__k").alias("bucket"), F.col("__start").alias("start"), (F.col("__start") + F.col("__s")).alias("end"))
    sums = written(sums, "buckets")
    placed = rows.join(sized(sums, sums.count()), [*names, "bucket"])
    whole = placed.where("end <= rest").select("row", "n", F.col("full").alias("epoch"))
    last = placed.where("start < rest AND end > rest")
    # rows alike in key and id differ in other columns only, and go by these
    upto = Window.partitionBy(*names, "bucket").orderBy("key", F.col("row.doc_id"), F.to_json("row")).rowsBetween(Window.unboundedPreceding, 0)
    partly = last.withColumn("upto", F.col("start") + F.sum("n").over(upto)).where("upto <= rest").select("row", "n", F.col("full").alias("epoch"))
    full = rows.where("full > 0").select("row", "n", F.explode(F.expr("sequence(0L, full - 1)")).alias("epoch"))
    return full.unionByName(whole).unionByName(partly).select("row.*", "epoch", F.col("n").alias("n_tokens"))


def oracle(source: str, domain: str, weights: Mapping[str, Weights], share: tuple[int, int], max_epochs: int, seed: int) -> str:
    """DuckDB SQL for the drawn (doc_id, domain, lang, source, n_tokens, epoch) of a table."""

    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{n}' THEN {w}" for n, w in weights.get(level, {}).items())
        return f"CAST(CASE{cases} ELSE 1 END AS HUGEINT)" if cases else "CAST(1 AS HUGEINT)"

    def level(here: list[str], above: list[str], parent: str, name: str) -> str:
        keys = ", ".join(here)
        fam = "PARTITION BY " + ", ".join(above) if above else ""
        using = f"JOIN {parent} USING ({', '.join(above)})" if above else f"CROSS JOIN {parent}"
        return f"""
{name}a AS (SELECT {keys}, CAST(sum(tokens) * {max_epochs} AS HUGEINT) AS cap, {weight(here[-1])} AS w FROM leaves GROUP BY {keys}),
{name}b AS (SELECT {keys}, cap, w, row_number() OVER o AS k, b - coalesce(sum(cap) OVER p, 0) AS lft,
  sum(w) OVER ({fam}) - coalesce(sum(w) OVER p, 0) AS rest FROM {name}a {using}
  WINDOW o AS ({fam} ORDER BY cap / w, {here[-1]}), p AS ({fam} ORDER BY cap / w, {here[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}c AS (SELECT *, min(CASE WHEN NOT cap * rest <= w * lft THEN k END) OVER ({fam}) AS f FROM {name}b),
{name} AS (SELECT {keys}, CASE WHEN f IS NULL OR k < f THEN cap ELSE w * CAST(max(CASE WHEN k = f THEN lft END) OVER ({fam}) AS HUGEINT) // CAST(max(CASE WHEN k = f THEN rest END) OVER ({fam}) AS HUGEINT) END AS b FROM {name}c)"""

    return f"""
WITH d AS (SELECT doc_id, text, coalesce({domain}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM {source}),
c AS (SELECT * FROM d WHERE n > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS HUGEINT) AS tokens FROM c GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) AS HUGEINT) * {share[0]} // {share[1]} AS b FROM leaves),
{level(['domain'], [], 'root', 'l1')}, {level(['domain', 'lang'], ['domain'], 'l1', 'l2')}, {level(['domain', 'lang', 'source'], ['domain', 'lang'], 'l2', 'l3')},
plan AS (SELECT domain, lang, source, CAST(b // tokens AS BIGINT) AS whole, CAST(b % tokens AS BIGINT) AS rest FROM l3 JOIN leaves USING (domain, lang, source)),
r AS (SELECT c.*, whole, rest, md5(concat_ws(':', '{seed}', CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(text))) AS k FROM c JOIN plan USING (domain, lang, source)),
u AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, domain, lang, source, n AS n_tokens, unnest(range(whole)) AS epoch FROM u WHERE whole > 0
UNION ALL SELECT doc_id, domain, lang, source, n, whole FROM u WHERE upto <= rest
"""
