"""Connected components of a distributed list of links, by iterated minimum labels.

Each round replaces every link by links to the smallest neighbour (large-star, then
small-star), which ends in a star around each component's smallest node after a number of
rounds that grows with the logarithm of the longest path.  All state is in tables of the shared
folder; the driver sees one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over links (u, v).

    Large star: each node links its larger neighbours to its smallest one.  Small star: each
    node links its smaller neighbours, and itself, to its smallest one.
    """
    both = links if not larger_only else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # the minimum is aggregated before the shuffle; the join that follows may be split where a
    # node has very many links
    spread = both.join(low, "u")
    if larger_only:
        return spread.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = spread.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of every node in links (u, v); root is the smallest node of its component.

    Nodes without links are not returned.  An empty input gives an empty result.
    """
    state = written(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("u"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("hash(u, v)"))).first())

    before = sign(state)
    for _ in range(rounds):
        if not before[0]:
            break
        large = _star(state, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        old, state = state, written(_star(large, False), name)
        dropped(old)
        after = sign(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
