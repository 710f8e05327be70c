"""SimHash near-duplicates through a segment-popcount embedding.

1. A 64-bit fingerprint for each text: the majority of the bits of its shingles' hashes.
2. Documents are grouped by fingerprint, so copies meet once, aggregated before the shuffle.
3. A fingerprint becomes a point: the number of set bits in each of its 2-bit segments.  A
   differing bit moves one coordinate by at most 1, so the Manhattan distance of two points is a
   lower bound of the Hamming distance.
4. Grid range-join.  The segments form some blocks, more of them the more points there are (see blocks_for).  Points
   within Manhattan distance ``radius`` agree in all but ``radius`` blocks at most, so they share at least one cell of
   the grids that all but ``radius`` blocks span.  Every point goes to its cell in each of these grids;
   pairs that meet are held to the Manhattan bound, then to the exact Hamming distance.  A pair is
   reported in the first grid where it meets only.  Points that differ in no coordinate meet in
   all grids and are exact-checked alike, so no link is lost.
5. Links between fingerprints give components, and these the smallest doc_id of each.

The join is on (grid, cell).  Two points unrelated to each other share a cell with a probability that falls with the
number of blocks, so their number in a cell stays about the same at any size; a cell crowded by
near copies can be split by Spark's skew handling, since only its join needs its rows together.

Defined results: null and empty texts have fingerprint zero and link like others; documents with
a null doc_id get the component of the others with their fingerprint or linked ones, and never
name it (a component of such documents alone has a null id); repeated rows are repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, packed, sized, written
from .components import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: For each byte value its eight bits, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
SEED = 42
SEGMENT = 2
BLOCKS = range(6, 17)
PART = 1 << 16  # shingles hashed at a time, so that one long text needs no long list


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the text's shingles of ``width`` words, repeats included; 0 without words."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, counts, digest = len(starts), np.zeros((8, 256), np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, PART):
        part = zip(starts[k : k + PART].tolist(), ends[k : k + PART].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in part], np.uint64).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts[byte] += np.bincount(h[:, byte], minlength=256)
    majority = (2 * (counts @ _BITS) > n).reshape(64)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = [fingerprint(t.encode("utf-8")) if isinstance(t, str) else 0 for t in texts]
        yield pd.Series(np.array(out, np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a signed 64-bit fingerprint column."""
    return docs.withColumn(name, F.pandas_udf(_fingerprints, "long")(F.col(text)))


_LOW = 0x5555555555555555


def segment_counts(fp: Column) -> Column:
    """The embedding: the number of set bits of each 2-bit segment, in the field where it was.

    The two bits are added by their carry, since the sum of the whole numbers may overflow.
    """
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: str, b: str) -> Column:
    """Distance of two embedded points.

    Fields hold 0, 1 or 2: the xor of two fields is odd if they are 1 apart and 2 if 2 apart.
    """
    odd, even = f"(({a} ^ {b}) & {_LOW}L)", f"(shiftrightunsigned({a} ^ {b}, 1) & {_LOW}L)"
    return F.expr(f"bit_count({odd}) + 2 * bit_count({even} & ~{odd})")


def blocks_for(points: int, radius: int = 3) -> int:
    """The number of blocks for which copies of points and meetings by chance are fewest together.

    A point has a copy for each grid.  Segments of two even bits agree by chance three times in eight.
    """
    def cost(blocks: int) -> float:
        agreeing = 64 / SEGMENT * (blocks - radius) / blocks
        return comb(blocks, radius) * (1 + points * 0.375**agreeing)

    return min((b for b in BLOCKS if b > radius), key=cost, default=radius + 1)


def block_masks(blocks: int) -> list[int]:
    """For each block a 64-bit mask of its segments, as a signed number."""
    cuts = np.linspace(0, 64 // SEGMENT, blocks + 1).round().astype(int) * SEGMENT
    masks = [sum(1 << b for b in range(a, e)) for a, e in zip(cuts[:-1], cuts[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(points: DataFrame, radius: int = 3, blocks: int = BLOCKS[0]) -> DataFrame:
    """(u, v) with u < v for all pairs of distinct fingerprints ``fp`` within ``radius`` bits."""
    if not radius < blocks <= 64 // SEGMENT:
        raise ValueError(f"radius {radius} needs more than {radius} and at most {64 // SEGMENT} blocks")
    masks = block_masks(blocks)
    grids = []  # blocks as bits, and the bits of these blocks' segments
    for g in combinations(range(blocks), blocks - radius):
        mask = sum(masks[b] & ((1 << 64) - 1) for b in g)
        grids.append((sum(1 << b for b in g), mask - (1 << 64) if mask >= 1 << 63 else mask))
    embedded = points.select("fp", segment_counts(F.col("fp")).alias("point"))
    each = F.array(*[F.struct(F.lit(bits).alias("grid"), F.col("point").bitwiseAND(F.lit(m).cast("long")).alias("cell")) for bits, m in grids])
    cells = embedded.select("fp", "point", F.inline(each))
    a, b = cells.alias("a"), cells.alias("b")
    # blocks in which the two points agree, as bits; the pair belongs to the grid of the first ones among them: if they
    # agree in further blocks, the first of these comes behind all of the grid's
    agree = "(" + "+".join(f"CASE WHEN ((a.point ^ b.point) & {m}L) = 0 THEN {1 << i} ELSE 0 END" for i, m in enumerate(masks)) + ")"
    near = manhattan("a.point", "b.point") <= radius
    exact = F.expr("bit_count(a.fp ^ b.fp)") <= radius
    more = f"({agree} ^ a.grid)"
    first = F.expr(f"{more} = 0 OR ({more} & -{more}) > a.grid")
    return a.join(
        b, (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & near & exact & first
    ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 3) -> DataFrame:
    """doc_id, text_hash, fingerprint (signed), root, component_id of every document.

    root is a fingerprint that names the component; component_id is the smallest doc_id in it.
    """
    light = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    marked = written(with_fingerprint(light).drop("text"), "fingerprints")
    points = marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least_id"))
    points = written(points, "points")
    classes = components(links(points.select("fp"), radius, blocks_for(points.count(), radius)))
    rooted = points.join(classes, points["fp"] == classes["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, marked["fingerprint"] == named["fp"]).select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs, same columns, with one row of each component: that with the smallest doc_id.

    Of rows with equal doc_ids in a component the one with the smaller text hash stays, and of rows
    equal in both the one that comes first as JSON; a row without doc_id stays only if no row of its
    component has one.  The choice is a table of ids and hashes, so texts are shuffled
    only if that is too large to broadcast, or where a chosen id and text occur more than once.
    """
    near = near_duplicates(docs, radius=radius)
    found = written(near.select("doc_id", "text_hash", "root"), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f")
    kept = found.groupBy("root").agg(first).select(F.col("f.doc_id").alias("id"), F.col("f.text_hash").alias("hash"))
    n = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    kept = kept.join(n, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select("id", "hash", "n")
    kept = written(kept, "kept")
    dropped(found)
    keyed = docs.select(packed(docs), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    chosen = keyed.join(sized(kept, kept.count()), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")))
    once = chosen.where("n = 1").select("row")
    again = chosen.where("n > 1").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionByName(again).select("row.*")
