"""Benchmark decontamination: item-sized windows, SimHash blocks, exact weighted similarity.

Texts are lower-cased and cut into words of letters and digits; shingles are five words, and the only
shingle of a shorter text is all its words.  A window is as many shingles of a document in a row as the item has (all of a
shorter document), at any place.

1. Seeds.  Similarity of at least ``least`` needs that share of an item's shingles, so one of its
   rarest (1 - least) n + 1 shingles must occur in the document (prefix filter: nothing is lost).
   Documents are scanned once for those.
2. Windows.  In the documents found, the places of shared shingles are put in order.  A window that begins between
   two of them can move to the next one without losing any, so windows begin at shared places (or end with the
   document); one that reaches no further shared place than the window before holds no more of them, and
   one with fewer shared places than ``least`` needs is too far off.  The rest, counted by a running sum and so
   in any order of the passage's parts, holds a best window of every pair.  Equal windows are fingerprinted once.
3. Multi-index.  64-bit fingerprints of windows and items are cut into BLOCKS blocks.  Each item is
   indexed under all values within BLOCK_RADIUS bits of each block.  Fingerprints within
   RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1 bits have a block within BLOCK_RADIUS, so all of these meet.
   A window similar enough differs by some 9 bits, 19 being over three deviations away.  That holds for
   bags of distinct shingles, FEW or more; an item and a window of its own meet without
   fingerprints if either bag has repeats or fewer shingles.
4. Verification.  Weighted Jaccard similarity of the two bags of shingles, each weighing as often as it
   occurs: the sum of the lesser counts over the sum of the greater.

The benchmark's seeds and shingles are broadcast only if their counted number is below common.BROADCAST_ROWS;
beyond that the join is by shuffle.  The same holds for the keys of documents found.

Defined results: null and empty texts match nothing; an item of fewer than five words is found in documents of just
these words; items with equal words are searched once and all reported; rows that
repeat a doc_id and text are reported once; a null doc_id is reported as null.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, let, packed, sized, written

WIDTH = 5
BLOCKS, BLOCK_RADIUS = 5, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
FEW = 10


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hashes of the shingles at each place; all words are the one shingle of a shorter text, none that of an empty one."""

    def hashed(ws: Column) -> Column:
        last = F.greatest(F.size(ws) - (WIDTH - 1), F.lit(1))
        places = F.when(F.size(ws) > 0, F.sequence(F.lit(1), last)).otherwise(F.expr("CAST(array() AS array<int>)"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(ws, i, WIDTH)))

    return let(words, hashed)  # cut into words once, not for each place


def _majority(hashes: Column, width: int) -> Column:
    """Bits set in over half of the hashes.  Sums of ``width`` bits lie side by side in one number."""
    ones, low = (F.lit(sum(1 << x for x in places)).cast("long") for places in (range(0, 64, width), range(width)))
    moved = lambda x, n: F.call_function("shiftrightunsigned", x, n)

    def total(k: Column) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + moved(h, k).bitwiseAND(ones))

    def bits(sums: Column) -> Column:
        def one(i: Column) -> Column:
            count = moved(F.get(sums, i % width), i - i % width).bitwiseAND(low)
            return F.when(2 * count > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda n, i: n.bitwiseOR(one(i)))

    return let(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), total), bits)


def fingerprint(hashes: Column) -> Column:
    """64-bit SimHash: each bit is the majority of the hashes', repeats included."""
    return F.when(F.size(hashes) < 1 << 16, _majority(hashes, 16)).otherwise(_majority(hashes, 32))


def uneven(hashes: Column) -> Column:
    """Whether a bag is too small, or repeats too much, for its fingerprint to bound similarities."""
    return (F.size(hashes) < FEW) | (F.size(F.array_distinct(hashes)) < F.size(hashes))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags of hashes."""
    distinct = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))

    def lesser(n: Column, x: Column) -> Column:
        return n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))

    both = F.when(distinct, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(a), F.lit(0), lesser))
    return both / (F.size(a) + F.size(b) - both)


def _cuts() -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def _block(fp: Column, k: int) -> Column:
    first, width = _cuts()[k]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _near_values(fp: Column) -> Column:
    """(block, value) for all values within BLOCK_RADIUS bits of each block."""
    out = []
    for k, (_, width) in enumerate(_cuts()):
        masks = [sum(1 << b for b in c) for n in range(BLOCK_RADIUS + 1) for c in combinations(range(width), n)]
        # one text, which Spark turns into one array before the plan runs
        listed = F.transform(F.split(F.lit(" ".join(map(str, masks))), " "), lambda m: m.cast("long"))
        out.append(F.transform(listed, _near(k, _block(fp, k))))
    return F.concat(*out)


def _near(k: int, own: Column):
    return lambda m: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(m).alias("value"))


def items(benchmark: DataFrame) -> DataFrame:
    """Distinct items with a word: ids, n_words, hashes."""
    cut = benchmark.select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return (
        cut.groupBy("words").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
        .select(F.xxhash64("words").alias("item_key"), "ids", F.size("words").alias("n_words"), shingles(F.col("words")).alias("hashes"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of both; rows with equal keys have equal results."""
    return docs.select("doc_id", "text").withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.hash("text", "doc_id"))


def starts(matched: DataFrame, least: float) -> DataFrame:
    """Where windows begin that may be similar enough: k1, k2, item_key, n, start, a best one of every pair included.

    matched: k1, k2, item_key, n, size (shingles of the item and the document) and place of each shared shingle.
    """
    pair = ["k1", "k2", "item_key"]
    same = [*pair, "n", "size"]
    # a window [p, p + n) for each place p: its end comes before a place that it does not reach
    events = matched.select(*same, F.col("place").alias("at"), F.lit(1).alias("point"), F.lit(None).cast("int").alias("start")).unionByName(
        matched.select(*same, (F.col("place") + F.col("n")).alias("at"), F.lit(0).alias("point"), F.col("place").alias("start"))
    )
    order = Window.partitionBy(*pair).orderBy("at", "point")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # places before the window's end, and windows up to this one, whose places all lie before its end
    counted = events.withColumn("reached", F.sum("point").over(so_far)).withColumn("which", F.sum(1 - F.col("point")).over(so_far))
    before = F.max(F.when(F.col("point") == 0, F.col("reached"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.withColumn("before", before).where("point = 0 AND (before IS NULL OR reached > before)")
    need = F.ceil(least / (1 + least) * (F.col("n") + F.least("n", "size")) - 1e-9)
    enough = counted.where(F.col("reached") - F.col("which") + 1 >= need)
    return enough.select(*pair, "n", F.greatest(F.lit(0), F.least(F.col("start"), F.col("size") - F.col("n"))).alias("start")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, k1, k2: the best window of each pair."""
    bench = written(items(benchmark), "items")
    parts = bench.select("item_key", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    # rarest shingles first, by the number of items that hold them; ties by hash
    often = parts.groupBy("h").agg(F.countDistinct("item_key").alias("often"))
    ranked = parts.join(often, "h").groupBy("item_key", "n").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("all"))
    rare = ranked.select("item_key", F.explode(F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("r"))
    rare = written(rare.select(F.col("r.h").alias("h"), "item_key").distinct(), "seeds")
    parts = written(parts.distinct(), "item-shingles")

    keyed = _keyed(docs)
    scanned = keyed.select("k1", "k2", F.explode(shingles(normal_words(F.col("text")))).alias("h"))
    pairs = written(scanned.join(sized(rare, rare.count()), "h").select("k1", "k2", "item_key").distinct(), "seeded")

    # only documents with a seed are read again and cut into words once more
    seeded = pairs.select("k1", "k2").distinct()
    suspects = keyed.join(sized(seeded, seeded.count()), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    suspects = written(suspects.select("doc_id", "k1", "k2", shingles(normal_words(F.col("text"))).alias("hashes")), "suspects")

    places = suspects.select("k1", "k2", F.size("hashes").alias("size"), F.posexplode("hashes").alias("place", "h"))
    matched = places.join(sized(parts, parts.count()), "h").join(pairs, ["k1", "k2", "item_key"]).drop("h")
    placed = written(starts(matched, least), "placed")
    aligned = placed.select("k1", "k2", "n", "start").distinct()
    windows = suspects.join(aligned, ["k1", "k2"]).select("doc_id", "k1", "k2", "start", "n", F.slice("hashes", F.col("start") + 1, F.col("n")).alias("window"))
    windows = written(windows.withColumn("w1", F.xxhash64("window")).withColumn("w2", F.hash("window")), "windows")

    contents = windows.groupBy("w1", "w2", "n").agg(F.first("window").alias("window")).withColumn("fp", fingerprint(F.col("window")))
    blocks = contents.select(
        "w1", "w2", "n", "window", "fp", F.posexplode(F.array(*[_block(F.col("fp"), k) for k in range(BLOCKS)])).alias("block", "value")
    )
    index = bench.withColumn("item_fp", fingerprint(F.col("hashes"))).select(
        "item_key", F.size("hashes").alias("n"), "item_fp", "hashes", F.explode(_near_values(F.col("item_fp"))).alias("b")
    ).select("item_key", "n", "item_fp", "hashes", "b.block", "b.value")
    light = blocks.select("w1", "w2", "n", "fp", "block", "value").join(index.select("item_key", "n", "item_fp", "block", "value"), ["n", "block", "value"])
    near = light.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("w1", "w2", "item_key")
    at = windows.select("k1", "k2", "n", "start", "w1", "w2", uneven(F.col("window")).alias("odd"))
    odd = bench.select("item_key", uneven(F.col("hashes")).alias("odd_item"))
    direct = placed.join(odd, "item_key").join(at, ["k1", "k2", "n", "start"]).where("odd OR odd_item").select("w1", "w2", "item_key")
    met = near.unionByName(direct).distinct()
    same = (
        met.join(contents.select("w1", "w2", "window"), ["w1", "w2"]).join(bench.select("item_key", "ids", "n_words", "hashes"), "item_key")
        .withColumn("similarity", similarity(F.col("window"), F.col("hashes"))).where(F.col("similarity") >= least)
        .select("w1", "w2", "ids", "n_words", "similarity")
    )
    same = written(same, "same")
    best = (
        windows.select("doc_id", "k1", "k2", "start", "w1", "w2").join(same, ["w1", "w2"])
        .select("doc_id", "k1", "k2", F.explode("ids").alias("item_id"), "n_words", "similarity", "start")
        .groupBy("doc_id", "k1", "k2", "item_id", "n_words")
        .agg(F.max(F.struct("similarity", -F.col("start"))).alias("b"))
    )
    best = best.select("doc_id", "item_id", (-F.col("b.col2")).alias("start_word"), "n_words", F.col("b.similarity").alias("similarity"), "k1", "k2")
    best = written(best, "matches")
    dropped(bench, parts, rare, pairs, suspects, placed, windows, same)
    return best


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """docs, same columns, less every row whose text holds an item."""
    matches = find(docs, benchmark, least)
    found = written(matches.select("k1", "k2").distinct(), "leaks")
    dropped(matches)
    keys = F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")
    return docs.select(packed(docs), *keys).join(sized(found, found.count()), ["k1", "k2"], "left_anti").select("row.*")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark).drop("k1", "k2")
