"""What the operators of this subpackage share: places, folds, word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent a folder of our own is made for local masters, which goes at
    exit; on a cluster its absence is an error, since machines do not share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, _OWN_DIR[app], True)
        base = _OWN_DIR[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it back.

    Unlike localCheckpoint the copy survives the loss of any executor.  It goes when the
    application ends, or with dropped().
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    store, where = _file_system(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the tables of frames that written() gave and that no later plan reads."""
    for df in frames:
        store, where = _file_system(df.sparkSession, df.written_to)
        store.delete(where, True)
        store.cancelDeleteOnExit(where)


def packed(df: DataFrame, *leave: str) -> Column:
    """All columns of a row, but for those named, as one struct called ``row``.

    Operators carry a caller's columns in it, so that no name of theirs can clash with one of our
    own; ``row.*`` gives them back.
    """
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in leave]).alias("row")


#: Rows of a few small columns that may be broadcast: some 30 MB.
BROADCAST_ROWS = 250_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it was counted to have few enough rows; else joins shuffle it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null keys have no fold."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row however often use() names it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The array of words of a text; null texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


#: A labelled text above this many bytes is never sampled, so a sample of n rows has n times as many at most.
SAMPLE_BYTES = 1 << 17


def _few(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows with the smallest hashes of doc_id; each task first drops most of its rows."""
    total = rows.count()
    share = 1.0 if total <= 4 * n else 3.0 * n / total
    near = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    return near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int, unlabelled: int = 0) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled documents outside the held-out fold, and of
    at most ``unlabelled`` others outside of it, whose label is null.

    Repeated label rows of a document count as 1 if any is 1; documents repeated under
    one doc_id count once.  The choice follows a hash of doc_id, so it does not depend on
    the order or the partitioning of the input.  Texts of more than SAMPLE_BYTES bytes are left out.
    Columns: doc_id, text, label.
    """
    outside = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held_out)
    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    chosen = _few(named.where(outside).groupBy("doc_id").agg(F.max("label").alias("label")), rows)
    if unlabelled:
        others = _few(docs.select("doc_id").where(outside), 2 * unlabelled).distinct()
        # ids of a bounded sample on the broadcast sides
        known = named.select("doc_id").join(F.broadcast(others), "doc_id", "left_semi").distinct()
        others = others.join(F.broadcast(known), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
        chosen = chosen.unionByName(others.select("doc_id", F.lit(None).cast("int").alias("label")))
    # at most so many rows of two numbers: a proven bound, so the documents need no shuffle
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))


# --- vectorised word hashing ---------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One bit for each kind of character in a word; symbols share eight bits.
_KIND = np.zeros(256, np.uint16)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[128:] = 8
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 16 << (_c % 8)
#: White space and ASCII symbols.
_IS_SYMBOL = _IS_SPACE.copy()
for _c in range(33, 127):
    _IS_SYMBOL[_c] = not chr(_c).isalnum()
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("p", _BASE), ("q", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts as arrays: hash, document, byte bounds, kinds of characters.

    Work per byte is a few vector operations, and memory is some 40 bytes for each byte of
    the texts given, so callers pass batches of bounded size (see batches_of()).
    """

    def __init__(self, texts: list[bytes], lower: bool = True, symbols: bool = True):
        """symbols: whether ASCII symbols belong to words or separate them."""
        buffer = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        self.raw = buffer
        if lower:
            buffer = _LOWER[buffer]
        self.bytes = buffer
        space = (_IS_SPACE if symbols else _IS_SYMBOL)[buffer]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.n_docs = len(texts)
        p, self._inverse = _powers(len(buffer) + 1)
        self._prefix = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * p[: len(buffer)], out=self._prefix[1:])

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._prefix[end] - self._prefix[start]) * self._inverse[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def kinds(self) -> np.ndarray:
        """The kinds of characters of each word, by its case before lowering."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        bounds = np.empty(2 * len(self.start), np.int64)
        bounds[0::2], bounds[1::2] = self.start, self.end
        return np.bitwise_or.reduceat(_KIND[self.raw], bounds)[0::2].astype(np.uint64)


GROUP_BYTES = 1 << 20
CONTEXT = 3  # words of the piece before that a piece repeats


def groups(texts, limit: int = GROUP_BYTES):
    """Split a sequence of texts into runs of about ``limit`` bytes; yields (first, bytes list)."""
    first, out, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if out and size + len(b) > limit:
            yield first, out
            first, out, size = i, [], 0
        out.append(b)
        size += len(b)
    if out:
        yield first, out


def pieces(text: bytes, limit: int = GROUP_BYTES) -> Iterator[tuple[bytes, int]]:
    """A text cut at white space into pieces of ``limit`` bytes or so, that together are the whole text.

    Yields (piece, bytes at its start that repeat the last words of the piece before).  A run of more
    than ``limit`` bytes without white space is cut where the limit falls.
    """
    at, before = 0, b""
    while True:
        end = len(text)
        if end - at > limit:
            end = at + limit
            space = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = space + 1 if space > at else end
        yield before + text[at:end], len(before)
        if end == len(text):
            return
        before = b" ".join((before + text[at:end]).rsplit(None, CONTEXT)[-CONTEXT:]) + b" "
        at = end


def batches_of(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Pieces of texts in batches of about ``limit`` bytes: which texts, the pieces, bytes repeated."""
    which, out, known, size = [], [], [], 0
    for i, t in enumerate(texts):
        for piece, skip in pieces(t, limit):
            if out and size + len(piece) > limit:
                yield which, out, known
                which, out, known, size = [], [], [], 0
            which.append(i)
            out.append(piece)
            known.append(skip)
            size += len(piece)
    if out:
        yield which, out, known
