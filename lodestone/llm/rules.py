"""Quality rules: base counts of repetition and symbols, and bands of compression ratios.

The ratio of UTF-8 bytes to their zstandard size tells repetitive text (far too high) and
incompressible text (far too low) apart from prose, whose ratio lies in a narrow band that
moves with the length compressed.  Whole documents and each fixed chunk are held to the band
of their own length; a document fails if it is outside, or if more than a share of its chunks
are.  One pass over whole texts, one at a time, and no shuffle.  Counts are exact: words are numbered by
their value, not hashed.

Defined results: null and empty texts have no words and fail the base rules; a null doc_id is
kept as it is; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed

LEVEL = 3
CHUNK = 2048
#: (up to this many bytes, least ratio, greatest ratio).  Random base-64 text has 4/3 at any length,
#: which prose exceeds from some hundred bytes on.
BANDS = (
    (128, 0.0, 2.0),
    (256, 0.8, 2.4),
    (512, 1.1, 2.7),
    (1024, 1.3, 3.0),
    (2048, 1.4, 3.3),
    (4096, 1.5, 3.6),
    (16384, 1.55, 4.0),
    (65536, 1.55, 4.6),
    (float("inf"), 1.55, 5.5),
)
MAX_BAD_CHUNKS = 0.3
MIN_CHUNK = 512  # a shorter last chunk belongs to the one before
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: What is no first byte of a code point in a word.
_NOT_COUNTED = SPACES + bytes(range(0x80, 0xC0))
PART = 1 << 20  # bytes cut into words at a time


def limits(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in BANDS if n_bytes <= most)


def ratio(data: bytes, zip_: zstandard.ZstdCompressor) -> float:
    return len(data) / len(zip_.compress(data)) if data else 0.0


def compression(data: bytes, zip_: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of chunks outside their band, and whether both are acceptable."""
    whole = ratio(data, zip_)
    low, high = limits(len(data))
    cuts = list(range(0, len(data), CHUNK)) + [len(data)]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < MIN_CHUNK:
        del cuts[-2]
    bad = 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, hi = limits(b - a)
        bad += not lo <= ratio(data[a:b], zip_) <= hi
    share = bad / max(1, len(cuts) - 1)
    return whole, share, low <= whole <= high and share <= MAX_BAD_CHUNKS


def word_numbers(text: bytes) -> np.ndarray:
    """The words of a text as numbers, equal for equal words."""
    number: dict[bytes, int] = {}
    out, at = [], 0
    while at < len(text):
        end = min(at + PART, len(text))
        while end < len(text) and text[end] not in SPACES:  # a word is not cut
            near = min((k for k in (text.find(c, end, end + PART) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0), default=min(end + PART, len(text)))
            end = near
        out.append(np.array([number.setdefault(w, len(number)) for w in text[at:end].split()], np.int64))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in windows of WINDOW words that occur twice or more.

    Windows are numbered by doubling: those of 2 words by the numbers of their two words, those of 4
    by their two halves, and so on, so equal numbers mean equal words.
    """
    if len(ids) <= WINDOW:
        return 0
    number, width = ids, 1
    while width < WINDOW:
        pair = number[: len(number) - width] * (int(number.max()) + 1) + number[width:]
        width *= 2
        if width < WINDOW:
            number = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def judge(text: bytes, zip_: zstandard.ZstdCompressor) -> tuple:
    """The counts of one text, in the order of _FOUND."""
    ids = word_numbers(text)
    chars, symbols = len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS))
    return len(ids), chars, symbols, repeated_lines(text), repeated_words(ids), *compression(text, zip_)


_FOUND = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, in_band boolean"


def _judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    zip_ = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.split()[0] for x in _FOUND.split(", ")]
    for texts in batches:
        yield pd.DataFrame([judge(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"", zip_) for t in texts], columns=names)


def apply_rules(docs: DataFrame, text: str = "text", min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """Every column of docs but those named as a result, the counts, base_failed and kept."""
    names = {*(x.split()[0] for x in _FOUND.split(", ")), "base_failed", "kept"}
    own = [c for c in docs.columns if c.lower() not in names]
    found = docs.select(packed(docs.select(*own)), F.pandas_udf(_judged, _FOUND)(F.col(text)).alias("found")).select("row", "found.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    counts = [x.split()[0] for x in _FOUND.split(", ")]
    return (
        found.select("row", *counts, failed.alias("base_failed"), (~failed & F.col("in_band")).alias("kept")).select("row.*", *counts, "base_failed", "kept")
    )
