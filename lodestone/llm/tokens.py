"""Token counts with a shortcut for whole tokens.

The vocabulary is the list of strings that might be one token.  Offline, once for each
tokenizer file, every such string is proved: it is encoded alone and kept only if that gives
exactly one id.  A text is then normalised, cut into pre-tokens by the tokenizer's own pattern,
and a pre-token that is proved counts 1 without any merging.  Only the distinct rest of each
group of texts goes through the merges.

This is exact because the tokenizer merges inside pre-tokens only, and because a pre-token is a
fixed point: normalising and cutting it alone gives it back.  Texts for which that may fail are
left to the library as a whole: those that hold the string of an added token, which the library
finds before it normalises, and those with characters outside a list of scripts, where two
versions of Unicode could cut or lower-case differently.

One pass over whole texts and no shuffle; each task holds a bounded memory of merged pre-tokens and
counts a long text piece by piece, cut at a space: no pre-token and no added token holds one, and
normalising does not reach across it.
Defined results: a null text counts as empty, with 0 bytes and 0 tokens; null doc_ids and
repeated rows are counted as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Pre-tokens of word_bpe_49k.json, as its file states them (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MEMORY = 1 << 19  # pre-tokens that a worker remembers
PIECE = 1 << 18  # characters counted at a time
#: Code points that every version of Unicode in use cuts and lower-cases alike, one by one:
#: Latin, combining marks, Cyrillic, general punctuation.
_PLAIN = [*range(0x00, 0x1C), *range(0x20, 0x250), *range(0x300, 0x370), *range(0x400, 0x482), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]


def file_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(first: str) -> str:
    """A character class of the plain code points whose category begins with ``first``."""
    return "".join(f"\\U{c:08x}" for c in _PLAIN if unicodedata.category(chr(c))[0] == first)


_IS_PLAIN = re.compile("[" + "".join(f"\\U{c:08x}" for c in _PLAIN) + "]*")
_L, _N, _S = _class("L"), _class("N"), " \t\n\x0b\x0c\r\x85\xa0"
#: PATTERN, spelt out for plain code points.
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class Counter49k:
    """Counts tokens as the library does, for a tokenizer that lower-cases and marks word ends."""

    def __init__(self, path: str, proved: frozenset[str] | None = None):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.proved = prove(path) if proved is None else proved
        self.cost = dict.fromkeys(self.proved, 1)

    def pretokens(self, text: str) -> list[str]:
        """Of a plain text.  White space never is in a pre-token, so its runs can stay as they are."""
        return _CUT.findall(unicodedata.normalize("NFC", text).lower())

    def by_library(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> bool:
        return _IS_PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def merge(self, new: list[str]) -> None:
        """Let the library merge pre-tokens, set apart by spaces, and note the tokens of each."""
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            coded = Counter(self.library.encode(" ".join(part), add_special_tokens=False).word_ids)
            if len(coded) == len(part):
                self.cost.update((t, coded[k]) for k, t in enumerate(part))
            else:
                self.cost.update((t, self.by_library(t)) for t in part)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) if self.plain(t) else None for t in texts]
        new = set().union(*(c for c in cut if c)) - self.cost.keys()
        if len(self.cost) + len(new) > MEMORY:
            self.cost = dict.fromkeys(self.proved, 1)
            new = set().union(*(c for c in cut if c)) - self.cost.keys()
        if new:
            self.merge(sorted(new))
        cost = self.cost.__getitem__
        return [self.by_library(t) if c is None else sum(map(cost, c)) for t, c in zip(texts, cut)]


def prove(path: str) -> frozenset[str]:
    """The strings of the vocabulary that, encoded alone, give exactly one token.

    Candidates come from decoding each id; the proof is the library's own answer, so a string
    that the vocabulary holds but the merges do not reach is left out.
    """
    library = Tokenizer.from_file(path)
    cut = regex.compile(PATTERN).findall
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    alphabet = _bytes_of()
    candidates = set()
    for token in library.get_vocab(with_added_tokens=False):
        body = token.removesuffix("</w>")
        if token in special or not all(c in alphabet for c in body):
            continue
        try:
            text = bytes(alphabet[c] for c in body).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if cut(text) == [text]:
            candidates.add(text)
    ordered = sorted(candidates)
    coded = library.encode_batch(ordered, add_special_tokens=False)
    return frozenset(t for t, c in zip(ordered, coded) if len(c.ids) == 1)


def _bytes_of() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level tokenizers means."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """A text cut behind spaces into pieces of about ``limit`` characters; runs without a space are not cut."""
    at = 0
    while len(text) - at > limit:
        space = text.rfind(" ", at, at + limit)
        end = (space if space >= 0 else text.find(" ", at + limit)) + 1
        if not end:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def batches_of(texts: Iterable, limit: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts in batches of about ``limit`` characters, with the place of the text of each."""
    which, out, size = [], [], 0
    for i, t in enumerate(texts):
        for piece in pieces(t) if isinstance(t, str) else ("",):
            if out and size + len(piece) > limit:
                yield which, out
                which, out, size = [], [], 0
            which.append(i)
            out.append(piece)
            size += len(piece)
    if out:
        yield which, out


_COUNTERS: dict[str, Counter49k] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Every column of docs and n_bytes, n_tokens, over_limit; same-named columns give way."""
    spark = docs.sparkSession
    # the vocabulary's size is fixed by the file (under 50,000 strings), whatever the corpus
    proved = spark.sparkContext.broadcast(prove(path))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _COUNTERS:  # kept for the worker's next tasks
            _COUNTERS[path] = Counter49k(path, proved.value)
        counter = _COUNTERS[path]
        for texts in batches:
            out = np.zeros(len(texts), np.int64)
            for which, part in batches_of(texts):
                np.add.at(out, which, counter.count(part))
            yield pd.Series(out)

    own = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*own, F.octet_length(whole).cast("long").alias("n_bytes"), tokens(F.col(text)).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
