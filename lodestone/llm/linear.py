"""Hashed sparse features and logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np

from .common import GROUP_BYTES, Words, batches_of, mix


def ngram_features(texts: list[bytes], bits: int, pairs: bool = True, shapes: bool = True, prefixes: tuple[int, ...] = (), symbols: bool = True, limit: int = GROUP_BYTES):
    """Hashed n-gram features of each text: arrays (document, index, count), sorted by both.

    Words are always in, ``pairs`` adds pairs of words.  ``shapes`` adds the kinds of characters of words, of
    pairs and of triples, with whether a word repeats the one before.  ``prefixes`` adds the
    first n bytes of longer words, for inflected forms.  Without ``symbols`` words end at punctuation.
    Long texts are read piece by piece, with the same result.
    """
    keys, counts = [], []
    for which, part, known in batches_of(texts, limit):
        key, count = _batch(np.array(which), part, np.array(known), bits, pairs, shapes, prefixes, symbols)
        keys.append(key)
        counts.append(count)
    key = np.concatenate([*keys, np.zeros(0, np.uint64)])
    count = np.concatenate([*counts, np.zeros(0, np.int64)])
    if len(keys) > 1:
        key, of = np.unique(key, return_inverse=True)
        count = np.bincount(of, count, len(key)).astype(np.int64)
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64), count


def _batch(which, texts: list[bytes], known, bits: int, pairs: bool, shapes: bool, prefixes: tuple[int, ...], symbols: bool):
    """Keys (text and index) and counts of one batch of pieces; n-grams that end in repeated words are left out."""
    w = Words(texts, symbols=symbols)
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, doc = w.hashes(), w.doc
    new = w.start >= (w.offsets[:-1] + known)[doc]
    parts = [(doc[new], h[new])]

    def grams(x: np.ndarray, n: int, salt: int) -> None:
        if len(x) < n:
            return
        key = np.full(len(x) - n + 1, salt, np.uint64)
        for i in range(n):
            key = mix(key * np.uint64(31) + x[i : len(x) - n + 1 + i])
        same = (doc[n - 1 :] == doc[: len(doc) - n + 1]) & new[n - 1 :]
        parts.append((doc[: len(key)][same], key[same]))

    if pairs:
        grams(h, 2, 2)
    if shapes:
        repeat = np.zeros(len(h), np.uint64)
        repeat[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        k = w.kinds() * np.uint64(2) + repeat
        grams(k, 1, 11)
        grams(k, 2, 12)
        grams(k, 3, 13)
    for n in prefixes:
        long = new & ((w.end - w.start) > n)
        parts.append((doc[long], mix(w.span_hash(w.start[long], w.start[long] + n) + np.uint64(100 + n))))
    d = which[np.concatenate([p[0] for p in parts])].astype(np.uint64)
    i = np.concatenate([p[1] for p in parts]) & np.uint64((1 << bits) - 1)
    return np.unique((d << np.uint64(bits)) | i, return_counts=True)


def values(doc: np.ndarray, count: np.ndarray, n_docs: int, scaled: bool = True) -> np.ndarray:
    """Damped counts; scaled to length 1 in each document if length shall say nothing."""
    v = np.log1p(count)
    if not scaled:
        return v
    norm = np.sqrt(np.bincount(doc, v * v, n_docs))
    return v / np.maximum(norm, 1e-12)[doc]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; the last coordinate is the bias."""

    def __init__(self, bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.size, self.alpha, self.beta, self.l1, self.l2 = 1 << bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, v: np.ndarray, target: float, weight: float = 1.0) -> None:
        """One step; ``target`` may be a probability."""
        i, v = np.append(i, self.size), np.append(v, 1.0)
        w = self.weights(i)
        g = (sigmoid(w @ v) - target) * v * weight
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g

    def fit(self, rows: list, targets, weights, epochs: int, seed: int = 7) -> np.ndarray:
        """rows: (indices, values) of each document.  Returns the weights, bias last."""
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                self.learn(*rows[k], targets[k], weights[k])
        return self.weights()


def rows_of(doc: np.ndarray, index: np.ndarray, value: np.ndarray, n_docs: int) -> list:
    """Cut the arrays, sorted by document, into one (indices, values) pair for each."""
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    return [(index[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def score(texts: list[bytes], weights: np.ndarray, bits: int, scaled: bool = True, **kinds) -> np.ndarray:
    """Probability for each text: a sparse dot product; a text without words gets the bias alone."""
    doc, index, count = ngram_features(texts, bits, **kinds)
    v = values(doc, count, len(texts), scaled)
    return sigmoid(np.bincount(doc, v * weights[index], len(texts)) + weights[-1])
