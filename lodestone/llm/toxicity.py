"""Toxicity by weak supervision.

1. Voters.  Three views of a text give lexicons of their own: whole words, beginnings of words and
   characters inside words.  Each lexicon is dealt out to several voters; a voter says toxic if
   the text holds an entry of its own, not toxic if a text of some length holds none, else
   nothing.  Pattern voters look at exclamation marks, capitals and drawn-out letters.  Labels choose the entries,
   and the patterns that are kept, and have no other part.
2. Label model.  A generative model with one hidden class and a tree of dependences between
   voters (the maximum spanning tree of their mutual information given the class) is fitted by
   expectation maximisation to the votes on labelled and unlabelled rows alike, without their labels.  It begins
   where two voters agree.  Its tables are the voters' accuracies and correlations.
3. Classifier.  A linear classifier over hashed words and word beginnings is trained on the
   model's posterior labels of all these rows, and scores every document with a sparse dot product.

The model is fitted on a bounded sample: ``train_rows`` labelled rows and ``unlabelled_rows`` others, none of
more than common.SAMPLE_BYTES bytes.  Scoring covers all rows and whole texts, long ones piece by piece, and needs no
shuffle.  Defined results: null and empty texts have no features and get the bias alone; a null
doc_id is scored and never held out; repeated rows are scored one by one; without labelled
rows the score is 0.5; if labels choose no voter, the score is near their mean.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import Words, fold, groups, labelled_sample, mix

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
INSIDE = 5  # length of the character sequences inside words
KINDS = {"pairs": False, "shapes": False, "prefixes": PREFIXES, "symbols": False, "scaled": False}
#: View -> voters and entries of its lexicon.
VIEWS = {"words": (3, 60), "beginnings": (3, 60), "inside": (2, 40)}
CANDIDATES = 3000  # entries considered
QUIET = 20  # words of a text in which a lexicon voter that finds nothing says not toxic
SAYS_TOXIC, SAYS_NOT, SILENT = 1, 0, 2


def view_features(texts: list[bytes], views: Iterable[str]) -> tuple[np.ndarray, dict[str, list[np.ndarray]]]:
    """The number of words of each text, and for each view the hashes of what it holds, repeats included."""
    w = Words(texts, symbols=KINDS["symbols"])
    length = w.end - w.start

    def cut(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        doc, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [h[a:b] for a, b in zip(at[:-1], at[1:])]

    def beginnings(n: int):
        long = length > n
        return w.doc[long], mix(w.span_hash(w.start[long], w.start[long] + n) + np.uint64(100 + n))

    def inside(first: int):
        long = length >= first + INSIDE
        return w.doc[long], mix(w.span_hash(w.start[long] + first, w.start[long] + first + INSIDE) + np.uint64(7))

    parts = {
        "words": lambda: [(w.doc, w.hashes())],
        "beginnings": lambda: [beginnings(n) for n in PREFIXES],
        "inside": lambda: [inside(k) for k in range(1, 8)],
    }
    return np.bincount(w.doc, minlength=len(texts)), {v: cut(parts[v]()) for v in views}


def find_lexicon(features: list[np.ndarray], y: np.ndarray, size: int, cover: int = 3) -> np.ndarray:
    """Hashes that occur in far more toxic than other texts, chosen one after the other.

    A toxic text counts for an entry until ``cover`` entries are found in it, so the entries reach
    all kinds and languages of toxic texts instead of many forms of the most frequent words.
    """
    sets = [np.unique(f) for f in features]
    # an entry is in three toxic texts at least; all else goes before the other texts are put together
    some, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, label in zip(sets, y) if label == 1)]), return_counts=True)
    some = some[n >= 3]
    sets = [x[np.isin(x, some, assume_unique=True)] for x in sets]
    key, inverse = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    if not len(key) or not (y == 1).any():
        return key[:0]
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    toxic = (y == 1)[of]
    pos, neg = np.bincount(inverse[toxic], minlength=len(key)), np.bincount(inverse[~toxic], minlength=len(key))
    odds = np.log((pos + 0.5) / ((y == 1).sum() + 1)) - np.log((neg + 0.5) / ((y == 0).sum() + 1))
    best = np.lexsort((key, -odds * np.sqrt(pos)))[:CANDIDATES]
    best = best[(odds[best] > 1.5) & (pos[best] >= 3)]
    place = np.full(len(key), -1)
    place[best] = np.arange(len(best))
    column = np.full(len(sets), -1)
    column[np.flatnonzero(y == 1)] = np.arange((y == 1).sum())
    there = np.zeros((len(best), (y == 1).sum()), bool)
    some = toxic & (place[inverse] >= 0)
    there[place[inverse[some]], column[of[some]]] = True
    found, covered = [], np.zeros(there.shape[1], int)
    for _ in range(min(size, len(best))):
        gain = odds[best] * np.sqrt(there @ (covered < cover).astype(float))
        gain[found] = 0
        k = int(np.argmax(gain))
        if gain[k] <= 0:
            break
        found.append(k)
        covered += there[k]
    return key[best[found]]


def lexicon_votes(features: list[np.ndarray], n_words: np.ndarray, lexicon: np.ndarray, voters: int) -> np.ndarray:
    """Votes of the voters to which a lexicon's entries are dealt out, one column for each."""
    order = np.argsort(lexicon)
    ranked = lexicon[order]
    out = np.full((len(features), voters), SILENT, np.int8)
    if not voters:
        return out
    out[n_words >= QUIET] = SAYS_NOT
    for r, f in enumerate(features):
        at = np.searchsorted(ranked, f)
        at[at == len(ranked)] = 0
        hit = order[at[ranked[at] == f]] if len(ranked) else at[:0]
        out[r, np.unique(hit % voters)] = SAYS_TOXIC
    return out


def pattern_votes(texts: list[bytes], n_words: np.ndarray) -> np.ndarray:
    """Votes of the patterns: exclamation marks, capitals, drawn-out letters.  None says not toxic."""
    out = np.full((len(texts), 3), SILENT, np.int8)
    for r, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        upper, lower = ((b >= 65) & (b <= 90)).sum(), ((b >= 97) & (b <= 122)).sum()
        letter = ((b[:-3] | 32) >= 97) & ((b[:-3] | 32) <= 122) if len(b) > 3 else np.zeros(0, bool)
        drawn = len(letter) > 0 and (letter & (b[:-3] == b[1:-2]) & (b[:-3] == b[2:-1]) & (b[:-3] == b[3:])).any()
        for k, fires in enumerate((t.count(b"!") * 30 > n_words[r], upper > 20 and upper > lower, drawn)):
            out[r, k] = SAYS_TOXIC if fires else SILENT
    return out


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(vote | class, vote of its parent in the tree)."""

    prior: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5]))
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3, 3)))

    @staticmethod
    def tree(v: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """Parents in the maximum spanning tree of mutual information given the class."""
        n = v.shape[1]
        weight = np.zeros((n, n))
        one = [(v == k).astype(float) for k in range(3)]
        for c in (0, 1):
            p = posterior[:, c]
            total = p.sum() + 9e-3
            for a in range(3):
                for b in range(3):
                    joint = ((one[a] * p[:, None]).T @ one[b] + 1e-3) / total
                    pa, pb = ((one[a].T @ p) + 3e-3) / total, ((one[b].T @ p) + 3e-3) / total
                    weight += p.mean() * joint * np.log(joint / (pa[:, None] * pb[None, :]))
        parent, best, near = np.full(n, -1), np.full(n, -np.inf), np.zeros(n, int)
        left = set(range(1, n))
        last = 0
        while left:
            for k in left:
                if weight[last, k] > best[k]:
                    best[k], near[k] = weight[last, k], last
            last = max(left, key=lambda k: best[k])
            parent[last] = near[last]
            left.remove(last)
        return parent

    def fit(self, v: np.ndarray, start: np.ndarray, rounds: int = 25) -> LabelModel:
        """start: first guess of the class."""
        post = np.stack([1 - start, start], 1)
        n = v.shape[1]
        for r in range(rounds):
            if r % 5 == 0:
                self.parent = self.tree(v, post)
            self.prior = (post.sum(0) + 1) / (len(v) + 2)
            self.tables = np.full((n, 2, 3, 3), 0.1)
            for j in range(n):
                up = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), int)
                for c in (0, 1):
                    np.add.at(self.tables[j, c], (up, v[:, j]), post[:, c])
            self.tables /= self.tables.sum(3, keepdims=True)
            new = self.posterior(v)
            done = np.abs(new - post[:, 1]).max() < 1e-4
            post = np.stack([1 - new, new], 1)
            if done:
                break
        return self

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.log(self.prior)[None, :].repeat(len(v), 0)
        for j in range(v.shape[1]):
            up = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), int)
            log += np.log(self.tables[j][:, up, v[:, j]]).T
        return linear.sigmoid(log[:, 1] - log[:, 0])

    def accuracies(self, v: np.ndarray) -> list[float]:
        """Estimated share of each voter's votes that agree with the hidden class."""
        p = self.posterior(v)
        agree = np.where(v == 1, p[:, None], 1 - p[:, None]) * (v < 2)
        return (agree.sum(0) / np.maximum(1, (v < 2).sum(0))).round(4).tolist()


def fit(ids, texts, labels, bits: int = BITS, epochs: int = 6) -> tuple[np.ndarray, dict]:
    """Weights of the classifier and a report on the label model, from a bounded sample.

    Labels that are neither 0 nor 1 mean unlabelled rows.
    """
    order = np.argsort(np.asarray(ids, object).astype(str), kind="stable")
    texts, labels = [texts[k] for k in order], np.asarray(labels, float)[order]
    known = np.isin(labels, (0, 1))
    y = labels[known].astype(int)
    named = [t for t, k in zip(texts, known) if k]
    lexicons = {}
    for view, (_, size) in VIEWS.items():  # one view at a time, so that memory holds the features of one
        found = [np.unique(f) for _, group in groups(named) for f in view_features(group, [view])[1][view]]
        lexicons[view] = find_lexicon(found, y, size)
    entries = {v: len(x) for v, x in lexicons.items()}
    rows, votes, patterns = [], [], []
    for _, group in groups(texts):
        n, found = view_features(group, VIEWS)
        votes.append(np.concatenate([lexicon_votes(found[v], n, x, min(VIEWS[v][0], len(x))) for v, x in lexicons.items()], 1))
        patterns.append(pattern_votes(group, n))
        doc, index, count = linear.ngram_features(group, bits, **{k: x for k, x in KINDS.items() if k != "scaled"})
        value = linear.values(doc, count, len(group), KINDS["scaled"]).astype(np.float32)
        rows += linear.rows_of(doc, index.astype(np.int32), value, len(group))
    columns = [np.concatenate(votes)]
    fired = np.concatenate(patterns)
    for k in range(fired.shape[1]):
        said = fired[known, k] == SAYS_TOXIC
        if said.sum() >= 5 and y[said].mean() > 0.5:
            columns.append(fired[:, k : k + 1])
    v = np.concatenate(columns, 1)
    report = {"lexicon": entries, "voters": 0, "rows": len(texts), "labelled": int(known.sum())}
    if v.shape[1]:
        model = LabelModel().fit(v, np.where((v == SAYS_TOXIC).sum(1) > min(1, v.shape[1] - 1), 0.9, 0.1))
        target = model.posterior(v)
        report |= {
            "voters": v.shape[1], "accuracies": model.accuracies(v), "parents": model.parent.tolist(), "prior": model.prior.round(4).tolist(),
            "differ": int(((target[known] > 0.5) != y).sum()),
        }
    else:
        target = np.full(len(texts), y.mean() if len(y) else 0.5)
    w = linear.Ftrl(bits, alpha=0.3, l1=2.0, l2=0.1).fit(rows, target, np.ones(len(rows)), epochs)
    return w, report


def train(sample: DataFrame, bits: int = BITS) -> tuple[np.ndarray, dict]:
    """fit() in one task over rows (doc_id, text, label); the sample is bounded."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": [], "label": []})])
        if not rows["label"].isin([0, 1]).any():
            return
        w, report = fit(rows["doc_id"].tolist(), rows["text"].tolist(), rows["label"].tolist(), bits)
        i = np.flatnonzero(w)
        yield pd.DataFrame({"i": np.append(i, -1), "w": np.append(w[i], 0.0), "report": [None] * len(i) + [json.dumps(report)]})

    learnt = sample.repartition(1).mapInPandas(one, "i long, w double, report string").toPandas()
    weights, report = np.zeros((1 << bits) + 1, np.float32), {}
    at = learnt["i"].to_numpy(np.int64)
    weights[at[at >= 0]] = learnt["w"].to_numpy()[at >= 0]
    for r in learnt["report"].dropna():
        report = json.loads(r)
    return weights, report


def score_documents(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """Every column of docs and ``score``, the probability that the text is toxic."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shipped.value
        for texts in batches:
            out = np.empty(len(texts))
            for first, group in groups(texts):
                out[first : first + len(group)] = linear.score(group, w, bits, **KINDS)
            yield pd.Series(out)

    return docs.withColumn("score", probability(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, unlabelled_rows: int = 6000, parts: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    weights, _ = train(labelled_sample(docs, labels, "toxic", parts, held_out, train_rows, unlabelled_rows))
    scored = score_documents(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
