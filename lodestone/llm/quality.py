"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Training reads a bounded, hash-chosen sample of labelled rows (``train_rows`` of them, none of more than
common.SAMPLE_BYTES bytes); scoring is one pass over whole texts, a long one piece by piece, with a
sparse dot product per document and no shuffle.

Defined results: a null or empty text has no features and gets the bias alone; a null doc_id is
scored and never held out; repeated rows are scored one by one; without any labelled row the
score is 0.5; null labels and labels other than 0 and 1 are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import fold, groups, labelled_sample

BITS = 18


def train(sample: DataFrame, bits: int = BITS, epochs: int = 4) -> np.ndarray:
    """Weights from rows (doc_id, text, label); one task holds the sample, which is bounded."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, targets, ids = [], [], []
        for batch in batches:
            for first, texts in groups(batch["text"]):
                doc, index, count = linear.ngram_features(texts, bits)
                rows += linear.rows_of(doc, index, linear.values(doc, count, len(texts)), len(texts))
            targets += batch["label"].tolist()
            ids += batch["doc_id"].astype(str).tolist()
        order = np.argsort(np.array(ids, object), kind="stable")
        rows, y = [rows[k] for k in order], np.array(targets, float)[order]
        if not len(y):
            return
        # both classes weigh alike up to a factor, so a rare class is not ignored
        share = np.clip(y.mean(), 0.05, 0.95)
        w = linear.Ftrl(bits).fit(rows, y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5, epochs)
        i = np.flatnonzero(w)
        yield pd.DataFrame({"i": i, "w": w[i]})

    learnt = sample.repartition(1).mapInPandas(fit, "i long, w double").toPandas()
    weights = np.zeros((1 << bits) + 1, np.float32)  # 1 MB at 18 bits, whatever the corpus
    weights[learnt["i"].to_numpy(np.int64)] = learnt["w"]
    return weights


def score_documents(docs: DataFrame, weights: np.ndarray, bits: int = BITS, name: str = "score") -> DataFrame:
    """Every column of docs and the probability of label 1 under ``name``, which replaces a column so named."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shipped.value
        for texts in batches:
            out = np.empty(len(texts))
            for first, group in groups(texts):
                out[first : first + len(group)] = linear.score(group, w, bits)
            yield pd.Series(out)

    return docs.withColumn(name, probability(F.col("text")))


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = 4000, parts: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    weights = train(labelled_sample(docs, labels, "quality", parts, held_out, train_rows))
    scored = score_documents(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
