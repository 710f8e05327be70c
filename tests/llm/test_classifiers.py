"""Quality and toxicity: held-out accuracy, and defined results for odd inputs."""

import random
import zlib

import pytest

from lodestone.llm import linear, quality, toxicity
from lodestone.llm.common import groups

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        bad, toxic = r.random() < 0.3, r.random() < 0.25
        if bad:
            w = [x + r.choice(["$$$", "###", "%%%"]) for x in w]
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["grubbly", "snarkhead", "vilefoot"]) + r.choice(["", "s", "ing"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.mark.parametrize("run, label, parts, out", [(quality.quality, 1, 3, 1), (toxicity.toxicity, 2, 5, 0)])
def test_held_out_accuracy(spark, frame, run, label, parts, out):
    docs, labels = corpus()
    truth = {x[0]: x[label] for x in labels}
    got = run(frame(docs, extra=True), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == out) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_odd_input(spark, frame, odd, run):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (2, 0, 1), (None, 1, 1), (5, None, None), (6, 7, 7)], LABELS)
    got = run(frame(odd), labels).collect()
    assert len(got) == len(odd) and all(r["score"] is not None for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == 1  # equal texts score alike
    assert run(frame([]), labels).count() == 0
    assert {r["score"] for r in run(frame(odd), spark.createDataFrame([], LABELS)).collect()} == {0.5}


def test_scores_do_not_depend_on_grouping():
    docs, _ = corpus(40)
    texts = [t for _, t in docs]
    import numpy as np

    w = np.random.default_rng(1).normal(size=(1 << 18) + 1)
    one = [linear.score([t.encode()], w, 18)[0] for t in texts]
    many = [x for _, g in groups(texts, 500) for x in linear.score(g, w, 18)]
    assert np.allclose(one, many)


def test_label_model_finds_accuracies_and_a_dependence():
    import numpy as np

    r = np.random.default_rng(0)
    y = (r.random(4000) < 0.3).astype(int)

    def voter(accuracy, abstains):
        v = np.where(r.random(4000) < accuracy, y, 1 - y)
        return np.where(r.random(4000) < abstains, 2, v)

    rates = [0.9, 0.75, 0.85, 0.8, 0.88, 0.7]
    single = [voter(x, 0.15) for x in rates]
    copy = np.where(r.random(4000) < 0.95, single[1], 2)  # the second again, nearly
    v = np.stack([*single, copy], 1).astype(np.int8)
    start = np.clip((v == 1).sum(1) / np.maximum(1, (v < 2).sum(1)), 0.1, 0.9)
    model = toxicity.LabelModel().fit(v, start)
    found = model.accuracies(v)
    assert all(abs(x - y) < 0.05 for x, y in zip(found, rates)), found
    pairs = {frozenset((i, int(p))) for i, p in enumerate(model.parent) if p >= 0}
    assert frozenset((1, 6)) in pairs
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.93


# --- brute force: the same definitions, one number at a time ---

M = (1 << 64) - 1


def finalised(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def hashed(word):
    base, out = 0x9E3779B97F4A7C15, 0
    for k, b in enumerate(word):
        out += (b + 1) * pow(base, k, 1 << 64)
    return finalised(out & M)


def kinds_of(word):
    out = 0
    for b in word:
        out |= 1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 4 if 48 <= b < 58 else 8 if b >= 128 else 16 << b % 8
    return out


def plain_features(text, bits):
    """Counts by index of words, pairs of words, and kinds of words, of pairs and of triples."""
    from collections import Counter

    raw = text.split()
    words = [bytes(b + 32 if 65 <= b < 91 else b for b in w) for w in raw]
    h = [hashed(w) for w in words]
    k = [kinds_of(w) * 2 + (i > 0 and words[i] == words[i - 1]) for i, w in enumerate(raw)]
    out = Counter(x & (1 << bits) - 1 for x in h)
    for seq, n, salt in ((h, 2, 2), (k, 1, 11), (k, 2, 12), (k, 3, 13)):
        for i in range(len(seq) - n + 1):
            key = salt
            for x in seq[i : i + n]:
                key = finalised((key * 31 + x) & M)
            out[key & (1 << bits) - 1] += 1
    return out


TEXTS = [b"The cat sat sat on THE mat, x9 \xc3\xa9t\xc3\xa9!", b"", b" one ", b"a b\tc\nd a b", "ß 中文 $$$ ### 12 1,2".encode(), b"w " * 40]


def test_features_equal_brute_force():
    for limit in (1 << 20, 7, 3):  # whole, and in pieces
        doc, index, count = linear.ngram_features(TEXTS, 16, limit=limit)
        got = [{} for _ in TEXTS]
        for d, i, c in zip(doc.tolist(), index.tolist(), count.tolist()):
            got[d][i] = c
        if limit > 7:
            assert got == [dict(plain_features(t, 16)) for t in TEXTS]
        elif limit == 7:  # no word but the long ones is cut
            short = [k for k, t in enumerate(TEXTS) if all(len(w) < 7 for w in t.split())]
            assert len(short) >= 4 and all(got[k] == dict(plain_features(TEXTS[k], 16)) for k in short)


def test_ftrl_and_score_equal_brute_force():
    import math

    import numpy as np

    r, bits = random.Random(4), 10
    texts = [" ".join(r.choice(["good", "fine", "bad$", "awful#", "the", "a"]) for _ in range(12)).encode() for _ in range(40)]
    y = [float(b"bad" in t) for t in texts]
    doc, index, count = linear.ngram_features(texts, bits)
    rows = linear.rows_of(doc, index, linear.values(doc, count, len(texts)), len(texts))
    model = linear.Ftrl(bits, alpha=0.7, beta=1.0, l1=0.05, l2=0.2)
    got = model.fit(rows, y, np.ones(40), 2)

    z, n = [0.0] * ((1 << bits) + 1), [0.0] * ((1 << bits) + 1)

    def weight(i):
        if abs(z[i]) <= 0.05:
            return 0.0
        return -(z[i] - math.copysign(0.05, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.7 + 0.2)

    def valued(t):
        v = {i: math.log1p(c) for i, c in plain_features(t, bits).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {i: x / norm for i, x in v.items()}

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(40):
            x = valued(texts[k]) | {1 << bits: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            before = {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - y[k]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * before[i]
                n[i] += g * g
    want = [weight(i) for i in range((1 << bits) + 1)]
    assert np.allclose(got, want, atol=1e-9) and any(abs(w) > 0.1 for w in want)
    scores = linear.score(texts, got, bits)
    for t, s in zip(texts, scores):
        assert abs(s - 1 / (1 + math.exp(-sum(want[i] * v for i, v in valued(t).items()) - want[-1]))) < 1e-6


def test_posterior_equals_brute_force():
    import numpy as np

    r = np.random.default_rng(2)
    v = r.integers(0, 3, (200, 5)).astype(np.int8)
    model = toxicity.LabelModel().fit(v, np.where((v == 1).sum(1) > 1, 0.9, 0.1), rounds=3)
    got = model.posterior(v)
    for row, p in zip(v, got):
        like = [float(x) for x in model.prior]
        for c in (0, 1):
            for j, vote in enumerate(row):
                up = row[model.parent[j]] if model.parent[j] >= 0 else 0
                like[c] *= model.tables[j, c, up, vote]
        assert abs(p - like[1] / sum(like)) < 1e-9


def test_unlabelled_rows_vote_and_labels_do_not_anchor():
    """The label model sees votes only: a wrong label of a plainly toxic text does not move its posterior."""
    docs, labels = corpus(500)
    ids, texts, y = [d for d, _ in docs], [t for _, t in docs], [x[2] for x in labels]
    wrong = next(i for i, x in enumerate(y) if x == 1)
    some = [x if i % 3 else -1 for i, x in enumerate(y)]
    some[wrong] = 0
    _, report = toxicity.fit(ids, texts, some)
    assert report["rows"] == 500 and report["labelled"] == sum(x >= 0 for x in some) < 400
    assert 1 <= report["differ"] <= 12 and report["voters"] >= 4


def test_text_ids_and_long_labelled_texts(spark):
    from lodestone.llm.common import SAMPLE_BYTES, labelled_sample

    docs, labels = corpus(90)
    df = spark.createDataFrame([(f"id-{i}", t) for i, t in docs] + [("long", "word " * SAMPLE_BYTES)], "doc_id string, text string")
    lab = spark.createDataFrame([(f"id-{i}", q, t) for i, q, t in labels] + [("long", 1, 1)], "doc_id string, quality int, toxic int")
    for run in (quality.quality, toxicity.toxicity):
        assert run(df, lab).count() == 91
    sample = labelled_sample(df, lab.limit(40), "toxic", 5, 0, 10, 10).collect()
    assert sum(r["label"] is not None for r in sample) <= 10 and sum(r["label"] is None for r in sample) <= 10
    assert all(zlib.crc32(r["doc_id"].encode()) % 5 != 0 for r in sample) and "long" not in {r["doc_id"] for r in sample}
