"""Token counts against the library, quality rules and personal data against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from lodestone.llm import pii, rules, tokens
from lodestone.llm.queries import TOKENIZER

from .conftest import PROSE


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter49k(tokens.file_of(TOKENIZER))


def test_tokens_query(spark, frame, odd, counter):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(frame(odd, extra=True), tokens.file_of(TOKENIZER)).collect())
    want = []
    for i, t in odd:
        n = counter.by_library(t or "")
        want.append((i or -1, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert tokens.count_tokens(frame([]), tokens.file_of(TOKENIZER)).count() == 0


def test_each_proved_string_is_one_token(counter):
    assert len(counter.proved) > 30000
    assert all(counter.by_library(x) == 1 for x in sorted(counter.proved)[::97])


@settings(max_examples=300, deadline=None)
@given(s.one_of(s.text(), s.text(alphabet="abc'st dlrevm<|>endoftx 12ñéÉ́İßЖ…\x85\xa0\t\n"), s.just("it's <|endoftext|> <|startoftext|>x")))
def test_tokens_of_any_text(text):
    c = test_tokens_of_any_text.counter
    text = text.encode("utf-8", "ignore").decode()
    assert c.count([text]) == [c.by_library(text)]


test_tokens_of_any_text.counter = tokens.Counter49k(tokens.file_of(TOKENIZER))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_rules(spark, frame, odd):
    more = [(20, "same words again here for you all " * 9), (21, PROSE + "\n" + PROSE + "\nend\nend"), (22, "a # b | c <x> $5 & %\n" * 4), (23, "\n\n \nq\nq\n"), (24, "one two " * 400)]
    texts = dict(enumerate(t for _, t in odd + more))
    got = {r["doc_id"]: r for r in rules.apply_rules(frame(list(texts.items()), extra=True)).collect()}
    for i, t in texts.items():
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), (i, t and t[:50])
        assert not (r["base_failed"] and r["kept"])
    assert got[3]["kept"]
    assert rules.apply_rules(frame([])).count() == 0


def test_compression_bands(spark, frame):
    import random

    r = random.Random(5)
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(400))
    prose = " ".join("".join(r.choice(["an", "the", "or", "in", "ti", "on", "re", "st"]) for _ in range(r.randint(1, 3))) for _ in range(900))
    stutter = " ".join(x for k in range(60) for x in [f"word{k}"] * 7)
    half = prose + " " + " ".join(x for k in range(200) for x in [f"ab{k % 9}"] * 7)
    got = {x["doc_id"]: x["kept"] for x in rules.apply_rules(frame([(1, noise), (2, prose), (3, stutter), (4, half)])).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_rules_compare_words_by_value(spark, frame):
    # two words that polynomial hashes modulo powers of two cannot tell apart
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = {1: " ".join([one, *"cdefghi", other, *"cdefghi"]), 2: " ".join([one, *"cdefghi", one, *"cdefghi"]), 3: " ".join("abcdefgh"), 4: " ".join("aaaaaaaaa")}
    got = {r["doc_id"]: r["n_repeat_words"] for r in rules.apply_rules(frame(list(texts.items()))).collect()}
    assert got == {1: 0, 2: 16, 3: 0, 4: 9} == {i: base(t)[4] for i, t in texts.items()}


@settings(max_examples=200, deadline=None)
@given(s.text(alphabet="ab \n\t\x0bé#", max_size=80), s.integers(1, 7))
def test_counts_of_any_text_in_parts(text, part):
    import zstandard

    was, rules.PART = rules.PART, part
    try:
        n, chars, symbols, lines, repeats, *_ = rules.judge(text.encode(), zstandard.ZstdCompressor(level=3))
    finally:
        rules.PART = was
    assert (n, chars, symbols, lines, repeats) == base(text)[:5]


@settings(max_examples=200, deadline=None)
@given(s.text(alphabet="ab'st é́İΣσ中\n <|endoftx>", max_size=60), s.integers(1, 9))
def test_tokens_of_pieces(text, limit):
    c = test_tokens_of_any_text.counter
    parts = list(tokens.pieces(text, limit))
    assert "".join(parts) == text
    assert sum(c.count(parts)) == c.by_library(text)


def test_very_long_texts_in_bounded_memory():
    """50 MB of one text in a process of 3 GB."""
    import subprocess
    import sys

    code = """
import resource
resource.setrlimit(resource.RLIMIT_AS, (3 << 30, 3 << 30))
import numpy as np, zstandard
from lodestone.llm import linear, rules, tokens
r = np.random.default_rng(1)
text = b" ".join(b"w%d" % k for k in r.integers(0, 1 << 20, 6_500_000).tolist())
assert len(text) > 50_000_000
assert rules.judge(text, zstandard.ZstdCompressor(level=3))[0] == 6_500_000
w = np.ones((1 << 18) + 1, np.float32)
assert 0 <= linear.score([text], w, 18)[0] <= 1 and 0 <= linear.score([b"x" * 50_000_000], w, 18)[0] <= 1
assert sum(len(p) for _, part in tokens.batches_of([text.decode()]) for p in part) == len(text)
"""
    subprocess.run([sys.executable, "-c", code], check=True, env={"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PATH": "/usr/bin:/bin", "PYTHONPATH": sys.path[0]}, timeout=300)


KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in each) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def spans(text):
    out = [(m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(PATTERNS[k], text or "") if valid(k, m.group())]
    return sorted(out)


CASES = [
    "mail a.b+c@x-y.example.com, or x@y; a@b.c_d@e.f @@ q@r.s.t.",
    "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8.9 and 007.08.09.255 999999.1.1.1",
    "4111 1111 1111 1111; 4111-1111-1111-1112; 4111111111111111 1 2; 12 34",
    "+1 (017) 555-7713 or +44..........) or +123 or +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7",
    "😀😀 é +49 30 1234567 中文a@b.de 😀 10.0.0.1",
    "9" * 5000 + " " + "a" * 50000 + "@", "1" * 16 + " " * 3 + "+" * 500, "a.b" * 3000 + "@c.d",
]


def test_base_spans(spark, frame, odd):
    texts = dict(enumerate(CASES + [t for _, t in odd]))
    got = {r["doc_id"]: r for r in pii.personal_data(frame(list(texts.items()), extra=True)).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        want = spans(t)
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == n for x in want) for n in range(4)], t[:60]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (t[:60], text, r["spans"])
        assert set(text.split(",")) <= set(r["spans"].split(","))
    assert pii.personal_data(frame([])).count() == 0


@settings(max_examples=30, deadline=None)
@given(s.lists(s.text(alphabet="a1 .-@+()2\x01😀", max_size=60), min_size=1, max_size=20))
def test_base_spans_of_any_text(texts):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("c", pii._clean(F.col("text")))
    found = df.select("i", *[c.alias(k) for k, c in pii.base_spans(F.col("c")).items()]).collect()
    for r in found:
        got = sorted((m["start"], n, m["end"]) for n, k in enumerate(KINDS) for m in r[k])
        assert got == spans(texts[r["i"]]), texts[r["i"]]


def test_trees_add_spans_and_redact(spark, frame):
    # keys with their context teach the format; one without is found, prose is left alone
    docs = [(i, f'some words token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and a.user{i}@mail.example.org said so') for i in range(80)]
    docs += [(200, "a bare 0123456789abcdef0123456789abcdef01234567 here"), (201, PROSE), (202, None), (203, "")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(docs)).collect()}
    assert "secret:" in got[200] and got[201] == "" and got[0].count(":") == 4
    out = {r["doc_id"]: r["text"] for r in pii.redact(frame(docs, extra=True)).collect()}
    assert out[200] == "a bare [SECRET] here" and out[201] == PROSE and out[202] is None and out[203] == ""
    assert out[5] == 'some words token = "[SECRET]" and [EMAIL] said so'
    assert pii.redact(frame(docs, extra=True)).columns == frame(docs, extra=True).columns


#: Texts whose one candidate of a kind is the part in braces.
PROPOSED = {
    "email": [
        "write {JOHN [AT] EXAMPLE [DOT] COM}", "write {joe (At) site (Dot) org} now", "write {joe AT site DOT org}", "write {john at example.com}.", "{joe at site dot org}",
        "mail me at {john.doe [at] example [dot] com}", "mail me at {john.doe@example.com} now", "mail me at {john.doe at site.org} now", "{john at example.com} at noon", "{a@b} c",
    ],
    "ip": ["at {10.20.30.40}, so", "{1.2.3} x", "at {fe80:1:2:3} so"],
    "card": ["card {1234.5678-9012 3456} so"],
    "phone": [
        "call {+49 171 234 567} or", "call {171 234 567} or", "call {0171 234 5678}.", "call {0800 123 4567} or", "call {06 12345678} or", "call {030 1234567} or", "call {01712345678} or",
        "call {+491712345678} or", "call {0049 30 12 34 56 78} or", "call {06 12 34 56 78} or", "call {1(800) 555 0199} or", "call {(0171) 234 5678} or", "in 2024 or 123456 so",
    ],
    "secret": [
        "a {0123456789abcdef0123} b", "a {abcdefghij_ABCDEFGHI-0} b", "a {" + "0a" * 100 + "} b", "a {" + "0a" * 3000 + "} b", "a {" + "k" * 70 + "7} b", "a {abcdefghij+0123456789}. B",
        "token={wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY}", "a {/abcdefghij+ABCDEFGHI0} b", "token={0123456789abcdef0123}&x=1", "a {0123456789abcdef0123/x==} b",
        "a word/or/two/of/prose b", "a short.0123456789 b", "a short=0123456789 b",
    ],
}


def proposed(spark, texts, kind):
    """The texts of the candidates of a kind, by text."""
    from pyspark.sql import functions as F

    df = pii.scan(spark.createDataFrame([(t,) for t in texts], "text string"))
    found = df.select("row.text", F.filter("candidates", lambda c: c["kind"] == pii.KINDS.index(kind)).alias("c")).collect()
    # generators of one kind may propose spans that overlap
    return {r["text"]: [r["text"][c["start"] : c["end"]] for c in r["c"]] for r in found}


@pytest.mark.parametrize("kind", PROPOSED)
def test_generators_propose(spark, kind):
    want = {re.sub("[{}]", "", t): re.findall("{(.*?)}", t) for t in PROPOSED[kind]}
    assert proposed(spark, want, kind) == want


def test_keys_with_dots_and_padding_are_also_proposed_whole(spark):
    pieces = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(3)]
    dotted, padded = ".".join(pieces), f"{pieces[0]}=="
    got = proposed(spark, [f"a {dotted} b", f"a {padded} b"], "secret")
    assert got[f"a {dotted} b"] == [*pieces, dotted] and got[f"a {padded} b"] == [pieces[0], padded]


def test_base64_keys_and_long_keys_are_redacted(spark, frame):
    import base64

    key = lambda i, n: base64.b64encode(hashlib.shake_128(str(i).encode()).digest(n)).decode().rstrip("=")
    keys = [key(i, n) for i in range(60) for n in (30, 150)]
    assert sum("/" in k for k in keys) > 40 and max(map(len, keys)) > 128
    docs = [(i, f'some words token = "{k}" said so') for i, k in enumerate(keys)] + [(900, f"a bare {key(901, 150)} here"), (901, PROSE)]
    out = {r["doc_id"]: r["text"] for r in pii.redact(frame(docs)).collect()}
    assert [out[i] for i in range(len(keys))] == ['some words token = "[SECRET]" said so'] * len(keys)
    assert out[900] == "a bare [SECRET] here" and out[901] == PROSE


def test_pretests_pass_all_matches(spark):
    from pyspark.sql import functions as F

    pieces = ["@", " at ", " AT ", "[at]", "( At )", " dot ", " DOT ", "(dot)", ".", "a", "joe", "X9", "7", "12", "0123", "99999", "123456789012", "k" * 20, " ", "-", "/", ":", "+", "(", ")", "=", "_"]
    rnd = random.Random(4)
    few = [rnd.sample(pieces, rnd.randint(2, 4)) for _ in range(20000)]
    df = spark.createDataFrame([("".join(rnd.choice(p) for _ in range(rnd.randint(3, 16))),) for p in few], "t string").cache()
    for name, pattern in pii.GENERATORS.items():
        matched = df.where(F.col("t").rlike(pattern))
        assert matched.count() > 0, name
        for p in pii._NEEDS[name]:
            assert [r["t"] for r in matched.where(~F.col("t").rlike(p)).collect()] == [], (name, p)


def test_boosted_column_equals_trees(spark):
    from pyspark.sql import functions as F

    from lodestone.llm import boosting

    rows = [((a, b), 10.0 * (a > 2) * (b < 3) + 1, 5.0 * (a <= 2) + 1) for a in range(6) for b in range(5)]
    model = boosting.fit(rows, 0.6)
    df = spark.createDataFrame([r[0] for r in rows], "a int, b int").select("a", "b", model.column([F.col("a"), F.col("b")]).alias("p"))
    assert all(abs(r["p"] - model.probability((r["a"], r["b"]))) < 1e-9 for r in df.collect())
    assert model.probability((5, 0)) > 0.8 > 0.4 > model.probability((0, 0))
    assert boosting.fit([], 0.9).threshold > 1


def test_added_spans_are_learnt(spark, frame):
    """Written-out addresses, numbers without a plus sign and cards with dots are found; look-alikes are left alone."""
    r = random.Random(9)
    name = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 8)))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        n = "4" + d(14)
        last = next(c for c in "0123456789" if valid("card", n + c))
        n += last
        return ".".join(n[i : i + 4] for i in range(0, 16, 4))

    docs = []
    for i in range(160):
        docs.append((i, f"mail {name()}@{name()}.com or {name()} [at] {name()} [dot] com so, call +1 ({d(3)}) 555-{d(4)} or call {d(3)} 555 {d(4)} or visa {card()} of order {d(3)} {d(3)} {d(4)}, version 1.2.{r.randint(0, 9)}.4.5 on 2024-05-{r.randint(10, 28)}"))
    docs += [(500, "write to anna [at] garden [dot] org please"), (501, "you may call 030 555 1234 today"), (502, "we look at things 2024-05-11 and 1.2.3.4.5 of order 555 123 4567 only"), (503, PROSE)]
    got = {x["doc_id"]: x["spans"] for x in pii.personal_data(frame(docs)).collect()}
    assert got[500] == "email:9:35" and got[501] == "phone:13:25" and got[503] == ""
    assert got[502] == "ip:33:40"  # a base span, within a longer number
    for i, t in docs[:160]:
        kinds = Counter(x.split(":")[0] for x in got[i].split(","))
        assert kinds == {"email": 2, "phone": 2, "card": 1, "ip": 1}, (t, got[i])


def selected(candidates, base):
    """Which candidates (start, end, p, kind) are added: none that meets a base span, then from left to right."""
    free = sorted(c for c in candidates if c[2] > 0 and not any(c[0] < b[2] and c[1] > b[0] for b in base))
    out = []
    for c in free:
        if not out or c[0] >= out[-1][1]:
            out.append(c)
        elif c[2] > out[-1][2] or (c[2] == out[-1][2] and c[1] - c[0] > out[-1][1] - out[-1][0]):
            out[-1] = c
    return sorted([*base, *[(a, k, b) for a, b, _, k in out]])


def test_added_spans_equal_brute_force(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    texts = ["".join(r.choice(["joe [at] x.org", "a@b.com", " 030 555 1234", " +49 30 5551234", "1.2.3.4", ".5", " call ", "4111 1111 1111 1111", "0123456789abcdef0123", " ", ", ", "token="]) for _ in range(r.randint(1, 14))) for _ in range(300)]
    scanned = pii.scan(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    tree = pii.boosting.Split(0, 10, pii.boosting.Leaf(1.0), pii.boosting.Split(4, 0, pii.boosting.Leaf(0.5), pii.boosting.Leaf(2.0)))
    models = {k: pii.boosting.Boosted(0.1 * i, [tree], 0.2 if k != "ip" else 0.9) for i, k in enumerate(pii.KINDS)}
    got = {x["row"]["text"]: [tuple(y) for y in x["spans"]] for x in pii.select(scanned, models).collect()}
    n_added = 0
    for x in scanned.collect():
        found = spans(x["row"]["text"])
        assert [tuple(b) for b in x["base"]] == found
        candidates = []
        for c in x["candidates"]:
            own = any(b[1] == c["kind"] and b[0] < c["end"] and b[2] > c["start"] for b in found)
            meets = any(b[0] < c["end"] and b[2] > c["start"] for b in found)
            assert c["meets"] == meets and c["label"] == (1 if own else 0 if meets else c["named"])
            m = models[pii.KINDS[c["kind"]]]
            p = m.probability(tuple(c[f] for f in pii.FEATURES))
            candidates.append((c["start"], c["end"], p if p >= m.threshold else -1, c["kind"]))
        assert got[x["row"]["text"]] == selected(candidates, found)
        n_added += len(got[x["row"]["text"]]) - len(found)
    assert n_added > 100
    scanned.unpersist()


def test_many_spans_in_one_text(spark, frame):
    """50,000 spans in one text take seconds, found and replaced."""
    import time

    text = " ".join(f"user{i}@mail.example.org so" for i in range(50_000))
    began = time.time()
    (row,) = pii.personal_data(frame([(1, text)])).collect()
    (out,) = pii.redact(frame([(1, text)])).collect()
    assert row["n_email"] == 50_000 and out["text"] == " ".join(["[EMAIL] so"] * 50_000)
    assert time.time() - began < 60


def test_names_that_clash(spark):
    """A caller's columns may be called like our own."""
    from pyspark.sql import functions as F

    from lodestone.llm import decontam, mixing, quality, queries, simhash, toxicity

    docs = spark.createDataFrame([(1, PROSE, "en", "src1"), (2, PROSE, "en", "src1"), (3, "mail a@b.com", "de", "src2"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    for c in ("__n", "__id", "__hash", "__k1", "__k2", "__base", "__spans", "__candidates", "__found", "__t", "__0", "__key", "__bucket", "row", "base", "clean", "part", "spans", "f", "chosen", "__quality", "n"):
        docs = docs.withColumn(c, F.lit(c))
    bench = spark.createDataFrame([(1, "no such words are in any of these")], "item_id long, text string")
    own = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    assert [r.asDict() for r in decontam.without_leaks(docs, bench).orderBy("doc_id").collect()] == own
    assert [r.asDict() | {"text": None} for r in pii.redact(docs).orderBy("doc_id").collect()] == [r | {"text": None} for r in own]
    assert [r.asDict() for r in simhash.one_of_each(docs).orderBy("doc_id").collect()] == [own[0], own[1], own[3]]
    drawn = mixing.draw(queries.with_domain(docs), share=(10, 1), max_epochs=1).collect()
    assert {r["doc_id"] for r in drawn} == {1, 2, 3} and all(r["__n"] == "__n" and r["__key"] == "__key" for r in drawn)
    for out in (rules.apply_rules(docs), tokens.count_tokens(docs, tokens.file_of(TOKENIZER)), quality.score_documents(docs, __import__("numpy").zeros((1 << 18) + 1)), toxicity.score_documents(docs, __import__("numpy").zeros((1 << 18) + 1))):
        assert all(r["__found"] == "__found" and r["row"] == "row" for r in out.collect())
