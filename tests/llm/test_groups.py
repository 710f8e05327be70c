"""SimHash groups, decontamination, mixing, archives and url filters against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from lodestone.llm import components, decontam, mixing, queries, simhash, urls, warc

from .conftest import PROSE


# --- simhash ---


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(docs):
    """doc index -> smallest id of its component, by all pairs."""
    fps = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    return fps, [min(least[find(i)], default=None) for i in range(len(docs))], [find(i) for i in range(len(docs))]


def near_corpus():
    r = random.Random(1)
    vocabulary = [f"v{i}" for i in range(300)]
    docs = []
    for g in range(25):
        w = [r.choice(vocabulary) for _ in range(r.randint(60, 300))]
        for c in range(8):
            docs.append((len(docs) * 7 % 1009, " ".join(w)))
            w = list(w)
            w[r.randrange(len(w))] = r.choice(vocabulary)
    return docs


def test_simhash_components(spark, frame, odd):
    docs = near_corpus() + [(2000 + (i or 50), t) if i else (None, t) for i, t in odd]
    fps, ids, _ = classes(docs)
    got = simhash.near_duplicates(frame(docs, extra=True)).select("doc_id", "fingerprint", "component_id").collect()
    want = Counter((d, f - (1 << 64) if f >> 63 else f, c) for (d, _), f, c in zip(docs, fps, ids))
    assert Counter(map(tuple, got)) == want
    assert len({c for c in ids}) < len({f for f in fps})  # links join different fingerprints
    assert simhash.near_duplicates(frame([])).count() == 0


def test_links_within_radius(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(150)]
    points = set(base)
    for b in base:
        for k in range(6):
            x = b
            for bit in r.sample(range(64), k):
                x ^= 1 << bit
            points.add(x)
    points = [0, (1 << 64) - 1, *sorted(points)]
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    got = {(a["u"], a["v"]) for a in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(points)) for j in range(i) if 0 < (points[i] ^ points[j]).bit_count() <= 3}
    assert got == want


def test_manhattan_is_a_lower_bound(spark):
    r = random.Random(3)
    pairs = [(r.getrandbits(63), r.getrandbits(63)) for _ in range(200)] + [(-1, 0), (-1, 1 << 62)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "x long, y long").select("x", "y", simhash.segment_counts(F.col("x")).alias("a"), simhash.segment_counts(F.col("y")).alias("b"))
    for row in df.withColumn("d", simhash.manhattan("a", "b")).collect():
        counts = lambda v: [((v >> k) & 3).bit_count() for k in range(0, 64, 2)]
        want = sum(abs(p - q) for p, q in zip(counts(row["x"]), counts(row["y"])))
        assert row["d"] == want <= ((row["x"] ^ row["y"]) & ((1 << 64) - 1)).bit_count()


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, 2000 + i) for i in range(500)]
    df = spark.createDataFrame(path + hub + [(7, 7)], "u long, v long")
    got = dict(map(tuple, components.components(df).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {1000: 1000} | {2000 + i: 1000 for i in range(500)}


def test_one_of_each(spark, frame, odd):
    docs = near_corpus() + odd
    _, _, group = classes(docs)
    out = simhash.one_of_each(frame(docs, extra=True))
    assert out.columns == frame([], extra=True).columns
    kept = out.select("doc_id", "text").collect()
    assert len(kept) == len(set(group))
    where = {(d, t): g for (d, t), g in zip(docs, group)}
    assert len({where[tuple(k)] for k in kept}) == len(kept)
    for k in kept:
        ids = [d for (d, _), g in zip(docs, group) if g == where[tuple(k)] and d is not None]
        assert k["doc_id"] == min(ids, default=None)


# --- decontamination ---


def leak_table(docs, items, least=0.8):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bag = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = {}
    for d, t in docs:
        s = bag(cut(t))
        for i, x in items:
            b = bag(cut(x))
            for a in range(max(1, len(s) - len(b) + 1)) if b and s else ():
                p, q = Counter(s[a : a + len(b)]), Counter(b)
                j = sum((p & q).values()) / sum((p | q).values())
                if j >= least:
                    out[d, i] = max(out.get((d, i), 0), j)
    return out


def test_leaks(spark, frame, odd):
    r = random.Random(4)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.randint(0, 60)}" for _ in range(n)]
    items = [(i, " ".join(words(r.choice([5, 9, 20, 45, 60])))) for i in range(30)]
    items += [(100, items[3][1].upper()), (101, "too short"), (102, None), (103, ""), (104, " ".join(["again and"] * 15))]
    docs = []
    for k in range(120):
        i, x = items[r.randrange(30)]
        w = x.split()
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = "zz"
        if r.random() < 0.2:
            w.insert(r.randrange(len(w)), "yy")
        docs.append((k, ", ".join(words(r.randint(0, 80)) + w + words(r.randint(0, 80)))))
    docs += [(500 + k, " ".join(words(120))) for k in range(30)] + [(600, "again and " * 40)]
    docs += [(700 + (i or 50), t) for i, t in odd] + [(None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontam.leaks(frame(docs, extra=True), bench).collect()}
    want = leak_table(docs, items)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any(0.8 <= v < 1 for v in want.values()) and (600, 104) in want and (None, 5) in want
    kept = decontam.without_leaks(frame(docs, extra=True), bench)
    assert kept.columns == frame([], extra=True).columns
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(d for d, _ in docs if not any(d == a for a, _ in want))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(frame(docs), empty).count() == 0 and decontam.leaks(frame([]), bench).count() == 0
    assert decontam.without_leaks(frame(docs), empty).count() == len(docs)


def test_leaks_of_repetitive_and_short_items(spark, frame):
    # at the limit of 0.8: eight of nine shingles by two words in turn, and the first four of five
    items = [(i, f"p{i} q{i} " * 6 + f"z{i}") for i in range(80)] + [(100 + i, " ".join(f"s{i}x{k}" for k in range(9))) for i in range(80)]
    docs = [(i, f"p{i} q{i} " * 6 + "y" + str(i)) for i in range(80)] + [(100 + i, " ".join(f"s{i}x{k}" for k in range(8))) for i in range(80)]
    # and a window with a repeated shingle against items without any
    items += [(200 + i, " ".join(f"r{i}x{k}" for k in range(104))) for i in range(8)]
    docs += [(200 + i, " ".join(f"r{i}x{k}" for k in range(95)) + f" r{i}" * 13) for i in range(8)]
    want = leak_table(docs, items)
    assert len(want) >= 160
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_in_another_order(spark, frame):
    """Swapped halves, moved blocks, a passage twice and passages of scattered parts."""
    r = random.Random(7)
    words = lambda n, v=3000: [f"t{r.randrange(v)}" for _ in range(n)]
    items = [(i, words(r.choice([30, 60, 90, 130]))) for i in range(25)]
    items += [(100 + i, words(40, 6)) for i in range(5)] + [(200, ["lone"]), (201, "only four words here".split())]
    docs = []
    for k in range(150):
        _, w = items[r.randrange(30)]
        cuts = sorted(r.sample(range(len(w)), r.choice([1, 1, 2, 3])))
        parts = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)])]
        r.shuffle(parts)
        body = [x for p in parts for x in p + words(r.choice([0, 0, 0, 1, 3]))]
        docs.append((k, words(r.randint(0, 60)) + body * r.choice([1, 1, 2]) + words(r.randint(0, 60))))
    docs += [(900, ["Lone!"]), (901, ["lone", "wolf"]), (902, "Only four, words here".split()), (903, "so only four words here".split())]
    docs, items = [(d, " ".join(w)) for d, w in docs], [(i, " ".join(w)) for i, w in items]
    want = leak_table(docs, items)
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontam.leaks(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > 60 and (900, 200) in want and (902, 201) in want and (901, 200) not in want


def test_fingerprints_of_bags(spark):
    from pyspark.sql import functions as F

    r = random.Random(11)
    bags = [[r.getrandbits(64) - (1 << 63) for _ in range(n)] * k for n, k in ((1, 1), (2, 1), (7, 3), (50, 1), (300, 1), (1000, 70))]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(bags)], "i int, b array<long>").select("i", decontam.fingerprint(F.col("b")).alias("f")).collect()
    for row in got:
        b = bags[row["i"]]
        want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in b) > len(b))
        assert row["f"] % (1 << 64) == want


def test_blocks_reach_the_radius(spark):
    """Every fingerprint within RADIUS shares a near value of some block."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = []
    for n in range(60):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, decontam.RADIUS)):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long").select(
        decontam._near_values(F.col("a")).alias("near"), F.array(*[F.struct(F.lit(k).alias("block"), decontam._block(F.col("b"), k).alias("value")) for k in range(decontam.BLOCKS)]).alias("own")
    )
    assert df.where(~F.exists("own", lambda o: F.array_contains("near", o))).count() == 0


# --- mixing ---


def test_budgets(spark):
    """Shortages go to siblings before they reach other families."""
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 30), ("b", "y", 30), ("c", "x", 1000)], "d string, l string, tokens long")
    from pyspark.sql import functions as F

    got = {(r["d"], r["l"]): r["budget"] for r in mixing.budgets(leaves, ["d", "l"], {"d": {"a": 2}}, lambda total: F.lit(400), 1).collect()}
    # a : b : c = 2 : 1 : 1 of 400; b holds 60 only, its 40 go 2 : 1 to a and c; within a, x is short
    assert got == {("a", "x"): 10, ("a", "y"): 216, ("b", "x"): 30, ("b", "y"): 30, ("c", "x"): 113}


def test_mixing_equals_sql(spark, frame, odd):
    r = random.Random(6)
    docs = [(i, " ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(0, 60)))) for i in range(400)] + odd
    df = frame(docs, extra=True).drop("epoch", "n_tokens")
    drawn = mixing.draw(queries.with_domain(df), weights=queries.MIX_WEIGHTS, share=(7, 5), max_epochs=3, keep_text=False)
    assert "text" not in drawn.columns and "words" in drawn.columns
    got = Counter(map(tuple, drawn.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch").collect()))
    c = duckdb.connect()
    rows = df.select("doc_id", "text", "lang", "source").toPandas()
    rows["doc_id"] = rows["doc_id"].astype("Int64")
    c.register("documents", rows)
    sql = mixing.oracle("documents", queries.DOMAIN_SQL, queries.MIX_WEIGHTS, (7, 5), 3, 42)
    want = Counter(c.sql(f"SELECT doc_id, domain, lang, source, n_tokens, epoch FROM ({sql})").fetchall())
    assert got == want and sum(got.values()) > 300
    assert mixing.draw(queries.with_domain(frame([]))).count() == 0
    everything = mixing.draw(queries.with_domain(frame(docs)), share=(100, 1), max_epochs=2)
    assert everything.count() == 2 * sum(bool(t and t.split()) for _, t in docs)


# --- archives ---


def pages():
    long = "<p>" + "many words " * 200 + "</p>"
    return [(1, "http://a.com/", long), (2, "http://b.com/", long), (9, "http://c.com/", long), (9, "http://c.com/", long), (3, "http://d.com/", "short"),
            (4, None, "short"), (5, "x", None), (6, "y", ""), (None, "http://n.com/", long), (None, None, "é" * 600), (7, "http://e.com/\r\n%0A", "ü\r\n\r\n" * 300), (8, "big", "z" * 3_000_000)]


PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = pages()
    got = Counter(map(tuple, warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()))
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = max((j for j, _, x in rows if (x or "").encode() == b and j is not None), default=None)
        revisit = len(b) >= 1000 and first is not None and first != i
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert got == want
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_give_back_payloads_and_headers(spark, tmp_path):
    rows = pages()
    path = warc.write_pages(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    back = warc.read_archives(spark, path)
    full = {(r["record_id"], r["target_uri"]): r for r in back.where("record_type = 'response'").collect()}
    assert bytes(full["<urn:page:7>", "http://e.com/\r\n%0A"]["payload"]).decode() == "ü\r\n\r\n" * 300
    assert bytes(full["<urn:page:8>", "big"]["payload"]) == b"z" * 3_000_000
    assert warc.read_archives(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    some = back.where("record_type = 'revisit' AND target_uri LIKE 'http://a%' AND record_id IN ('<urn:page:1>', '<urn:page:2>')")
    assert [r["refers_to"] for r in some.collect()] == ["<urn:page:9>"]
    assert back.where("payload_digest IS NOT NULL").count() == len(rows)


def test_reader_takes_header_predicates_and_skips_payloads(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rows = [{"record_type": "response", "record_id": f"<urn:page:{i}>", "refers_to": None, "target_uri": f"u{i}", "date": None, "payload_digest": None, "payload_bytes": 500_000,
             "payload": random.Random(i).randbytes(500_000)} for i in range(20)]
    plain = tmp_path / "part-x.warc.gz"
    plain.write_bytes(b"".join(warc.member(warc.record(r)) for r in rows))
    reader = warc.WarcReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("target_uri",), "u3"), GreaterThan(("payload_bytes",), 5), In(("record_type",), ("response",))]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    (part,) = reader.partitions()
    batch = [x for b in reader.read(part) for x in b.to_pylist()]
    assert [x["payload"] for x in batch] == [rows[3]["payload"]]

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            out = self.f.read(n)
            self.n += len(out)
            return out

    with plain.open("rb") as f:
        counting = Counting(f)
        source, at = warc.Source(counting, 1 << 12), 0
        while at < plain.stat().st_size:
            one = warc.Member(source, at)
            one.until(b"\r\n\r\n")
            at = one.end()
        assert counting.n < 0.2 * plain.stat().st_size  # skipped members were not even read


def test_reader_takes_gzip_members_of_others(tmp_path):
    import gzip

    row = {"record_type": "response", "record_id": "<urn:page:1>", "refers_to": None, "target_uri": "u", "date": None, "payload_digest": None, "payload_bytes": 5, "payload": b"hello"}
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(warc.record(row)) * 3)
    found = [r["payload"] for r in warc.read_file(str(tmp_path / "a.warc.gz"), lambda r: True, True)]
    assert found == [b"hello"] * 3


def test_members_with_many_records(tmp_path):
    import gzip

    sizes = [5, 0, 300_000, 70_000, 4]
    rows = [{"record_type": "response", "record_id": f"<urn:page:{i}>", "refers_to": None, "target_uri": f"u{i}", "date": "2026-01-02T03:04:05Z", "payload_digest": None,
             "payload_bytes": n, "payload": random.Random(i).randbytes(n)} for i, n in enumerate(sizes)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(b"".join(map(warc.record, rows))) + warc.member(warc.record(rows[2])) + gzip.compress(b"") + gzip.compress(warc.record(rows[0])))
    found = lambda accept, payload: list(warc.read_file(str(path), accept, payload))
    all_rows = found(lambda r: True, True)
    assert [r["payload"] for r in all_rows] == [r["payload"] for r in [*rows, rows[2], rows[0]]]
    assert {r["date"] for r in all_rows} == {"2026-01-02T03:04:05Z"}
    assert [r["payload"] for r in found(lambda r: r["target_uri"] == "u3", True)] == [rows[3]["payload"]]
    assert [(r["payload_bytes"], r["payload"]) for r in found(lambda r: True, False)] == [(n, None) for n in [*sizes, sizes[2], sizes[0]]]
    with pytest.raises(ValueError):
        path.write_bytes(path.read_bytes()[:-200_000])
        found(lambda r: True, True)


def test_partitions_grow_with_bytes(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(800)), lambda i: F.sha2((i * 1000 + F.col("id")).cast("string"), 256))).alias("html"))
    path = warc.write_pages(pages.coalesce(1), str(tmp_path / "w"))
    many = warc.WarcReader({"path": path, "partition_bytes": 1 << 20}).partitions()
    assert len(many) > 3 and len({r[0] for p in many for r in p.ranges}) == 1
    ids = [row["record_id"] for p in many for b in warc.WarcReader({"path": path}).read(p) for row in b.to_pylist()]
    assert sorted(ids) == sorted(f"<urn:page:{i}>" for i in range(300))
    dates = {r["date"] for r in warc.read_archives(spark, path, payload=False).select("date").distinct().collect()}
    assert len(dates) == 1 and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", dates.pop())


# --- urls ---


def test_hosts_paths_and_rules(spark):
    rows = [(1, "https://WWW.Example.com/en/1?x#y", None), (2, "http://sub.example.com/en/", ""), (3, "http://example.com", "x"), (4, None, None), (5, "no scheme/en/", "x"),
            (6, "ftp://a.net/es/1", ""), (7, "http://a.net/de/1", ""), (8, "http://notexample.com/en/", ""), (9, "http://x.org?q=://y.com/z", ""), (1, "https://WWW.Example.com/en/1?x#y", None), (None, "http://a.net/fr/", None)]
    got = sorted((tuple(r)[:5] for r in urls.judge(spark.createDataFrame(rows, PAGES), queries.URL_RULES).collect()), key=str)
    assert got == sorted([
        (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (2, "sub.example.com", "/en/", "example.com/en/", "block"), (3, "example.com", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "a.net", "/es/1", "net/es/", "block"), (7, "a.net", "/de/1", None, "block"), (8, "notexample.com", "/en/", "com/", "allow"),
        (9, "x.org", "", None, "allow"), (None, "a.net", "/fr/", "net/fr/", "block"),
    ], key=str)
    assert urls.judge(spark.createDataFrame([], PAGES), queries.URL_RULES).count() == 0


def test_link_graph_equals_sql(spark):
    r = random.Random(8)
    hosts = [f"h{i}.{r.choice(['com', 'net', 'org', 'example.com'])}" for i in range(25)]
    rows = []
    for i in range(300):
        links = "".join(f'<a class=q href="{r.choice(["http://", "//", "https://"])}{r.choice(hosts).upper()}/p{r.randint(0, 9)}?a=1">x</a>' for _ in range(r.randint(0, 4)))
        links += r.choice(["", '<a href="/local">y</a>', "<a href='mailto:x@y.z'>m</a>"])
        rows.append((i, f"http://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr', 'de'])}/{i}", links))
    df = spark.createDataFrame(rows, PAGES)
    out = urls.judge(df, queries.URL_RULES)
    names = sorted(out.columns)
    got = sorted(map(str, map(tuple, out.select(*names).collect())))
    c = duckdb.connect()
    c.register("pages", df.toPandas())
    want = c.sql(f"SELECT {', '.join(names)} FROM ({urls.oracle(queries.URL_RULES)})").fetchall()
    assert got == sorted(map(str, want))
    by = {(x["rule"], x["verdict"]) for x in out.collect()}
    assert (None, "block") in by and (None, "allow") in by


def test_distrust_does_not_shrink_with_the_number_of_linkers(spark):
    """Hosts that link to a blocked host only are blocked, however many there are and whoever links to them."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(0, "http://bad.net/es/0", link("bad.net"))]
    rows += [(k, f"http://only{k}.org/", link("bad.net")) for k in range(1, 41)]
    rows += [(k, f"http://rarely{k}.org/", link("bad.net", *[f"good{j}.com" for j in range(9)])) for k in range(41, 51)]
    rows += [(51, "http://portal.org/", link(*[f"only{k}.org" for k in range(1, 41)])), (52, "http://quiet.org/", "")]
    rows += [(60 + k, f"http://good{k}.com/", link("good0.com")) for k in range(9)]
    out = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, PAGES), queries.URL_RULES).collect()}
    assert all(out[k] == "block" for k in range(0, 41)) and all(out[k] == "allow" for k in range(41, 51))
    assert out[51] == "block" and out[52] == "allow"
    assert urls.judge(spark.createDataFrame(rows, PAGES), []).where("verdict = 'block'").count() == 0


def test_blocks_grow_with_the_table(spark):
    assert [simhash.blocks_for(10**k) for k in (0, 5, 7, 9)] == sorted(simhash.blocks_for(10**k) for k in (0, 5, 7, 9))
    assert simhash.blocks_for(10**9) > simhash.blocks_for(10**5)
    r = random.Random(12)
    base = [r.getrandbits(64) for _ in range(40)]
    points = sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(4)})
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(points)) for j in range(i) if (points[i] ^ points[j]).bit_count() <= 3}
    for blocks in (4, 9):
        got = [tuple(x) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), blocks=blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_of_equal_rows_is_the_same_in_any_order(spark):
    rows = [(1, PROSE, "b", "s"), (1, PROSE, "a", "s"), (1, PROSE, "c", "s")]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string")
        assert [x["lang"] for x in simhash.one_of_each(df).collect()] == ["a"]


def test_native_operators_use_no_python(spark, frame, tmp_path):
    """Plans of the operators marked native hold no Python node."""
    docs = frame([(1, PROSE), (2, "call +1 (017) 555-7713")])
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    page = spark.createDataFrame(pages(), PAGES)
    from lodestone.llm import pii

    for df in (mixing.draw(queries.with_domain(docs)), decontam.leaks(docs, bench), pii.personal_data(docs), pii.redact(docs), urls.judge(page, queries.URL_RULES)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
