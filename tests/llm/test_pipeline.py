"""The pipeline, stage by stage, against brute force on what each stage was given."""

import re
from collections import Counter

import corpus_pipeline
from lodestone.llm import quality, queries
from lodestone.llm.common import table

from .test_groups import classes, leak_table
from .test_texts import spans

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], DATA)
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == columns
    rows = [[tuple(r) for r in x.select("doc_id", "text").collect()] for x in seen]

    # 1: what op1 predicts as 1 stays; nearly all rows labelled good are kept
    predicted = {r["doc_id"]: r["predicted"] for r in quality.quality(docs, table(spark, DATA, "labels")).collect()}
    assert {d for d, _ in rows[1]} == {d for d, p in predicted.items() if p}
    # 2: one document of each group, the one with the smallest id
    _, least, _ = classes(rows[1])
    assert sorted(d for d, _ in rows[2]) == sorted(set(least))
    # 3: documents that hold an item go
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    leaks = {d for d, _ in leak_table(rows[2], items)}
    assert leaks and {d for d, _ in rows[3]} == {d for d, _ in rows[2]} - leaks
    # 4: no base span is left, texts without any finding are as they were
    before, after = dict(rows[3]), dict(rows[4])
    assert before.keys() == after.keys()
    changed = [d for d in before if before[d] != after[d]]
    assert any(spans(before[d]) for d in before) and all(d in changed for d in before if spans(before[d]))
    assert not any(spans(t) for t in after.values())
    assert all(re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", after[d]) for d in changed)
    # 5: whole documents, as the budget's SQL draws them
    import duckdb

    c = duckdb.connect()
    c.register("given", seen[4].toPandas())
    want = c.sql(f"SELECT doc_id, epoch FROM ({queries.mixing.oracle('given', queries.DOMAIN_SQL, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_EPOCHS, queries.SEED)})").fetchall()
    got = [tuple(r) for r in seen[5].select("doc_id", "epoch").collect()]
    assert got and Counter(got) == Counter(want)
    assert all(after[r["doc_id"]] == r["text"] for r in seen[5].select("doc_id", "text").collect())


def test_stages_on_odd_input(spark, frame, odd):
    for given in (frame(odd, extra=True), frame([], extra=True)):
        docs = given
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == given.columns
            out.count()
