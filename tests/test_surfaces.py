"""Command line, result frames, DataFrame operators, files out."""

import json

from pyspark.sql import functions as F

from lodestone import __main__
from lodestone.operators import relational
from lodestone.sources import external


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "a"), (2, None)], "id int, s string").write.parquet(str(tmp_path / "in.parquet"))
    script = tmp_path / "q.sql"
    script.write_text("CREATE TABLE k(a INT); INSERT INTO k VALUES (1),(2); SELECT x.id, k.a FROM x JOIN k ON x.id = k.a ORDER BY x.id DESC;")
    assert __main__.main(["--root", str(tmp_path / "store"), "--table", f"x={tmp_path / 'in.parquet'}", "-f", str(script)]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[1]["affectedRows"] == 2 and [x["values"] for x in lines if x.get("frame") == "row"] == [[2, 2], [1, 1]]
    assert __main__.main(["-e", "SELECT 1 FROM nowhere"]) == 1
    assert json.loads(capsys.readouterr().err)["code"] == 2003
    assert __main__.main(["--diagnose", "-e", "SELEC 1; FROM;"]) == 1
    assert len(capsys.readouterr().out.splitlines()) == 2


def test_stream_stops_at_its_limit(session):
    session.execute("CREATE TABLE k(a INT); INSERT INTO k VALUES (1),(2),(3);")
    frames = [json.loads(x) for x in session.stream("SELECT a FROM k ORDER BY a", limit=2)]
    assert [f["frame"] for f in frames] == ["meta", "row", "row", "complete"] and frames[-1] == {"frame": "complete", "rows": 2, "truncated": True}


def test_operators(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(2,), (2,), (3,)], "b int")
    nulls = spark.createDataFrame([(2,), (None,)], "b int")
    none = spark.createDataFrame([], "b int")
    got = lambda df: sorted(str(r[0]) for r in df.collect())
    assert got(relational.anti_in(left, "a", right, "b")) == ["1"]
    assert got(relational.anti_in(left, "a", nulls, "b")) == []
    assert got(relational.anti_in(left, "a", none, "b")) == ["1", "2", "None"]
    on = F.col("a") == F.col("b")
    assert got(relational.semi(left, right, on)) == ["2"] and got(relational.anti(left, right, on)) == ["1", "None"]
    assert [relational.join(left, right, None if k == "CROSS" else on, k).count() for k in relational.JOINS] == [2, 4, 3, 5, 9]
    ordered = relational.order_by(left, [relational.ordering("a", descending=True)], limit=2)
    assert [r["a"] for r in ordered.collect()] == [None, 2]
    assert [r["a"] for r in relational.order_by(left, [relational.ordering("a")], offset=2).collect()] == [None]
    assert relational.distinct(right).count() == 2


def test_files_out(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, s string")
    external.write_csv(df, str(tmp_path / "c"))
    external.write_json(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2 == spark.read.json(str(tmp_path / "j")).count()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from lodestone.session import Session

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    s = Session(spark)
    s.attach("orders", "/root/testdata/sf0.001/orders.parquet")
    plan = s.sql("SELECT o_custkey FROM orders WHERE o_orderkey >= 100 AND o_totalprice < 5e3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "LessThan(o_totalprice,5000.0)" in plan
    assert "o_orderdate" not in plan.split("ReadSchema")[1]
