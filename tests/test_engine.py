"""The dialect's own rules, on small tables given inline."""

import datetime
from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as s

from lodestone.errors import EngineError
from lodestone.plans.parser import diagnose, parse


def rows(session, sql):
    return session.execute(sql if sql.rstrip().endswith(";") else sql + ";")[-1].rows()


def error(session, sql, kind):
    with pytest.raises(EngineError) as e:
        session.execute(sql)
    assert e.value.kind == kind, e.value
    return str(e.value)


@pytest.fixture
def t(session):
    session.execute(
        "CREATE TABLE t(id INT, v INT, g VARCHAR); INSERT INTO t VALUES (1,10,'a'),(2,NULL,'a'),(3,20,'b'),(4,-5,'b'),(5,NULL,NULL),(6,NULL,NULL);"
        "CREATE TABLE one(id INT); INSERT INTO one VALUES (1); CREATE TABLE empty_t(id INT, v INT);"
        "CREATE TABLE r(id INT, v INT); INSERT INTO r VALUES (1,2),(1,3),(3,NULL);"
    )
    return session


def value(session, expression):
    return rows(session, f"SELECT {expression} AS x FROM one")[0][0]


def test_arithmetic_and_types(t):
    assert value(t, "7/2") == 3 and value(t, "-7/2") == -3
    assert value(t, "1.5 + 2") == D("3.5") and value(t, "1.50 * 2.0") == D("3.000")
    assert value(t, "1.0/3") == D("0.333333") and value(t, "-2.0/3") == D("-0.666667")
    assert value(t, "CAST(0.10 AS DECIMAL(10,2))/200000.01") == D("0.000000")
    assert value(t, "2147483647 + 1000000000000") == 1002147483647
    assert value(t, "1e308/1e0") == 1e308
    error(t, "SELECT id + 1e0 AS x FROM one;", "Semantic")
    for bad in ("1/0", "2147483647 + id", "1e308*10e0", "1.0/0"):
        with pytest.raises(Exception):
            rows(t, f"SELECT {bad} AS x FROM one;")
    error(t, "SELECT 99999999999999999999 AS x FROM one;", "IntegerOutOfRange")


def test_casts(t):
    assert value(t, "CAST(2.5 AS INT)") == 3 and value(t, "CAST(-0.5 AS INT)") == -1
    assert value(t, "CAST(TRUE AS VARCHAR)") == "TRUE" and value(t, "CAST('FaLsE' AS BOOL)") is False
    assert value(t, "CAST('2024-02-29' AS DATE)") == datetime.date(2024, 2, 29)
    assert value(t, "CAST('42' AS BIGINT)") == 42 and value(t, "CAST(1.005 AS DECIMAL(5,2))") == D("1.01")
    for bad in ("CAST(' 42 ' AS INT)", "CAST(1.5e0 AS INT)", "CAST('yes' AS BOOL)", "CAST('2024-1-1' AS DATE)", "CAST('abcdef' AS VARCHAR(5))", "CAST('Infinity' AS FLOAT)"):
        with pytest.raises(Exception):
            rows(t, f"SELECT {bad} AS x FROM one;")
    error(t, "SELECT CAST(1 AS DATE) AS x FROM one;", "Semantic")


def test_strict_comparison(t):
    for bad in ("id = '1'", "DATE '2024-01-01' > '2023-01-01'", "TRUE = 'true'", "id = 1e0", "id LIKE '1'", "id AND TRUE", "v IN ('a')"):
        error(t, f"SELECT id FROM t WHERE {bad};", "Semantic")
    assert len(rows(t, "SELECT id FROM t WHERE id = 1.0")) == 1
    error(t, "SELECT id FROM t WHERE 1 = id = 1;", "Syntax")


def test_three_values_and_like(t):
    assert rows(t, "SELECT id FROM t WHERE NOT v = 10 ORDER BY id") == [(3,), (4,)]
    assert rows(t, "SELECT id FROM t WHERE v NOT IN (10, NULL)") == []
    assert value(t, r"'a\b' LIKE 'a\b'") is True and value(t, "'a%b' LIKE 'a_b'") is True and value(t, "'中c' LIKE '_c'") is True
    assert value(t, "NULL LIKE 'a'") is None and value(t, "'O''Brien'") == "O'Brien"


def test_null_order(t):
    assert [r[0] for r in rows(t, "SELECT v FROM t ORDER BY v, id")] == [-5, 10, 20, None, None, None]
    assert [r[0] for r in rows(t, "SELECT v FROM t ORDER BY v DESC, id")] == [None, None, None, 20, 10, -5]
    assert [r[0] for r in rows(t, "SELECT v FROM t ORDER BY v DESC NULLS LAST LIMIT 2 OFFSET 1")] == [10, -5]


def test_aggregates(t):
    assert rows(t, "SELECT COUNT(*) AS a, COUNT(v) AS b, SUM(v) AS c, AVG(v) AS d, MIN(g) AS e FROM t") == [(6, 3, 25, D("8.333333"), "a")]
    assert rows(t, "SELECT COUNT(*) AS a, SUM(v) AS b, AVG(v) AS c FROM empty_t") == [(0, None, None)]
    assert sorted(rows(t, "SELECT g, COUNT(v) AS n FROM t GROUP BY g"), key=str) == [("a", 1), ("b", 2), (None, 0)]
    assert rows(t, "SELECT g FROM t GROUP BY g HAVING SUM(v) > 12") == [("b",)]
    error(t, "SELECT id, COUNT(*) AS n FROM t;", "Semantic")
    error(t, "SELECT id FROM t WHERE COUNT(*) > 1;", "Semantic")
    error(t, "SELECT DISTINCT id FROM t ORDER BY v;", "Semantic")
    t.execute("CREATE TABLE big(v BIGINT); INSERT INTO big VALUES (9223372036854775807),(9223372036854775807);")
    assert rows(t, "SELECT AVG(v) AS a FROM big") == [(D("9223372036854775807.000000"),)]
    with pytest.raises(Exception):
        rows(t, "SELECT SUM(v) AS a FROM big")


def test_joins(t):
    assert rows(t, "SELECT t.id, r.v FROM t LEFT JOIN r ON t.id = r.id WHERE t.id < 4 ORDER BY t.id, r.v") == [(1, 2), (1, 3), (2, None), (3, None)]
    assert len(rows(t, "SELECT * FROM t, r")) == 18 and len(rows(t, "SELECT * FROM t FULL JOIN r ON t.id = r.v")) == 7
    assert rows(t, "SELECT a.id FROM t a JOIN t b ON a.id < b.id AND b.id = 3 ORDER BY a.id") == [(1,), (2,)]
    error(t, "SELECT * FROM t CROSS JOIN r ON TRUE;", "Syntax")
    error(t, "SELECT * FROM t JOIN t ON TRUE;", "Semantic")
    error(t, "SELECT id FROM t JOIN r ON t.id = r.id;", "Semantic")


def test_subqueries(t):
    assert rows(t, "SELECT id FROM t WHERE id IN (SELECT id FROM r) ORDER BY id") == [(1,), (3,)]
    assert rows(t, "SELECT id FROM t WHERE id NOT IN (SELECT v FROM r)") == []
    assert rows(t, "SELECT id, (SELECT SUM(r.v) FROM r WHERE r.id = t.id) AS s FROM t WHERE id < 4 ORDER BY id") == [(1, 5), (2, None), (3, None)]
    with pytest.raises(Exception):
        rows(t, "SELECT (SELECT id FROM r) AS x FROM one")
    three = "SELECT id FROM t WHERE EXISTS (SELECT r.id FROM r WHERE r.id = t.id AND EXISTS (SELECT o.id FROM one o WHERE o.id = r.id AND o.id = t.id))"
    assert rows(t, three) == [(1,)]
    assert rows(t, "SELECT id FROM t WHERE id IN (SELECT t.id FROM t WHERE t.id > 4) ORDER BY id") == [(5,), (6,)]
    assert rows(t, "WITH q(a) AS (SELECT id FROM r), w AS (SELECT a FROM q WHERE a > 1) SELECT a FROM w") == [(3,)]
    error(t, "SELECT * FROM (SELECT id, id FROM t) AS d;", "Semantic")
    error(t, "SELECT * FROM (SELECT id FROM t);", "Syntax")
    error(t, "WITH RECURSIVE q AS (SELECT id FROM t) SELECT id FROM q;", "NotImplemented")


def test_names(t):
    assert t.execute("SELECT id + 1, id, v AS w FROM t;")[0].columns == ["expr_1", "id", "w"]
    assert "did you mean" in error(t, "SELECT idd FROM t;", "Semantic")
    error(t, "SELECT id AS v FROM t ORDER BY v;", "Semantic")
    assert [e.kind for e in t.diagnostics("SELEC 1; SELECT FROM t; SELECT 1 FROM t")] == ["Syntax"] * 3
    assert len(diagnose("x;" * 150)) == 100


def test_constraints(session):
    session.execute(
        "CREATE TABLE p(a INT, b VARCHAR, PRIMARY KEY(a, b)); CREATE TABLE c(id INT PRIMARY KEY, x INT, y VARCHAR, s INT CHECK(s >= 0),"
        " CONSTRAINT up FOREIGN KEY(x, y) REFERENCES p(a, b)); INSERT INTO p VALUES (1,'x'),(2,'y'); INSERT INTO c VALUES (1,1,'x',0),(2,1,NULL,NULL);"
    )
    for bad in (
        "INSERT INTO p VALUES (1,'x');", "INSERT INTO p VALUES (3,NULL);", "INSERT INTO c VALUES (3,2,'x',1);", "INSERT INTO c VALUES (3,NULL,NULL,-1);",
        "DELETE FROM p WHERE a = 1;", "UPDATE p SET a = 9 WHERE a = 1;", "UPDATE c SET id = 1;", "INSERT INTO c VALUES (7,2,'y',1),(7,2,'y',1);",
    ):
        error(session, bad, "Execution")
    error(session, "INSERT INTO c(id, id) VALUES (1, 2);", "Semantic")
    error(session, "CREATE TABLE z(a INT REFERENCES c(x));", "Semantic")
    assert rows(session, "SELECT COUNT(*) AS n FROM c") == [(2,)]
    session.execute("UPDATE c SET id = id + 1; DELETE FROM c; DELETE FROM p;")
    assert rows(session, "SELECT COUNT(*) AS n FROM p") == [(0,)]


def test_values_stored_exactly(session):
    session.execute("CREATE TABLE d(id INT PRIMARY KEY, n DECIMAL(8,2) NOT NULL DEFAULT 1.20, s VARCHAR(3), w DATE, f FLOAT);")
    session.execute("INSERT INTO d VALUES (1, DEFAULT, 'abc', DATE '0001-01-01', 1); INSERT INTO d(id) VALUES (2);")
    assert rows(session, "SELECT n, s, f FROM d ORDER BY id") == [(D("1.20"), "abc", 1.0), (D("1.20"), None, None)]
    error(session, "INSERT INTO d(id, n) VALUES (3, 1.234);", "Semantic")
    error(session, "INSERT INTO d(id, s) VALUES (3, 'abcd');", "Execution")
    error(session, "INSERT INTO d(id, w) VALUES (3, '2024-01-01');", "Semantic")


def test_transactions(session, spark, tmp_path):
    session.execute("CREATE TABLE k(a INT, b INT); BEGIN; INSERT INTO k VALUES (1,2); SAVEPOINT s; UPDATE k SET a = b, b = a;")
    assert rows(session, "SELECT a, b FROM k") == [(2, 1)]
    session.execute("ROLLBACK TO s; COMMIT;")
    assert rows(session, "SELECT a, b FROM k") == [(1, 2)]
    session.execute("BEGIN;")
    error(session, "INSERT INTO k VALUES ('x', 1);", "Semantic")
    error(session, "SELECT a FROM k;", "Transaction")
    session.execute("ROLLBACK;")
    with pytest.raises(EngineError):
        session.run_script("BEGIN; DELETE FROM k;")
    assert rows(session, "SELECT COUNT(*) AS n FROM k") == [(1,)]
    error(session, "COMMIT;", "Transaction")
    from lodestone.session import Session

    other = Session(spark, session.files.root)
    other.execute("INSERT INTO k VALUES (3, 4);")
    error(session, "INSERT INTO k VALUES (5, 6);", "Transaction")  # another writer was first
    assert session.backup(str(tmp_path / "copy")) >= 1


def test_copy_on_write_leaves_other_files(session):
    session.execute("CREATE TABLE k(a INT); INSERT INTO k VALUES (1); INSERT INTO k VALUES (2);")
    before = set(session.state.table("k").files)
    session.execute("UPDATE k SET a = 5 WHERE a = 2;")
    assert len(before & set(session.state.table("k").files)) >= 1
    assert rows(session, "SELECT a FROM k ORDER BY a") == [(1,), (5,)]
    session.execute("DELETE FROM k WHERE a = NULL;")
    assert rows(session, "SELECT COUNT(*) AS n FROM k") == [(2,)]
    assert session.execute("CHECKPOINT;")[0].affected_rows >= 1
    assert rows(session, "SELECT a FROM k ORDER BY a") == [(1,), (5,)]


def test_administration(t):
    t.execute("CREATE INDEX i ON t(g, id); ANALYZE TABLE t;")
    s_ = t.statistics("t")
    assert s_["rows"] == 6 and s_["columns"]["v"]["nulls"] == 3
    t.execute("INSERT INTO t VALUES (7, 1, 'z');")
    assert t.statistics("t") is None
    t.execute("SELECT id FROM t WHERE v > 3;")
    assert t.index_advice()[0]["column"] == "v"
    assert t.index_verify("i")
    t.index_rebuild("i")
    assert len(rows(t, "SELECT id FROM t WHERE g = 'a'")) == 2
    document = t.compile("SELECT id FROM t WHERE id = 1;")
    assert t.execute_plan(document)[0].rows() == [(1,)]
    t.execute("CREATE TABLE more(a INT);")
    with pytest.raises(EngineError) as e:
        t.execute_plan(document)
    assert e.value.kind == "PlanStaleSchema"
    plan = t.execute("EXPLAIN ANALYZE SELECT id FROM t;")[0].rows()
    assert dict(plan)["rows"] == "7"
    result = t.execute("SELECT id FROM t WHERE g = 'A';")[0]
    assert t.remember("SELECT id FROM t WHERE g = 'A'", result) == []
    assert t.execute("SELECT id FROM t WHERE g = 'a' ORDER BY id;")[0].rows() == [(1,), (2,)]


def test_access(t, spark):
    from lodestone.session import Session

    t.grant("ann", "SELECT", "t")
    ann = Session(spark, t.files.root, user="ann")
    assert len(rows(ann, "SELECT id FROM t")) == 6
    error(ann, "SELECT id FROM r;", "Permission")
    error(ann, "DELETE FROM t;", "Permission")


def test_limits():
    with pytest.raises(EngineError):
        parse("SELECT " + "(" * 300 + "1" + ")" * 300 + " FROM t;")
    with pytest.raises(EngineError):
        parse("SELECT 1 FROM t WHERE a IN (" + ",".join("1" * 129) + ");")
    with pytest.raises(EngineError):
        parse("SELECT 'open FROM t;")
    with pytest.raises(EngineError):
        parse(f"SELECT {'a' * 129} FROM t;")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(s.decimals(-10**9, 10**9, places=4), s.decimals(D("0.001"), 10**6, places=3))
def test_division_rounds_once(spark, a, b):
    from lodestone.functions.scalar import decimal_division

    got = spark.sql("SELECT " + decimal_division(f"CAST('{a}' AS DECIMAL(18,4))", f"CAST('{b}' AS DECIMAL(18,3))", 6) + " AS x").first()[0]
    import decimal

    with decimal.localcontext(decimal.Context(prec=80)):
        want = (a / b).quantize(D("0.000001"), rounding=decimal.ROUND_HALF_UP)
    assert got == want


def test_three_valued_in(session):
    session.execute("CREATE TABLE x(v INT); INSERT INTO x VALUES (10),(NULL),(20); CREATE TABLE s(v INT); INSERT INTO s VALUES (10),(NULL); CREATE TABLE none(v INT);")
    of = lambda text: {r[0]: r[1] for r in rows(session, f"SELECT v, {text} AS w FROM x")}
    assert of("v IN (SELECT v FROM s)") == {10: True, None: None, 20: None}
    assert of("v NOT IN (SELECT v FROM s)") == {10: False, None: None, 20: None}
    assert of("v IN (SELECT v FROM s WHERE v > 0)") == {10: True, None: None, 20: False}
    assert of("v NOT IN (SELECT v FROM none)") == {10: True, None: True, 20: True}
    assert len(rows(session, "SELECT v FROM x WHERE (v IN (SELECT v FROM s)) IS NULL")) == 2
    assert rows(session, "SELECT v FROM x WHERE v NOT IN (SELECT v FROM s WHERE v > 0)") == [(20,)]
    assert rows(session, "SELECT v FROM x WHERE NOT (v IN (SELECT v FROM s WHERE v > 0))") == [(20,)]
    assert rows(session, "SELECT v FROM x WHERE v NOT IN (SELECT v FROM s)") == [] and len(rows(session, "SELECT v FROM x WHERE v NOT IN (SELECT v FROM none)")) == 3
    session.execute("UPDATE x SET v = 0 WHERE v NOT IN (SELECT v FROM s WHERE v > 0); DELETE FROM x WHERE v IN (SELECT v FROM s);")
    assert sorted(rows(session, "SELECT v FROM x"), key=str) == [(0,), (None,)]


def test_not_in_is_no_broadcast_of_the_set(session):
    session.execute("CREATE TABLE x(v INT); INSERT INTO x VALUES (1),(2); CREATE TABLE s(v INT); INSERT INTO s VALUES (2),(3);")
    session.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = session.sql("SELECT v FROM x WHERE v NOT IN (SELECT v FROM s)")
    assert [tuple(r) for r in df.collect()] == [(1,)]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_timestamps_keep_their_time(spark, tmp_path):
    from lodestone.session import Session

    times = [datetime.datetime(2024, 5, 1, 10), datetime.datetime(2024, 5, 1, 11), None]
    spark.createDataFrame([(x,) for x in times], "ts timestamp").write.parquet(str(tmp_path / "p"))
    s_ = Session(spark)
    s_.attach("e", str(tmp_path / "p"))
    assert sorted(rows(s_, "SELECT DISTINCT ts FROM e"), key=str) == [("2024-05-01 10:00:00",), ("2024-05-01 11:00:00",), (None,)]
    error(s_, "SELECT ts FROM e WHERE ts = DATE '2024-05-01';", "Semantic")
    s_.attach("e", str(tmp_path / "p"), dates=["ts"])
    with pytest.raises(Exception):
        rows(s_, "SELECT ts FROM e")
    with pytest.raises(EngineError):
        s_.attach("e", str(tmp_path / "p"), dates=["other"])


def test_checkpoint_spares_open_sessions(session, spark):
    from lodestone.session import Session

    session.execute("CREATE TABLE k(a INT); INSERT INTO k VALUES (1);")
    reader = Session(spark, session.files.root)
    old = reader.sql("SELECT a FROM k")
    session.execute("BEGIN; INSERT INTO k VALUES (2);")
    other = Session(spark, session.files.root)
    assert other.execute("CHECKPOINT;")[0].affected_rows == 0
    session.execute("COMMIT;")
    assert rows(other, "SELECT COUNT(*) AS n FROM k") == [(2,)]  # reads see the newest version
    other.execute("UPDATE k SET a = 5 WHERE a = 1;")
    other.execute("CHECKPOINT;")
    assert [tuple(r) for r in old.collect()] == [(1,)]
    assert rows(Session(spark, session.files.root), "SELECT a FROM k ORDER BY a") == [(2,), (5,)]
    # the session that lost a race goes on with the newer version
    session.execute("BEGIN; DELETE FROM k;")
    other.execute("INSERT INTO k VALUES (7);")
    error(session, "COMMIT;", "Transaction")
    assert rows(session, "SELECT a FROM k ORDER BY a") == [(2,), (5,), (7,)]
    session.execute("INSERT INTO k VALUES (8);")
    for s_ in (reader, other):
        s_.close()
    assert session.execute("CHECKPOINT;")[0].affected_rows >= 1
    # files that went while a transaction was open are noticed
    session.execute("BEGIN; INSERT INTO k VALUES (9);")
    for f in session.staged.table("k").files:
        if f not in session.catalog.state.table("k").files:
            session.files.remove(f)
    error(session, "COMMIT;", "Storage")
    assert len(rows(session, "SELECT a FROM k")) == 4


def test_two_writers_of_one_version(session, tmp_path):
    assert session.files.create("x.json", "one") and not session.files.create("x.json", "two")
    assert session.files.read("x.json") == "one"


def test_settings_of_the_caller_stay(spark, tmp_path):
    from lodestone.session import SETTINGS, Session

    spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    s_ = Session(spark, str(tmp_path / "s"))
    assert spark.conf.get("spark.sql.decimalOperations.allowPrecisionLoss") == "true"
    assert all(s_.spark.conf.get(k) == v for k, v in SETTINGS.items()) and s_.spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_cancel_is_for_one_session(spark, tmp_path):
    from lodestone.session import Session

    s_ = Session(spark, timeout=0.2)
    spark.range(0, 50_000, 1, 60).selectExpr("id AS a").write.parquet(str(tmp_path / "p"))
    s_.attach("p", str(tmp_path / "p"))
    result = s_.execute("SELECT COUNT(*) AS n FROM p x JOIN p y ON x.a < y.a;")[0]
    with pytest.raises(EngineError) as e:
        result.rows()
    assert e.value.kind == "Cancelled"
    assert spark.range(10).count() == 10


def test_roles_and_audit(t, spark):
    from lodestone.session import Session

    t.grant("staff", "SELECT", "t")
    t.join_role("readers", "staff")
    t.join_role("ann", "readers")
    ann = Session(spark, t.files.root, user="ann")
    assert len(rows(ann, "SELECT id FROM t")) == 6
    for act in (lambda: ann.grant("ann", "ALL"), lambda: ann.join_role("ann", "owners"), ann.audit, lambda: ann.restore("x"), lambda: ann.index_verify("none")):
        with pytest.raises(EngineError):
            act()
    t.leave_role("readers", "staff")
    error(ann, "SELECT id FROM t;", "Permission") if ann.catalog.refresh() else pytest.fail("no newer version")
    assert [x["what"] for x in t.audit()] == ["grant", "join", "join", "leave"]
    with pytest.raises(EngineError):
        t.grant("ann", "FLY", "t")
    assert [x["name"] for x in ann.describe()] == []


def test_trees_survive_json(t):
    import json

    from lodestone.plans import ast

    text = "WITH q(a) AS (SELECT id FROM r) SELECT DISTINCT a, -1.5 AS d FROM q LEFT JOIN t ON t.id = a AND NOT t.v IN (1, NULL) WHERE a IN (SELECT id FROM t WHERE g LIKE 'a%' OR g IS NULL) ORDER BY a DESC NULLS LAST LIMIT 3;"
    (node,) = parse(text).statements
    assert ast.load(json.loads(json.dumps(ast.dump(node)))) == node
    document = t.compile("INSERT INTO one VALUES (5); SELECT id FROM one ORDER BY id;")
    assert t.execute_plan(json.loads(json.dumps(document)))[1].rows() == [(1,), (5,)]
    document["statements"][0]["ast"]["node"] = "Nothing"
    with pytest.raises(EngineError):
        t.execute_plan(document)


def test_explain(t):
    t.execute("CREATE INDEX i ON t(g); ANALYZE TABLE t;")
    told = t.execute("EXPLAIN ANALYZE SELECT g, COUNT(*) AS n FROM t WHERE g = 'a' AND 1 = 1 GROUP BY g;")[0].rows()
    import json

    by = lambda item: [x for i, x in told if i == item]
    assert by("rows") == ["1"] and len(by("raw")) == len(by("physical")) == 1 and by("rule")
    assert [(c["by"], c["rows"]) for c in map(json.loads, by("candidate"))] == [("scan", 6), ("i", 3)]
    nodes = [json.loads(x) for x in by("node")]
    assert nodes[0]["depth"] == 0 and any(n["operator"].startswith("Scan") and n["rows"] <= 6 for n in nodes) and all("operator" in n for n in nodes)


def test_many_rows_are_one_task(session):
    session.execute("CREATE TABLE k(a INT, b VARCHAR(5)); INSERT INTO k VALUES " + ", ".join(f"({i} + 0, 'x{i}')" for i in range(200)) + ";")
    assert len(session.state.table("k").files) == 1 and rows(session, "SELECT SUM(a) AS s FROM k") == [(199 * 100,)]
    session.execute("INSERT INTO k VALUES ((SELECT MAX(a) FROM k) + 1, 'last'), (1 + 1, 'x');")
    assert rows(session, "SELECT b FROM k WHERE a = 200") == [("last",)]
    error(session, "INSERT INTO k VALUES (1 + 1, 'sixsix');", "Execution")
