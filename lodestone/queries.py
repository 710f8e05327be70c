"""The registered queries over the driver's tables, with DuckDB SQL that gives the same rows.

An entry is dialect SQL and DuckDB SQL; the two differ where the dialects do (FLOAT literals,
whole division, NULL order, exact averages).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .operators import relational
from .session import Session
from .sources import external
from .sources.places import scratch

#: Timestamps that hold no time of day, seen as dates.
DATES = {"orders": ("o_orderdate",), "lineitem": ("l_shipdate",)}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
Q2 = "DECIMAL(18,2)"


def _avg(x: str) -> str:
    """DuckDB: the average, exact before it is rounded half away from zero to six places."""
    s = f"CAST(SUM(CAST({x} AS DECIMAL(18,6))) * 1000000 AS HUGEINT)"
    return f"CAST(CAST((2 * abs({s}) + COUNT({x})) // (2 * COUNT({x})) * sign({s}) AS DECIMAL(38,0)) / 1000000 AS DECIMAL(38,6))"


FLAGSHIP = """SELECT n.n_name AS nation, COUNT(*) AS order_count, SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS total
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE o.o_totalprice >= {} GROUP BY n.n_name HAVING COUNT(*) >= 2 ORDER BY order_count DESC, nation"""

#: Keys of some nations, and a null for each of the others.
_KEYS_AND_NULLS = "SELECT k.n_nationkey FROM nation m LEFT JOIN nation k ON k.n_nationkey = m.n_nationkey AND m.n_nationkey < 5"
#: key -> dialect SQL, or (dialect SQL, DuckDB SQL)
SQL: dict[str, str | tuple[str, str]] = {
    "flagship": (FLAGSHIP.format("1000.0e0"), FLAGSHIP.format("1000.0")),
    "scan_project": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "star_qualified": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "filter_compare": ("SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 5000e0 AND c_nationkey <> 3", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 5000 AND c_nationkey <> 3"),
    "filter_3vl": "SELECT c_custkey FROM customer WHERE NOT (c_nationkey > 10 OR c_mktsegment = 'BUILDING') OR c_mktsegment IS NULL",
    "is_null": "SELECT o.o_orderkey, c.c_custkey IS NULL AS orphan FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_nationkey < 5",
    "in_list": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 45)",
    "not_in_list": "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 5, 9, 45)",
    "like_prefix": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'S%'",
    "not_like": "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE '%1%'",
    "like_underscore": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_2'",
    "constant_where": "SELECT n_nationkey FROM nation WHERE FALSE",
    "int_arith": "SELECT l_orderkey, l_linenumber, l_linenumber * 7 + 2 - l_linenumber AS v, l_orderkey + l_linenumber AS w FROM lineitem",
    "int_div": ("SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS q, (0 - l_linenumber) / 3 AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber // 2 AS q, (0 - l_linenumber) // 3 AS r FROM lineitem"),
    "neg": "SELECT p_partkey, -p_size AS m, +p_size AS p FROM part",
    "decimal_add": f"SELECT p_partkey, CAST(CAST(p_retailprice AS {Q2}) + 1.5 AS DECIMAL(38,2)) AS v FROM part",
    "decimal_mul": f"SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS {Q2}) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(38,4)) AS v FROM lineitem",
    "decimal_div": (
        f"SELECT p_partkey, CAST(p_retailprice AS {Q2}) / 7 AS v FROM part",
        f"SELECT p_partkey, CAST(CAST((2 * CAST(CAST(p_retailprice AS {Q2}) * 1000000 AS HUGEINT) + 7) // 14 AS DECIMAL(38,0)) / 1000000 AS DECIMAL(38,6)) AS v FROM part",
    ),
    "float_arith": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1e0 - l_discount) AS v FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS v FROM lineitem"),
    "cast_int_decimal": "SELECT p_partkey, CAST(p_size AS DECIMAL(10,3)) AS v FROM part",
    "cast_decimal_int_round": f"SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS {Q2}) AS INT) AS v FROM lineitem",
    "cast_str_int": "SELECT o_orderkey, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS v FROM orders",
    "cast_date": (
        "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS d FROM orders WHERE o_orderdate < DATE '1996-01-01'",
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-01-01'",
    ),
    "cast_bool": ("SELECT p_partkey, CAST(p_size > 10 AS VARCHAR) AS v FROM part", "SELECT p_partkey, upper(CAST(p_size > 10 AS VARCHAR)) AS v FROM part"),
    "index_point_lookup": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "index_range": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200",
    "index_prefix_range": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 5 AND l_linenumber > 1",
    "ordered_scan": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey",
    "join_right": "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_full": "SELECT s.s_suppkey, n.n_nationkey FROM supplier s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey > 1",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_comma": "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_chain": "SELECT r.r_name, n.n_name, c.c_custkey, o.o_orderkey FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey",
    "join_derived": "SELECT n.n_name, d.k FROM nation n JOIN (SELECT c_nationkey AS nk, COUNT(*) AS k FROM customer GROUP BY c_nationkey) d ON d.nk = n.n_nationkey",
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "semi_exists": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "anti_not_exists": "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey < 200)",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 200)",
    "not_in_null_operand": "SELECT d.c, d.k FROM (SELECT c.c_custkey AS c, o.o_orderkey AS k FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderkey < 100) d WHERE d.k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey < 50)",
    "in_select_list_null": f"SELECT n.n_nationkey, n.n_nationkey IN ({_KEYS_AND_NULLS}) AS v FROM nation n",
    "not_in_select_list_null": f"SELECT n.n_nationkey, n.n_nationkey NOT IN ({_KEYS_AND_NULLS}) AS v FROM nation n",
    "in_is_null": f"SELECT n.n_nationkey FROM nation n WHERE (n.n_nationkey IN ({_KEYS_AND_NULLS})) IS NULL",
    "in_or": f"SELECT n.n_nationkey FROM nation n WHERE n.n_nationkey > 20 OR n.n_nationkey NOT IN (SELECT n_regionkey FROM nation) OR NOT (n.n_nationkey IN ({_KEYS_AND_NULLS}))",
    "in_having": "SELECT n_regionkey, COUNT(*) AS k FROM nation GROUP BY n_regionkey HAVING COUNT(*) IN (SELECT r_regionkey + 3 FROM region) AND COUNT(*) NOT IN (SELECT r_regionkey FROM region)",
    "in_correlated_list": "SELECT n.n_nationkey, n.n_regionkey IN (SELECT r.r_regionkey FROM region r WHERE r.r_regionkey < n.n_nationkey) AS v FROM nation n",
    "exists_or": "SELECT n.n_nationkey FROM nation n WHERE n.n_regionkey = 0 OR EXISTS (SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey)",
    "exists_select_list": "SELECT n.n_nationkey, EXISTS (SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS has FROM nation n",
    "scalar_uncorr": "SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)",
    "scalar_corr_agg": "SELECT c.c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
    "scalar_corr_having": "SELECT n.n_regionkey, COUNT(*) AS k FROM nation n GROUP BY n.n_regionkey HAVING COUNT(*) >= (SELECT COUNT(*) FROM region r WHERE r.r_regionkey = n.n_regionkey)",
    "corr_three_level": "SELECT n.n_nationkey FROM nation n WHERE EXISTS (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey > n.n_nationkey * 50))",
    "derived": "SELECT d.s, d.n FROM (SELECT o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY o_orderstatus) AS d WHERE d.n > 1",
    "derived_nested": "SELECT e.s FROM (SELECT d.s AS s FROM (SELECT o_orderstatus AS s, o_orderkey AS k FROM orders) d WHERE d.k > 10) e GROUP BY e.s",
    "cte": "WITH a AS (SELECT c_nationkey AS nk, COUNT(*) AS n FROM customer GROUP BY c_nationkey), b AS (SELECT nk, n FROM a WHERE n > 1) SELECT b.nk, b.n, t.n_name FROM b JOIN nation t ON t.n_nationkey = b.nk",
    "cte_columns": "WITH a(k, v) AS (SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus) SELECT k, v FROM a",
    "agg_global": (f"SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_partkey) AS lo, MAX(l_partkey) AS hi FROM lineitem", "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_partkey) AS lo, MAX(l_partkey) AS hi FROM lineitem"),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_partkey) AS lo FROM lineitem WHERE l_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_partkey) AS lo FROM lineitem WHERE l_orderkey < 0"),
    "count_col": "SELECT COUNT(o.o_orderkey) AS n, COUNT(*) AS m FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey",
    "sum_int": ("SELECT l_returnflag, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "sum_decimal": (f"SELECT l_returnflag, l_linestatus, SUM(CAST(l_extendedprice AS {Q2})) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus",) * 2,
    "avg_int": ("SELECT l_returnflag, AVG(l_linenumber) AS a, AVG(l_partkey) AS b FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {_avg('l_linenumber')} AS a, {_avg('l_partkey')} AS b FROM lineitem GROUP BY l_returnflag"),
    "avg_decimal": (f"SELECT l_linestatus, AVG(CAST(l_quantity AS DECIMAL(12,2))) AS a FROM lineitem GROUP BY l_linestatus", f"SELECT l_linestatus, {_avg('l_quantity')} AS a FROM lineitem GROUP BY l_linestatus"),
    "min_max_str": "SELECT MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer",
    "min_max_date": ("SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders", "SELECT CAST(MIN(o_orderdate) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders"),
    "group_expr": ("SELECT l_linenumber / 2 AS h, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber / 2", "SELECT l_linenumber // 2 AS h, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber // 2"),
    "group_null": "SELECT o.o_orderstatus, COUNT(*) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY o.o_orderstatus",
    "having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING MAX(o_orderkey) > 500 AND COUNT(*) > 2",
    "having_no_group": "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1",
    "agg_order": "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus ORDER BY COUNT(*) DESC, o_orderstatus",
    "agg_over_aggregates": ("SELECT o_orderstatus, SUM(o_custkey) / COUNT(*) + MIN(o_orderkey) AS v FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(o_custkey) // COUNT(*) + MIN(o_orderkey) AS BIGINT) AS v FROM orders GROUP BY o_orderstatus"),
    "distinct": "SELECT DISTINCT event_type FROM events",
    "distinct_null": "SELECT DISTINCT o.o_orderstatus, o.o_orderpriority FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey",
    "events_by_time": (
        "SELECT ts, event_type, COUNT(*) AS n FROM events WHERE ts >= '2024-01-15' AND ts < '2024-01-17 12' GROUP BY ts, event_type",
        "SELECT CAST(ts AS VARCHAR) AS ts, event_type, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-17 12:00:00' GROUP BY ALL",
    ),
    "sort_multi": "SELECT o_orderstatus, o_custkey, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_custkey, o_orderkey",
    "sort_nulls": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey ORDER BY o.o_orderkey DESC NULLS LAST, c.c_custkey",
    "top_n": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC NULLS FIRST, o_orderkey LIMIT 10"),
    "top_n_nulls_first": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey ORDER BY o.o_orderkey DESC, c.c_custkey LIMIT 20",
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey ORDER BY o.o_orderkey DESC NULLS FIRST, c.c_custkey LIMIT 20",
    ),
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 5",
    "offset_only": "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20",
    "pricing_summary": (
        f"SELECT l_returnflag, l_linestatus, SUM(CAST(l_quantity AS {Q2})) AS qty, SUM(CAST(l_extendedprice AS {Q2})) AS base, AVG(CAST(l_discount AS DECIMAL(6,2))) AS disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
        f"SELECT l_returnflag, l_linestatus, SUM(CAST(l_quantity AS {Q2})) AS qty, SUM(CAST(l_extendedprice AS {Q2})) AS base, {_avg('CAST(l_discount AS DECIMAL(6,2))')} AS disc, COUNT(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    ),
}


def reader(spark: SparkSession, sf_dir: str, text: str) -> Session:
    """A session that sees the tables which a statement names."""
    lower = text.lower()
    return Session(spark).attach_directory(sf_dir, [x for x in TABLES if x in lower], DATES)


def run_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: reader(spark, sf_dir, text).sql(text)


def store(spark: SparkSession, sf_dir: str) -> Session:
    """A session with stored copies of nation and supplier."""
    session = Session(spark, scratch(spark, "store"))
    session.execute(
        "CREATE TABLE nation(n_nationkey INT PRIMARY KEY, n_name VARCHAR NOT NULL, n_regionkey INT);"
        "CREATE TABLE supplier(s_suppkey BIGINT PRIMARY KEY, s_name VARCHAR, s_nationkey INT REFERENCES nation(n_nationkey), s_acctbal FLOAT, note VARCHAR DEFAULT 'new');"
    )
    for name in ("nation", "supplier"):
        session.load(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return session


def after(script: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    """What a query sees after a script has run on stored copies."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = store(spark, sf_dir)
        session.run_script(script)
        return session.sql(query)

    return run


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, note FROM supplier"
#: key -> script, query after it, DuckDB SQL over the tables as they are
STORED: dict[str, tuple[str, str, str]] = {
    "insert_values": (
        "INSERT INTO nation VALUES (100, 'NEW', 1), (101, 'O''LD', NULL);", _NATION,
        _NATION + " UNION ALL VALUES (100, 'NEW', 1), (101, 'O''LD', NULL)",
    ),
    "insert_default": (
        "INSERT INTO supplier(s_suppkey, s_name) VALUES (900001, 'X'); INSERT INTO supplier(s_suppkey, note) VALUES (900002, DEFAULT);", _SUPPLIER,
        "SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS VARCHAR) AS note FROM supplier UNION ALL VALUES (900001, 'X', NULL, 'new'), (900002, NULL, NULL, 'new')",
    ),
    "update_cow": (
        "UPDATE supplier SET note = 'rich', s_nationkey = DEFAULT WHERE s_acctbal > 5000e0;", _SUPPLIER,
        "SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 5000 THEN NULL ELSE s_nationkey END AS s_nationkey, CASE WHEN s_acctbal > 5000 THEN 'rich' END AS note FROM supplier",
    ),
    "update_swap": (
        "UPDATE supplier SET s_name = note, note = s_name WHERE s_suppkey > 3;", _SUPPLIER,
        "SELECT s_suppkey, CASE WHEN s_suppkey > 3 THEN NULL ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_suppkey > 3 THEN s_name END AS note FROM supplier",
    ),
    "update_key_shift": (
        "DELETE FROM supplier; UPDATE nation SET n_nationkey = n_nationkey + 1;", _NATION,
        "SELECT CAST(n_nationkey + 1 AS INT) AS n_nationkey, n_name, n_regionkey FROM nation",
    ),
    "update_derived": (
        "UPDATE (SELECT * FROM nation WHERE n_regionkey = 1) AS d SET n_name = 'R1' WHERE d.n_nationkey < 20;", _NATION,
        "SELECT n_nationkey, CASE WHEN n_regionkey = 1 AND n_nationkey < 20 THEN 'R1' ELSE n_name END AS n_name, n_regionkey FROM nation",
    ),
    "delete_cow": ("DELETE FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2);", _SUPPLIER,
                   "SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS VARCHAR) AS note FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "delete_null_pred": ("DELETE FROM supplier WHERE note = 'x' OR s_suppkey < 3;", _SUPPLIER, "SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS VARCHAR) AS note FROM supplier WHERE s_suppkey >= 3"),
    "txn_rollback": ("BEGIN; DELETE FROM supplier; UPDATE nation SET n_name = 'gone'; ROLLBACK;", _NATION, _NATION),
    "savepoint_partial": (
        "BEGIN; INSERT INTO nation VALUES (200, 'KEPT', 0); SAVEPOINT a; INSERT INTO nation VALUES (201, 'LOST', 0); ROLLBACK TO SAVEPOINT a; RELEASE a; COMMIT;", _NATION,
        _NATION + " UNION ALL VALUES (200, 'KEPT', 0)",
    ),
    "insert_default_values": (
        "CREATE TABLE d(a INT DEFAULT 7, b VARCHAR DEFAULT 'x', c DATE); INSERT INTO d DEFAULT VALUES; INSERT INTO d DEFAULT VALUES; INSERT INTO d VALUES (1 + 2, DEFAULT, DATE '2024-02-29'), (4, 'y', NULL);",
        "SELECT a, b, c FROM d", "SELECT * FROM (VALUES (7, 'x', NULL::DATE), (7, 'x', NULL), (3, 'x', DATE '2024-02-29'), (4, 'y', NULL)) v(a, b, c)",
    ),
    "update_clashing_names": (
        "CREATE TABLE w(file_name INT, __hit VARCHAR, file INT, hit INT); INSERT INTO w VALUES (1, 'a', 5, 6), (2, 'b', 7, 8), (3, NULL, 9, 9); UPDATE w SET __hit = 'c', hit = file WHERE file_name = 2; DELETE FROM w WHERE file_name = 3;",
        "SELECT file_name, __hit, file, hit FROM w", "SELECT * FROM (VALUES (1, 'a', 5, 6), (2, 'c', 7, 7)) v(file_name, __hit, file, hit)",
    ),
    "index_clustered": ("CREATE INDEX by_region ON nation(n_regionkey, n_name); CREATE UNIQUE INDEX by_name ON nation(n_name); DROP INDEX by_name;",
                        "SELECT n_nationkey FROM nation WHERE n_regionkey = 3 AND n_name > 'F'", "SELECT n_nationkey FROM nation WHERE n_regionkey = 3 AND n_name > 'F'"),
}


def anti_in_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN by the DataFrame operator: with a null on the right, and without."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey < 200")
    some = relational.anti_in(customers, "c_custkey", orders.select(F.col("o_custkey").alias("k")), "k")
    none = relational.anti_in(customers, "c_custkey", orders.select(F.when(F.col("o_orderkey") > 1, F.col("o_custkey")).alias("k")), "k")
    return some.withColumn("nulls", F.lit(False)).unionByName(none.withColumn("nulls", F.lit(True)))


def explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN ANALYZE tells of one query, as far as it is the same each time: its items, the rows, those of the scan."""
    told = reader(spark, sf_dir, "orders").execute("EXPLAIN ANALYZE SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus;")[0].rows()
    out = [(item, "") for item in sorted({i for i, _ in told} - {"rows", "node"})]
    nodes = [json.loads(x) for i, x in told if i == "node"]
    out += [("rows", x) for i, x in told if i == "rows"]
    out += [("scanned", str(n["rows"])) for n in nodes if n["operator"].startswith("Scan")]
    return spark.createDataFrame(out, "item string, text string")


def refused(session: Session, statements: dict[str, str]) -> list[tuple[str, int]]:
    """The code of the error of each statement, 0 without one."""
    out = []
    for label, text in statements.items():
        try:
            for r in session.execute(text):
                r.rows()
            out.append((label, 0))
        except EngineError as e:
            out.append((label, e.code))
    return out


def constraint_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = store(spark, sf_dir)
    session.execute("CREATE UNIQUE INDEX by_name ON nation(n_name); CREATE TABLE c(a INT CONSTRAINT small CHECK (a < 10), b VARCHAR CHECK (b <> 'SELECT c.a'), CONSTRAINT one UNIQUE(a)); INSERT INTO c VALUES (1, 'c.a');")
    rows = refused(session, {
        "primary": "INSERT INTO nation VALUES (1, 'X', 1);", "not null": "INSERT INTO nation VALUES (900, NULL, 1);", "unique index": "UPDATE nation SET n_name = 'X';",
        "foreign": "INSERT INTO supplier(s_suppkey, s_nationkey) VALUES (900001, 999);", "restrict": "DELETE FROM nation;", "check": "INSERT INTO c VALUES (10, 'x');",
        "check text": "INSERT INTO c VALUES (2, 'SELECT c.a');", "unique": "INSERT INTO c VALUES (1, NULL);", "nulls": "INSERT INTO c VALUES (NULL, NULL), (NULL, NULL);",
        "unknown table": "SELECT x FROM nowhere;", "syntax": "SELEC 1;", "lexical": "SELECT ? FROM c;", "range": "SELECT 99999999999999999999 AS x FROM c;",
    })
    return spark.createDataFrame(rows, "statement string, code int")


def commit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = store(spark, sf_dir)
    done = session.execute("SELECT n_name FROM nation; DELETE FROM supplier; BEGIN; DELETE FROM nation; SAVEPOINT s; ROLLBACK TO s; ROLLBACK; BEGIN; INSERT INTO nation VALUES (300, 'N', 1); COMMIT; CREATE TABLE z(a INT);")
    return spark.createDataFrame([(i, r.kind, r.commit_state) for i, r in enumerate(done)], "place int, kind string, state string")


def checkpoint_open_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session writes while another drops what is old, and commits afterwards; a third reads old files meanwhile."""
    a = store(spark, sf_dir)
    old = Session(spark, a.files.root)
    before = old.sql("SELECT n_nationkey FROM nation")
    a.execute("BEGIN; INSERT INTO nation VALUES (500, 'OPEN', 1); UPDATE nation SET n_name = 'SEEN' WHERE n_nationkey = 3;")
    b = Session(spark, a.files.root)
    b.execute("DELETE FROM supplier; CHECKPOINT;")
    n = before.count()
    lost = refused(a, {"COMMIT": "COMMIT;"})[0][1]
    a.execute("BEGIN; INSERT INTO nation VALUES (500, 'OPEN', 1); UPDATE nation SET n_name = 'SEEN' WHERE n_nationkey = 3;")
    b.execute("CHECKPOINT;")
    a.execute("COMMIT;")
    b.execute("CHECKPOINT;")
    seen = Session(spark, a.files.root).sql("SELECT n_nationkey, n_name FROM nation")
    return seen.withColumn("read_before", F.lit(n)).withColumn("lost", F.lit(lost))


def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = store(spark, sf_dir)
    place = scratch(spark, "backup")
    session.backup(place)
    session.execute("DELETE FROM supplier; DELETE FROM nation WHERE n_nationkey > 3; CREATE TABLE z(a INT); CHECKPOINT;")
    session.restore(place)
    return Session(spark, session.files.root).sql("SELECT n.n_nationkey, n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey")


def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = store(spark, sf_dir)
    session.execute("CREATE UNIQUE INDEX by_region ON nation(n_regionkey, n_name);")
    session.index_rebuild("by_region")
    return session.sql("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3").withColumn("verified", F.lit(session.index_verify("by_region")))


def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, query = store(spark, sf_dir), "SELECT n_name FROM nation WHERE n_regionkey = 1;"
    out = []
    for label, script in (("first", ""), ("again", ""), ("other case", query.replace("1", "1 OR n_name = 'nation_1'")), ("other letters", query.replace("1", "1 OR n_name = 'NATION_1'")), ("after a write", "INSERT INTO nation VALUES (400, 'N', 1);"), ("after attach", "")):
        if label == "after attach":
            session.attach("region", f"{sf_dir}/region.parquet")
        text = script if script.startswith("SELECT") else script + query
        result = session.execute(text)[-1]
        out.append((label, result.cached is not None, len(result.rows())))
    return spark.createDataFrame(out, "label string, was_cached boolean, n int")


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user may do: nothing without a grant, also not by way of subqueries, statistics or own grants."""
    owner = store(spark, sf_dir)
    owner.grant("bob", "DELETE", "supplier")
    owner.grant("readers", "SELECT", "nation")
    owner.join_role("ann", "readers")
    attempts = {
        "read": "SELECT n_name FROM nation;", "join": "SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey;", "delete": "DELETE FROM supplier WHERE s_suppkey < 0;",
        "delete all": "DELETE FROM supplier;", "spy": "DELETE FROM supplier WHERE EXISTS (SELECT n_name FROM nation WHERE n_name LIKE 'A%');",
        "insert": "INSERT INTO nation VALUES (1000, 'X', 1);", "analyze": "ANALYZE TABLE nation;", "create": "CREATE TABLE mine(a INT);", "checkpoint": "CHECKPOINT;",
    }
    out = []
    for user in ("ann", "bob"):
        session = Session(spark, owner.files.root, user=user)
        out += [(user, label, code) for label, code in refused(session, attempts)]
        for label, act in (("grant", lambda s: s.grant(s.user, "ALL")), ("backup", lambda s: s.backup(scratch(spark, "stolen")))):
            try:
                act(session)
                out.append((user, label, 0))
            except EngineError as e:
                out.append((user, label, e.code))
    return spark.createDataFrame(out, "who string, attempt string, code int")


def row_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark, row_budget=25).attach_directory(sf_dir, ["nation", "customer"])
    return spark.createDataFrame(refused(session, {"fits": "SELECT n_name FROM nation;", "too many": "SELECT c_name FROM customer;", "counted": "SELECT COUNT(*) AS n FROM customer;"}), "query string, code int")


def csv_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark, "csv")
    external.write_csv(reader(spark, sf_dir, "customer").sql("SELECT c_custkey, c_name, c_acctbal FROM customer"), place)
    return spark.read.option("header", True).schema("c_custkey bigint, c_name string, c_acctbal double").csv(place)


def sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their places in the order they come in."""
    session = reader(spark, sf_dir, "nation region")
    text = "SELECT n.n_regionkey, r.r_name, n.n_nationkey FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey > 1 ORDER BY r.r_name DESC, n.n_nationkey LIMIT 20 OFFSET 2"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(session.execute(text + ";")[0].rows())], "place int, n_regionkey int, r_name string, n_nationkey int")


def analyze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = store(spark, sf_dir)
    session.execute("ANALYZE TABLE nation;")
    s = session.statistics("nation")
    rows = [(c, s["rows"], x["nulls"], x["distinct"], str(x["least"]), str(x["greatest"])) for c, x in s["columns"].items()]
    return spark.createDataFrame(rows, "column_name string, n_rows long, nulls long, distinct_values long, least string, greatest string")


def index_advisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = store(spark, sf_dir)
    for _ in range(2):
        session.execute("SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 3;")
    rows = [(a["table"], a["column"], a["queries"]) for a in session.index_advice()]
    return spark.createDataFrame(rows, "table_name string, column_name string, n long")


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result frames of one query: their places, kinds and values."""
    session = reader(spark, sf_dir, "nation")
    lines = [(i, x) for i, x in enumerate(session.stream("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey"))]
    frame = lambda c: F.get_json_object("frame", f"$.{c}")
    return spark.createDataFrame(lines, "line int, frame string").select("line", frame("frame").alias("frame"), F.coalesce(frame("values"), frame("columns"), frame("rows")).alias("content"))


def plan_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled plan that went through JSON, run again from its tree after its fingerprint was checked."""
    session = reader(spark, sf_dir, "region nation")
    text = "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0 AND r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name LIKE 'N%');"
    document = json.loads(json.dumps(session.compile(text)))
    for statement in document["statements"]:
        statement["text"] = ""
    return session.execute_plan(document)[0].data


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


_ONLY: dict[str, tuple[Callable, str | None]] = {
    "anti_not_in_null": (anti_in_frames, """SELECT c_custkey, FALSE AS nulls FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 200)
UNION ALL SELECT c_custkey, TRUE FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey > 1 THEN o_custkey END FROM orders WHERE o_orderkey < 200)"""),
    "explain_rows": (explain_rows, """SELECT unnest(['estimate', 'milliseconds', 'optimized', 'physical', 'raw', 'rule']) AS item, '' AS text
UNION ALL SELECT 'rows', CAST(COUNT(DISTINCT o_orderstatus) AS VARCHAR) FROM orders UNION ALL SELECT 'scanned', CAST(COUNT(*) AS VARCHAR) FROM orders"""),
    "constraint_errors": (constraint_errors, _values([
        ("primary", 5001), ("not null", 5001), ("unique index", 5001), ("foreign", 5001), ("restrict", 5001), ("check", 5001), ("check text", 5001), ("unique", 5001), ("nulls", 0),
        ("unknown table", 2003), ("syntax", 2002), ("lexical", 2001), ("range", 2004)], "statement, code")),
    "commit_states": (commit_states, _values([
        (0, "SELECT", "none"), (1, "DELETE", "committed"), (2, "BEGIN", "pending"), (3, "DELETE", "pending"), (4, "SAVEPOINT", "pending"), (5, "ROLLBACK_TO", "pending"),
        (6, "ROLLBACK", "rolledBack"), (7, "BEGIN", "pending"), (8, "INSERT", "pending"), (9, "COMMIT", "committed"), (10, "CREATE TABLE", "committed")], "place, kind, state")),
    "checkpoint_open_txn": (checkpoint_open_txn, """WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'SEEN' ELSE n_name END AS n_name FROM nation UNION ALL VALUES (500, 'OPEN'))
SELECT *, (SELECT COUNT(*) FROM nation)::INT AS read_before, 6001 AS lost FROM n"""),
    "backup_restore": (backup_restore, "SELECT n.n_nationkey, n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey"),
    "index_rebuild": (index_rebuild, "SELECT n_nationkey, n_name, TRUE AS verified FROM nation WHERE n_regionkey = 3"),
    "result_cache": (result_cache, """WITH k AS (SELECT CAST(COUNT(*) FILTER (n_regionkey = 1) AS INT) AS n, CAST(COUNT(*) FILTER (n_regionkey = 1 OR n_name = 'nation_1') AS INT) AS lower_case, CAST(COUNT(*) FILTER (n_regionkey = 1 OR n_name = 'NATION_1') AS INT) AS upper_case FROM nation)
SELECT 'first' AS label, FALSE AS was_cached, n FROM k UNION ALL SELECT 'again', TRUE, n FROM k UNION ALL SELECT 'other case', FALSE, lower_case FROM k UNION ALL SELECT 'other letters', FALSE, upper_case FROM k
UNION ALL SELECT 'after a write', FALSE, n + 1 FROM k UNION ALL SELECT 'after attach', FALSE, n + 1 FROM k"""),
    "access": (access, _values([
        *[("ann", x, 0 if x == "read" else 7001) for x in ("read", "join", "delete", "delete all", "spy", "insert", "analyze", "create", "checkpoint", "grant", "backup")],
        *[("bob", x, 0 if x == "delete all" else 7001) for x in ("read", "join", "delete", "delete all", "spy", "insert", "analyze", "create", "checkpoint", "grant", "backup")]], "who, attempt, code")),
    "row_budget": (row_budget, _values([("fits", 0), ("too many", 5002), ("counted", 0)], "query, code")),
    "csv_out": (csv_out, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "sorted_lines": (sorted_lines, """SELECT CAST(row_number() OVER () - 1 AS INT) AS place, * FROM (SELECT n.n_regionkey, r.r_name, n.n_nationkey FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey > 1
ORDER BY r.r_name DESC NULLS FIRST, n.n_nationkey LIMIT 20 OFFSET 2)"""),
    "analyze_stats": (analyze_stats, """SELECT 'n_nationkey' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT(n_nationkey) AS nulls, COUNT(DISTINCT n_nationkey) AS distinct_values, CAST(MIN(n_nationkey) AS VARCHAR) AS least, CAST(MAX(n_nationkey) AS VARCHAR) AS greatest FROM nation
UNION ALL SELECT 'n_name', COUNT(*), COUNT(*) - COUNT(n_name), COUNT(DISTINCT n_name), MIN(n_name), MAX(n_name) FROM nation
UNION ALL SELECT 'n_regionkey', COUNT(*), COUNT(*) - COUNT(n_regionkey), COUNT(DISTINCT n_regionkey), CAST(MIN(n_regionkey) AS VARCHAR), CAST(MAX(n_regionkey) AS VARCHAR) FROM nation"""),
    "index_advisor": (index_advisor, "SELECT 'nation' AS table_name, unnest(['n_regionkey', 'n_nationkey']) AS column_name, CAST(2 AS BIGINT) AS n"),
    "stream_rows": (stream_rows, """SELECT 0 AS line, 'meta' AS frame, '["n_nationkey","n_name"]' AS content
UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT), 'row', '[' || n_nationkey || ',"' || n_name || '"]' FROM nation UNION ALL SELECT CAST(COUNT(*) + 1 AS INT), 'complete', CAST(COUNT(*) AS VARCHAR) FROM nation"""),
    "plan_document": (plan_document, "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0 AND r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name LIKE 'N%')"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: run_sql(v if isinstance(v, str) else v[0]) for k, v in SQL.items()}
    found |= {k: after(script, query) for k, (script, query, _) in STORED.items()}
    return found | {k: f for k, (f, _) in _ONLY.items()}


def oracle() -> dict[str, str]:
    found = {k: v if isinstance(v, str) else v[1] for k, v in SQL.items()}
    found |= {k: sql for k, (_, _, sql) in STORED.items()}
    return found | {k: sql for k, (_, sql) in _ONLY.items() if sql}
