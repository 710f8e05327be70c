"""A session: scripts in, results out.

SQL is parsed, strictly checked and lowered to Spark SQL here; Spark plans and runs it.  Without
a root the session only reads foreign tables; with one it keeps tables of its own.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .functions import scalar
from .plans import ast, lower, statistics
from .plans import types as t
from .plans.lexer import tokens
from .plans.parser import diagnose, parse, parse_expression
from .sources import external
from .sources.catalog import Catalog, Column, Index, Rule, State, TableDef
from .sources.files import Files
from .sources.places import scratch
from .sources.tables import Tables
from .streaming import results

#: What the dialect's rules need of Spark.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
}
CACHED_ROWS = 1000
ACTIONS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ADMIN", "ALL")


def own_session(spark: SparkSession) -> SparkSession:
    """A new Spark session with the caller's settings, but for those that the dialect needs."""
    made = spark.newSession()
    for k, v in {**spark.conf.getAll, **SETTINGS}.items():
        if made.conf.isModifiable(k) and made.conf.get(k, None) != v:
            made.conf.set(k, v)
    return made


@dataclass
class StatementResult:
    kind: str
    columns: list[str] = field(default_factory=list)
    column_types: list[str] = field(default_factory=list)
    data: DataFrame | None = None
    affected_rows: int | None = None
    commit_state: str = "none"  # none pending committed rolledBack unknown
    cached: list[tuple] | None = None
    fetch: Callable[[StatementResult], list[tuple]] | None = None

    def rows(self) -> list[tuple]:
        if self.cached is not None:
            return self.cached
        if self.fetch is not None:
            return self.fetch(self)
        return [tuple(r) for r in self.data.collect()] if self.data is not None else []


def metrics(plan, depth: int = 0) -> list[dict]:
    """What the operators of a plan that ran have counted, from the root down."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return metrics(plan.executedPlan(), depth)
    if kind.endswith("QueryStageExec"):
        return metrics(plan.plan(), depth)
    found = {"depth": depth, "operator": plan.nodeName()}
    entries = plan.metrics().toSeq()
    for i in range(entries.size()):
        name, metric = entries.apply(i)._1(), entries.apply(i)._2()
        if name == "numOutputRows":
            found["rows"] = metric.value()
        elif metric.metricType() == "timing":
            found["ms"] = max(0, metric.value())
        elif metric.metricType() == "nsTiming":
            found["ms"] = max(0, metric.value()) // 1_000_000
    below = plan.children()
    return [found, *(x for i in range(below.size()) for x in metrics(below.apply(i), depth + 1))]


class Names:
    """The tables that a session sees, as the checker asks for them."""

    def __init__(self, session: Session):
        self.session = session

    def __call__(self, name: str) -> lower.Table | None:
        return self.session.lookup(name)

    def names(self) -> list[str]:
        own = [x.name for x in self.session.state.tables.values()]
        return own + [x.name for x in self.session.foreign.values()]


class Session:
    """Settings that the dialect needs hold in a Spark session of its own, and leave the caller's as it is.

    timeout (seconds) bounds the time of a statement and of fetching its rows, row_budget the rows that are
    fetched; what goes beyond is cancelled with an error.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, user: str | None = None, timeout: float | None = None, row_budget: int | None = None):
        self.spark, self.user, self.timeout, self.row_budget = own_session(spark), user, timeout, row_budget
        spark = self.spark
        self.id = f"lodestone_{uuid.uuid4().hex[:12]}"
        self.foreign: dict[str, lower.Table] = {}
        self.files = Files(spark, root) if root else None
        self.tables = Tables(spark, self.files) if root else None
        self.catalog = Catalog(self.files) if root else None
        self.staged: State | None = None  # of an open transaction
        self.aborted = False
        self.cancelled = False
        self.savepoints: list[tuple[str, State]] = []
        self.cache: dict[tuple, tuple[StatementResult, list[tuple]]] = {}
        self.workload: Counter = Counter()
        self.views: dict[str, tuple] = {}

    # --- tables ---

    @property
    def state(self) -> State:
        return self.staged or (self.catalog.state if self.catalog else State())

    def attach(self, name: str, path: str, dates: Collection[str] = ()) -> None:
        """Make a Parquet path readable as a table; of its timestamps, those named in dates are seen as dates."""
        self.cache.clear()
        self.foreign[name.lower()] = external.register(self.spark, path, name, f"{self.id}_x_{name.lower()}", dates)

    def attach_directory(self, folder: str, names, dates: dict[str, Collection[str]] | None = None) -> Session:
        for n in names:
            self.attach(n, f"{folder}/{n}.parquet", (dates or {}).get(n, ()))
        return self

    def lookup(self, name: str) -> lower.Table | None:
        own = self.state.table(name)
        if own is None:
            return self.foreign.get(name.lower())
        view, mark = f"{self.id}_t_{own.name.lower()}", tuple(own.files)
        if self.views.get(view) != mark:
            self.tables.read(own).createOrReplaceTempView(view)
            self.views[view] = mark
        return lower.Table(own.name, view, [(c.name, c.kind) for c in own.columns])

    def need_table(self, name: str, node: ast.Node) -> TableDef:
        found = self.state.table(name)
        if found is None:
            what = "is read-only" if name.lower() in self.foreign else "is unknown"
            raise EngineError("Semantic", f"table {name} {what}", node.line, node.column)
        return found

    # --- queries ---

    def lowered(self, node: ast.Select) -> lower.Query:
        q = lower.Lowering(Names(self)).select(node)
        self.allow("SELECT", q.tables)
        return q

    def sql(self, text: str) -> DataFrame:
        """The DataFrame of one SELECT; nothing runs until it is used."""
        statements = parse(text if text.rstrip().endswith(";") else text + ";").statements
        if len(statements) != 1 or not isinstance(statements[0], ast.Select):
            raise EngineError("InvalidArgument", "one SELECT is expected")
        return self.spark.sql(self.lowered(statements[0]).sql)

    def execute(self, script: str) -> list[StatementResult]:
        """Run a script, statement by statement.  An error ends it and rolls an open transaction back."""
        parsed = parse(script)
        out = []
        for node, text in zip(parsed.statements, parsed.texts):
            out.append(self.statement(node, text))
        return out

    def run_script(self, script: str) -> list[StatementResult]:
        """execute(), and an error if the script leaves a transaction open."""
        out = self.execute(script)
        if self.staged is not None:
            self.rollback()
            raise EngineError("Transaction", "the script ended in a transaction, which was rolled back")
        return out

    def statement(self, node: ast.Node, text: str) -> StatementResult:
        if self.aborted and not (isinstance(node, ast.Transaction) and node.action in ("ROLLBACK", "ROLLBACK_TO")):
            raise EngineError("Transaction", "the transaction has failed; ROLLBACK first", node.line, node.column)
        try:
            with self.bounded():
                return self._statement(node, text)
        except EngineError:
            self._failed(node)
            raise
        except Exception as e:
            self._failed(node)
            raise EngineError("Execution", str(e).split("\n")[0], node.line, node.column) from e

    @contextlib.contextmanager
    def bounded(self) -> Iterator[None]:
        """Cancel what runs inside after the time that the session allows."""
        self.cancelled = False
        timer = threading.Timer(self.timeout, self.cancel) if self.timeout else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            yield
        except Exception as e:
            if self.cancelled:
                raise EngineError("Cancelled", "the statement was cancelled") from e
            raise
        finally:
            if timer:
                timer.cancel()
        if self.cancelled:
            raise EngineError("Cancelled", "the statement was cancelled")

    def _failed(self, node: ast.Node) -> None:
        if self.staged is not None and not isinstance(node, ast.Transaction):
            self.aborted = True

    def _statement(self, node: ast.Node, text: str) -> StatementResult:
        if isinstance(node, ast.Select):
            return self.query(node, text)
        if isinstance(node, ast.Explain):
            return self.explain(node)
        if isinstance(node, ast.Transaction):
            return self.transaction(node)
        if self.catalog is None:
            raise EngineError("Storage", "this session has no place for tables", node.line, node.column)
        if isinstance(node, ast.Analyze):
            return self.analyze(node)
        if self.staged is None:
            self.catalog.hold(writing=True)
        try:
            return self._change(node)
        finally:
            if self.staged is None:
                self.catalog.hold(writing=False)

    def _change(self, node: ast.Node) -> StatementResult:
        work = self.state.copy()
        kind, n = {
            ast.Insert: self.insert, ast.Update: self.update, ast.Delete: self.delete,
            ast.CreateTable: self.create_table, ast.CreateIndex: self.create_index, ast.DropIndex: self.drop_index,
        }[type(node)](node, work)
        return StatementResult(kind, affected_rows=n, commit_state=self.publish(work))

    def publish(self, work: State) -> str:
        self.cache.clear()
        if self.staged is not None:
            self.staged = work
            return "pending"
        self.catalog.commit(work)
        return "committed"

    def query(self, node: ast.Select, text: str) -> StatementResult:
        if self.staged is None and self.catalog is not None and self.catalog.refresh():
            self.cache.clear()
        q = self.lowered(node)
        self.workload.update(q.filtered)
        key = self.key(text)
        if self.staged is None and key in self.cache:
            made, rows = self.cache[key]
            return StatementResult("SELECT", made.columns, made.column_types, made.data, cached=rows)
        data = self.spark.sql(q.sql)
        # files of foreign tables may change unseen, so only results of stored tables are kept
        stored = self.staged is None and all(self.state.table(n) for n in q.tables)

        def fetch(result: StatementResult) -> list[tuple]:
            with self.bounded():
                if self.row_budget is None:
                    rows = [tuple(r) for r in result.data.collect()]
                else:
                    rows = [tuple(r) for r in result.data.take(self.row_budget + 1)]
                    if len(rows) > self.row_budget:
                        raise EngineError("Cancelled", f"the result has over {self.row_budget} rows")
            result.cached = rows
            if stored and len(rows) <= CACHED_ROWS and self.staged is None and key == self.key(text):
                self.cache[key] = (result, rows)
            return rows

        return StatementResult("SELECT", [c for c, _ in q.columns], [str(k) for _, k in q.columns], data, fetch=fetch)

    def key(self, text: str) -> tuple:
        """What a result is kept under: the version read and the tokens, string literals and names as they are written."""
        return self.state.version, tuple((k.kind, k.text if k.kind in ("string", "identifier") else k.upper) for k in tokens(text) if k.text != ";")

    def remember(self, text: str, result: StatementResult) -> list[tuple]:
        """Rows of a result, kept for the next time if they are few and no transaction is open."""
        return result.rows()

    def stream(self, text: str, limit: int | None = 100_000) -> Iterator[str]:
        """One SELECT as lines of JSON, fetched as they are read."""
        node = parse(text if text.rstrip().endswith(";") else text + ";").statements[0]
        if not isinstance(node, ast.Select):
            raise EngineError("InvalidArgument", "only a SELECT can be streamed")
        q = self.lowered(node)
        return results.ndjson(self.spark.sql(q.sql), [c for c, _ in q.columns], [str(k) for _, k in q.columns], limit)

    def cancel(self) -> None:
        """Stop what this session runs; other sessions go on."""
        self.cancelled = True
        self.spark.interruptAll()

    # --- plans ---

    def compile(self, text: str) -> dict:
        """Tokens, statements, Spark SQL, Spark's plans, and the schema's fingerprint."""
        parsed = parse(text)
        out = {"schemaVersion": 1, "fingerprint": self.fingerprint(), "tokens": [[k.kind, k.text, k.line, k.column] for k in tokens(text)], "statements": []}  # all of it is JSON
        for node, source in zip(parsed.statements, parsed.texts):
            entry = {"kind": type(node).__name__, "text": source, "ast": ast.dump(node)}
            if isinstance(node, ast.Select):
                q = self.lowered(node)
                plan = self.spark.sql(q.sql)._jdf.queryExecution()
                entry |= {"sparkSql": q.sql, "columns": [[c, str(k)] for c, k in q.columns], "plan": plan.analyzed().toString(), "optimizedPlan": plan.optimizedPlan().toString()}
            out["statements"].append(entry)
        return out

    def fingerprint(self) -> str:
        foreign = [[x.name, [[c, str(k)] for c, k in x.columns]] for _, x in sorted(self.foreign.items())]
        return hashlib.sha256((self.state.fingerprint() + json.dumps(foreign)).encode()).hexdigest()

    def execute_plan(self, document: dict) -> list[StatementResult]:
        """Run the statements that compile() gave, from their trees and not their text, if the schema is still the same."""
        if document.get("schemaVersion") != 1:
            raise EngineError("InvalidArgument", "this is no plan document of version 1")
        if document.get("fingerprint") != self.fingerprint():
            raise EngineError("PlanStaleSchema", "the schema has changed since the plan was compiled")
        try:
            nodes = [(ast.load(s["ast"]), s["text"]) for s in document["statements"]]
        except (KeyError, TypeError, ValueError) as e:
            raise EngineError("InvalidArgument", f"the plan document is damaged: {e}") from e
        return [self.statement(node, text) for node, text in nodes]

    def explain(self, node: ast.Explain) -> StatementResult:
        """Rows (item, text): Spark's plans before and after its rules, the rules that changed something, sizes as
        Spark estimates them, and the indexes that a filter could use with the rows that statistics promise.

        With ANALYZE the query runs once, and ``node`` rows hold what each operator of the plan that ran has counted.
        """
        inner = node.statement
        if not isinstance(inner, ast.Select):
            if node.analyze:
                raise EngineError("Semantic", "EXPLAIN ANALYZE takes a SELECT", node.line, node.column)
            rows = [("statement", type(inner).__name__), ("tree", json.dumps(ast.dump(inner)))]
        else:
            q = self.lowered(inner)
            plan = self.spark.sql(q.sql)._jdf.queryExecution()
            rows = [("raw", plan.analyzed().toString()), ("optimized", plan.optimizedPlan().toString())]
            plan.executedPlan()
            for line in sorted(plan.tracker().rules().mkString("\n").split("\n")):
                rule, _, summary = line.partition(" -> ")
                effective = summary.rstrip(")").rpartition(",")[2].strip()
                if effective.isdigit() and int(effective):
                    rows.append(("rule", f"{rule.rpartition('.')[2]}: {effective}"))
            rows.append(("estimate", plan.optimizedPlan().stats().simpleString()))
            rows += [("candidate", json.dumps(c)) for c in self.candidates(q)]
            if node.analyze:
                began = time.time()
                with self.bounded():
                    n = plan.toRdd().count()
                rows.append(("milliseconds", str(round(1000 * (time.time() - began)))))
                rows.append(("rows", str(n)))
                rows += [("node", json.dumps(x)) for x in metrics(plan.executedPlan())]
            rows.append(("physical", plan.executedPlan().toString()))
        data = self.spark.createDataFrame(rows, "item string, text string")
        return StatementResult("EXPLAIN", ["item", "text"], ["VARCHAR", "VARCHAR"], data, cached=rows)

    def candidates(self, q: lower.Query) -> list[dict]:
        """Ways to read each stored table of a query: all of it, or by an index on a column that is compared."""
        out = []
        for name in sorted(q.tables):
            table = self.state.table(name)
            if table is None:
                continue
            known = table.statistics
            rows = known["rows"] if known else None
            out.append({"table": table.name, "by": "scan", "files": len(table.files), "rows": rows})
            compared = {c.lower() for view, c in q.filtered if view == f"{self.id}_t_{table.name.lower()}"}
            for i in table.indexes:
                if i.columns[0].lower() in compared:
                    distinct = known["columns"][i.columns[0]]["distinct"] if known else None
                    out.append({"table": table.name, "by": i.name, "files": len(table.files), "rows": None if not distinct else -(-rows // distinct)})
        return out

    def diagnostics(self, text: str) -> list[EngineError]:
        """Every syntax error of a script; without any, every semantic error of its queries."""
        found = diagnose(text)
        if found:
            return found
        for node in parse(text).statements:
            try:
                if isinstance(node, ast.Select):
                    self.lowered(node)
                elif isinstance(node, (ast.Insert, ast.Update, ast.Delete)):
                    self.need_table(node.table if isinstance(node, ast.Insert) else self.target(node.target, node)[0], node)
            except EngineError as e:
                found.append(e)
        return found[:100]

    # --- transactions ---

    def transaction(self, node: ast.Transaction) -> StatementResult:
        at = (node.line, node.column)
        action = node.action
        if self.catalog is None:
            raise EngineError("Storage", "this session has no place for tables", *at)
        if action == "CHECKPOINT":
            self.allow("ADMIN", set())
            if self.staged is not None:
                raise EngineError("Transaction", "CHECKPOINT cannot stand in a transaction", *at)
            return StatementResult("CHECKPOINT", affected_rows=self.catalog.checkpoint())
        if action == "BEGIN":
            if self.staged is not None:
                raise EngineError("Transaction", "a transaction is open already", *at)
            self.catalog.state = self.catalog.load()
            self.catalog.hold(writing=True)
            self.staged, self.savepoints = self.catalog.state.copy(), []
            return StatementResult("BEGIN", commit_state="pending")
        if self.staged is None:
            raise EngineError("Transaction", f"{action} needs a transaction", *at)
        if action == "COMMIT":
            work, self.staged, self.savepoints = self.staged, None, []
            self.cache.clear()
            try:
                self.catalog.commit(work)
            finally:
                self.catalog.hold(writing=False)
            return StatementResult("COMMIT", commit_state="committed")
        if action == "ROLLBACK":
            self.rollback()
            return StatementResult("ROLLBACK", commit_state="rolledBack")
        if action == "SAVEPOINT":
            self.savepoints.append((node.name.lower(), self.staged.copy()))
            return StatementResult("SAVEPOINT", commit_state="pending")
        at_name = [i for i, (n, _) in enumerate(self.savepoints) if n == node.name.lower()]
        if not at_name:
            raise EngineError("Transaction", f"there is no savepoint {node.name}", *at)
        if action == "RELEASE":
            del self.savepoints[at_name[-1] :]
        else:
            self.staged, self.aborted = self.savepoints[at_name[-1]][1].copy(), False
            del self.savepoints[at_name[-1] + 1 :]
        self.cache.clear()
        return StatementResult(action, commit_state="pending")

    def rollback(self) -> None:
        self.staged, self.aborted, self.savepoints = None, False, []
        self.cache.clear()
        if self.catalog is not None:
            self.catalog.hold(writing=False)

    def close(self) -> None:
        if self.staged is not None:
            self.rollback()
        if self.catalog is not None:
            self.catalog.release()
        for view in [*self.views, *(x.view for x in self.foreign.values())]:
            self.spark.catalog.dropTempView(view)

    # --- writes ---

    def stored(self, value: lower.Typed, column: Column, node: ast.Node) -> str:
        """SQL of a value as a column keeps it; what would lose digits or characters is an error."""
        target, at = column.kind, (node.line, node.column)
        if not t.assignable(value.type, target):
            raise EngineError("Semantic", f"{value.type} cannot be stored in {column.name} {target}", *at)
        if value.type.name == "VARCHAR" and target.a:
            return scalar.fail_unless(f"length({value.sql}) <= {target.a}", value.sql, f"{column.name} holds {target.a} characters", "STRING")
        return f"CAST({value.sql} AS {target.spark})"

    def default(self, column: Column) -> str:
        value = lower.literal(parse_expression(column.default)) if column.default is not None else lower.Typed("NULL", t.NULL)
        return f"CAST({value.sql} AS {column.kind.spark})"

    def insert(self, node: ast.Insert, work: State) -> tuple[str, int]:
        table = self.need_table(node.table, node)
        self.allow("INSERT", {table.name})
        names = node.columns or tuple(c.name for c in table.columns)
        chosen = []
        for n in names:
            c = table.column(n)
            if c is None or c in chosen:
                raise EngineError("Semantic", f"column {n} is {'named twice' if c else 'unknown'}", node.line, node.column)
            chosen.append(c)
        lowering, scope = lower.Lowering(Names(self)), lower.Scope()
        rows = []
        for row in node.rows if node.rows is not None else [()]:
            if node.rows is not None and len(row) != len(chosen):
                raise EngineError("Semantic", f"{len(row)} values for {len(chosen)} columns", node.line, node.column)
            given = {}
            for c, v in zip(chosen, row):
                given[c.name] = self.default(c) if isinstance(v, ast.Default) else self.stored(lowering.expr(scope, v, aggregates=False), c, v)
            rows.append([given.get(c.name) or self.default(c) for c in table.columns])
        heads = ", ".join(scalar.name(c.name) for c in table.columns)
        self.allow("SELECT", lowering.used)
        simple = node.rows is not None and all(isinstance(v, ast.Literal) for r in node.rows for v in r)
        if simple and not any("raise_error" in x for r in rows for x in r):
            values = ", ".join(f"({', '.join(r)})" for r in rows)
            data = self.spark.sql(f"SELECT * FROM VALUES {values} AS v({heads})")
        else:
            # rows without a subquery are one array, so that they are one task whatever their number
            plain = [r for r, given in zip(rows, node.rows or [()]) if not ast.has_query(given)]
            parts = ["SELECT " + ", ".join(f"{x} AS {scalar.name(c.name)}" for x, c in zip(r, table.columns)) for r, given in zip(rows, node.rows or [()]) if ast.has_query(given)]
            if plain:
                each = ", ".join(f"struct({', '.join(r)})" for r in plain)
                parts.append(f"SELECT v.* FROM (SELECT explode(array({each})) AS r) LATERAL VIEW inline(array(r)) v AS {heads}")
            data = self.spark.sql(" UNION ALL ".join(parts))
        target = work.table(table.name)
        before = set(target.files)
        target.files = self.tables.append(target, data)
        self.changed(work, target, [f for f in target.files if f not in before], shrinks=False)
        return "INSERT", len(rows)

    def load(self, name: str, rows: DataFrame) -> None:
        """Append a DataFrame to a table, by column name; what the table lacks is left out, what the
        rows lack is null.  Constraints are checked as for INSERT."""
        work = self.state.copy()
        table = work.table(name)
        if table is None:
            raise EngineError("Semantic", f"table {name} is unknown")
        self.allow("INSERT", {table.name})
        if self.staged is None:
            self.catalog.hold(writing=True)
        have = {c.lower() for c in rows.columns}
        data = rows.select(*[F.col(c.name).cast(c.kind.spark).alias(c.name) if c.name.lower() in have else F.lit(None).cast(c.kind.spark).alias(c.name) for c in table.columns])
        before = set(table.files)
        table.files = self.tables.append(table, data)
        self.changed(work, table, [f for f in table.files if f not in before], shrinks=False)
        self.publish(work)

    def changed(self, work: State, table: TableDef, new: list[str], shrinks: bool) -> None:
        table.statistics = None
        if new:
            self.tables.verify(work, table, new)
        if shrinks:
            self.tables.referenced(work, table)

    def target(self, source: ast.Source, node: ast.Node) -> tuple[str, str, ast.Node | None]:
        """Table, alias and own condition of an UPDATE's or DELETE's target."""
        if source.query is None:
            return source.table, source.alias or source.table, None
        q = source.query
        plain = (
            not q.ctes and not q.distinct and not q.joins and not q.group and q.having is None and not q.order and q.limit is None
            and q.offset is None and q.source.query is None and len(q.items) == 1 and isinstance(q.items[0].value, ast.Star)
        )
        if not plain:
            raise EngineError("Semantic", "only SELECT * FROM table [WHERE ...] can be changed", node.line, node.column)
        return q.source.table, source.alias, q.where

    def condition(self, table: TableDef, alias: str, inner: ast.Node | None, outer: ast.Node | None, node: ast.Node) -> tuple[str, lower.Lowering, lower.Scope]:
        lowering = lower.Lowering(Names(self))
        scope = lower.Scope([lower.Relation(alias, [(c.name, c.kind) for c in table.columns])])
        scope.froms[alias] = f"{scalar.name(self.lookup(table.name).view)} AS {scalar.name(alias)}"
        tests = []
        for part in (inner, outer):
            if part is not None:
                typed = lowering.expr(scope, part, aggregates=False)
                lowering.boolean(typed, (part.line, part.column))
                tests.append(typed.sql)
        # a condition tells about the rows it reads
        self.allow("SELECT", lowering.used | ({table.name} if tests else set()))
        return " AND ".join(tests) or "true", lowering, scope

    def rewrite(self, work: State, table: TableDef, alias: str, test: str, shown: list[str] | None) -> int:
        """Copy-on-write: rows for which test is true get the expressions, or go if there are none."""
        spark, view = self.spark, f"{self.id}_work"
        keys = ", ".join(scalar.name(c.name) for c in table.columns)
        if not table.files:
            return 0
        self.lookup(table.name)
        taken = {c.name.lower() for c in table.columns}
        spare = lambda name: name if name not in taken else spare(name + "_")
        file, hit = spare("file"), spare("hit")
        stored = self.tables.read(table)
        stored.select("*", stored.metadataColumn("_metadata").getField("file_name").alias(file)).createOrReplaceTempView(view)
        touched = spark.sql(f"SELECT {file} AS file_name, count(1) AS n FROM {view} AS {scalar.name(alias)} WHERE {test} GROUP BY {file}").collect()
        names = {r["file_name"] for r in touched}
        old = [f for f in table.files if f.rsplit("/", 1)[1] in names]
        if old:
            self.tables.subset(table, old).createOrReplaceTempView(view)
            if shown is None:
                # the test may hold subqueries, which Spark takes in WHERE only
                data = spark.sql(f"SELECT {keys} FROM {view} AS {scalar.name(alias)} WHERE NOT coalesce({test}, false)")
            else:
                flagged = f"SELECT *, coalesce({test}, false) AS {hit} FROM {view} AS {scalar.name(alias)}"
                each = ", ".join(f"CASE WHEN {hit} THEN {x} ELSE {scalar.name(alias)}.{scalar.name(c.name)} END AS {scalar.name(c.name)}" if x else f"{scalar.name(alias)}.{scalar.name(c.name)}" for x, c in zip(shown, table.columns))
                data = spark.sql(f"SELECT {each} FROM ({flagged}) AS {scalar.name(alias)}")
            new = self.tables.write(table, data)
            target = work.table(table.name)
            target.files = [f for f in table.files if f not in old] + new
            self.changed(work, target, new if shown is not None else [], shrinks=True)
        spark.catalog.dropTempView(view)
        return sum(r["n"] for r in touched)

    def update(self, node: ast.Update, work: State) -> tuple[str, int]:
        name, alias, inner = self.target(node.target, node)
        table = self.need_table(name, node)
        self.allow("UPDATE", {table.name})
        test, lowering, scope = self.condition(table, alias, inner, node.where, node)
        shown: dict[str, str] = {}
        for n, v in node.assignments:
            c = table.column(n)
            if c is None or c.name in shown:
                raise EngineError("Semantic", f"column {n} is {'set twice' if c else 'unknown'}", node.line, node.column)
            shown[c.name] = self.default(c) if isinstance(v, ast.Default) else self.stored(lowering.expr(scope, v, aggregates=False), c, v)
        reads = any(isinstance(n, ast.Name) for _, v in node.assignments for n in ast.walk(v))
        self.allow("SELECT", lowering.used | ({table.name} if reads else set()))
        return "UPDATE", self.rewrite(work, table, alias, test, [shown.get(c.name) for c in table.columns])

    def delete(self, node: ast.Delete, work: State) -> tuple[str, int]:
        name, alias, inner = self.target(node.target, node)
        table = self.need_table(name, node)
        self.allow("DELETE", {table.name})
        test, _, _ = self.condition(table, alias, inner, node.where, node)
        return "DELETE", self.rewrite(work, table, alias, test, None)

    # --- definitions ---

    def create_table(self, node: ast.CreateTable, work: State) -> tuple[str, int]:
        at = (node.line, node.column)
        self.allow("CREATE", set())
        if work.table(node.name) or node.name.lower() in self.foreign:
            raise EngineError("Semantic", f"table {node.name} exists already", *at)
        labels = [c.name.lower() for c in node.columns]
        if not labels or len(set(labels)) < len(labels):
            raise EngineError("Semantic", "a table needs columns of different names", *at)
        table = TableDef(node.name, [])
        for c in node.columns:
            kind = t.of_ast(c.type)
            column = Column(c.name, str(kind), c.nullable is not False)
            if c.default is not None:
                value = lower.literal(c.default)
                if not t.assignable(value.type, kind):
                    raise EngineError("Semantic", f"{value.type} is no default of {c.name} {kind}", c.line, c.column)
                v = c.default
                column.default = {"string": lambda: "'" + v.value.replace("'", "''") + "'", "date": lambda: f"DATE '{v.value}'", "null": lambda: "NULL", "bool": lambda: str(v.value).upper()}.get(v.kind, lambda: str(v.value))()
            table.columns.append(column)
        scope = lower.Scope([lower.Relation(node.name, [(c.name, c.kind) for c in table.columns])])
        for k, r in enumerate(node.constraints, 1):
            here = (r.line, r.column)
            for n in r.columns:
                if table.column(n) is None:
                    raise EngineError("Semantic", f"unknown column {n}", *here)
            rule = Rule(r.kind, r.name or f"{node.name}_{r.kind.lower()}_{k}", [table.column(n).name for n in r.columns])
            if any(x.name.lower() == rule.name.lower() for x in table.rules):
                raise EngineError("Semantic", f"constraint {rule.name} is named twice", *here)
            if r.kind == "PRIMARY":
                if any(x.kind == "PRIMARY" for x in table.rules):
                    raise EngineError("Semantic", "a table has one primary key", *here)
                for n in r.columns:
                    table.column(n).nullable = False
            if r.kind == "CHECK":
                if ast.has_query(r.check):
                    raise EngineError("Semantic", "a check holds no subquery", *here)
                typed = lower.Lowering(Names(self)).expr(scope, r.check, aggregates=False)
                lower.Lowering.boolean(typed, here)
                rule.check = typed.sql
            if r.kind == "FOREIGN":
                parent = table if r.parent.lower() == node.name.lower() else work.table(r.parent)
                if parent is None:
                    raise EngineError("Semantic", f"unknown table {r.parent}", *here)
                columns = [parent.column(n) for n in r.parent_columns]
                if None in columns or len(columns) != len(r.columns):
                    raise EngineError("Semantic", f"{r.parent} lacks these columns", *here)
                names = [c.name for c in columns]
                keys = [sorted(x.lower() for x in k) for _, k in parent.unique_keys()]
                keys += [sorted(n.lower() for n in c.columns) for c in node.constraints if parent is table and c.kind in ("PRIMARY", "UNIQUE")]
                if sorted(n.lower() for n in names) not in keys:
                    raise EngineError("Semantic", f"these columns are no key of {r.parent}", *here)
                for n, p in zip(r.columns, columns):
                    if table.column(n).kind.name != p.kind.name:
                        raise EngineError("Semantic", f"{n} and {p.name} are of different types", *here)
                rule.parent, rule.parent_columns = parent.name, names
            table.rules.append(rule)
        work.tables[node.name.lower()] = table
        return "CREATE TABLE", 0

    def create_index(self, node: ast.CreateIndex, work: State) -> tuple[str, int]:
        table = self.need_table(node.table, node)
        self.allow("CREATE", {table.name})
        if any(i.name.lower() == node.name.lower() for x in work.tables.values() for i in x.indexes):
            raise EngineError("Semantic", f"index {node.name} exists already", node.line, node.column)
        columns = [table.column(n) for n in node.columns]
        if None in columns or len({c.name for c in columns}) < len(columns):
            raise EngineError("Semantic", "an index takes different columns of its table", node.line, node.column)
        target = work.table(node.table)
        target.indexes.append(Index(node.name, [c.name for c in columns], node.unique))
        if node.unique:
            self.tables.unique(target, node.name, [c.name for c in columns], target.files)
        return "CREATE INDEX", 0

    def drop_index(self, node: ast.DropIndex, work: State) -> tuple[str, int]:
        for table in work.tables.values():
            for i in table.indexes:
                if i.name.lower() == node.name.lower() and (node.table is None or node.table.lower() == table.name.lower()):
                    self.allow("CREATE", {table.name})
                    table.indexes.remove(i)
                    return "DROP INDEX", 0
        raise EngineError("Semantic", f"unknown index {node.name}", node.line, node.column)

    def index_verify(self, name: str) -> bool:
        """Whether the keys of a unique index are unique; other indexes are layout only."""
        for table in self.state.tables.values():
            for i in table.indexes:
                if i.name.lower() == name.lower():
                    self.allow("SELECT", {table.name})
                    if i.unique:
                        self.tables.unique(table, i.name, i.columns, table.files)
                    return True
        raise EngineError("Semantic", f"unknown index {name}")

    def index_rebuild(self, name: str) -> None:
        """Rewrite a table in ranges of an index's columns, so that scans skip row groups and files."""
        work = self.state.copy()
        for table in work.tables.values():
            for i in table.indexes:
                if i.name.lower() == name.lower() and table.files:
                    self.allow("CREATE", {table.name})
                    data = self.tables.read(table).repartitionByRange(*i.columns)
                    table.files = self.tables.write(TableDef(table.name, table.columns, indexes=[i]), data)
                    self.publish(work)
                    return

    # --- statistics, advice, access, backup ---

    def analyze(self, node: ast.Analyze) -> StatementResult:
        table = self.need_table(node.table, node)
        self.allow("SELECT", {table.name})
        self.allow("CREATE", {table.name})
        work = self.state.copy()
        found = statistics.collect(self.tables.read(table), [(c.name, c.kind) for c in table.columns], scratch(self.spark, "statistics"))
        work.table(table.name).statistics = found
        return StatementResult("ANALYZE", affected_rows=found["rows"], commit_state=self.publish(work))

    def statistics(self, name: str) -> dict | None:
        self.allow("SELECT", {name})
        table = self.state.table(name)
        return table.statistics if table else None

    def describe(self) -> list[dict]:
        """The catalog: tables with their columns, constraints and indexes, as far as this session's user may read them."""
        return [x for x in json.loads(self.state.text())["tables"] if self.may("SELECT", x["name"])]

    def index_advice(self) -> list[dict]:
        """Columns that queries compared and no index begins with, most frequent first."""
        out = []
        for (view, column), n in self.workload.most_common():
            name = view.removeprefix(f"{self.id}_t_")
            table = self.state.table(name)
            if table and not any(i.columns[0].lower() == column.lower() for i in table.indexes):
                out.append({"table": table.name, "column": column, "queries": n, "statement": f"CREATE INDEX idx_{table.name}_{column} ON {table.name}({column});"})
        return out

    # Access: grants are [action, table] of a user or a role, and members [user, role]; "*" is every table.  Without a user, the session
    # is its owner's and all is allowed; with one, only what was granted to the user or to a role.

    def grant(self, user: str, action: str, table: str = "*") -> None:
        self.administer("grant", user, action, table)

    def revoke(self, user: str, action: str, table: str = "*") -> None:
        self.administer("revoke", user, action, table)

    def join_role(self, user: str, role: str) -> None:
        self.administer("join", user, "ROLE", role)

    def leave_role(self, user: str, role: str) -> None:
        self.administer("leave", user, "ROLE", role)

    def administer(self, what: str, user: str, action: str, on: str) -> None:
        """Change grants, if this session's user may, and note who did so."""
        self.allow("ADMIN", set())
        if action not in (*ACTIONS, "ROLE"):
            raise EngineError("InvalidArgument", f"{action} is no action")
        if self.catalog is None:
            raise EngineError("Storage", "this session has no place for grants")
        work = self.state.copy()
        grants, entry = work.access.setdefault(user, []), [action, on.lower()]
        if what in ("grant", "join") and entry not in grants:
            grants.append(entry)
        if what in ("revoke", "leave"):
            work.access[user] = [g for g in grants if g != entry]
        work.audit.append({"at": round(time.time()), "by": self.user, "what": what, "user": user, "action": action, "on": on.lower()})
        self.publish(work)

    def audit(self) -> list[dict]:
        """Changes of grants, oldest first."""
        self.allow("ADMIN", set())
        return list(self.state.audit)

    def granted(self) -> set[tuple[str, str]]:
        """All grants of this session's user: own ones, and those of roles, which may be in roles themselves."""
        # grants are read from the committed state, so that no transaction of the user's can widen them
        access = self.catalog.state.access if self.catalog else {}
        out: set[tuple[str, str]] = set()
        todo, seen = [self.user], set()
        while todo:
            who = todo.pop()
            if who in seen:
                continue
            seen.add(who)
            for action, on in access.get(who, []):
                if action == "ROLE":
                    todo.append(on)
                else:
                    out.add((action, on))
        return out

    def may(self, action: str, table: str = "*") -> bool:
        return self.user is None or bool({(action, table.lower()), (action, "*"), ("ALL", table.lower()), ("ALL", "*")} & self.granted())

    def allow(self, action: str, tables: Collection[str]) -> None:
        """Raise unless this session's user may do something with all of the tables; with the store as such if there are none."""
        for name in tables or ({"*"} if action in ("CREATE", "ADMIN") else ()):
            if not self.may(action, name):
                raise EngineError("Permission", f"{self.user} may not {action} {name}")

    def backup(self, root: str) -> int:
        """Copy the committed state to another root; files already there are not copied again."""
        self.allow("ADMIN", set())
        return self.catalog.backup(Files(self.spark, root))

    def restore(self, root: str, version: int | None = None) -> int:
        """Make a backup the current state, as a new version that others see; returns the number of files copied."""
        self.allow("ADMIN", set())
        if self.staged is not None:
            raise EngineError("Transaction", "restore cannot stand in a transaction")
        self.cache.clear()
        self.catalog.refresh()
        self.catalog.hold(writing=True)
        try:
            return self.catalog.restore(Files(self.spark, root), version)
        finally:
            self.catalog.hold(writing=False)
