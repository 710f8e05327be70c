"""Stored tables as DataFrames, copy-on-write changes, and constraints as DataFrame assertions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from ..errors import EngineError
from .catalog import Rule, State, TableDef
from .files import Files


def schema(table: TableDef) -> st.StructType:
    return st._parse_datatype_string(", ".join(f"`{c.name}` {c.kind.spark}" for c in table.columns))


class Tables:
    def __init__(self, spark: SparkSession, files: Files):
        self.spark, self.files = spark, files

    def read(self, table: TableDef) -> DataFrame:
        if not table.files:
            return self.spark.createDataFrame([], schema(table))
        return self.spark.read.schema(schema(table)).parquet(*[self.files.path(f) for f in table.files])

    def write(self, table: TableDef, rows: DataFrame) -> list[str]:
        """Write rows as new files, in the order of the table's first index for tight row-group
        statistics, and return their names."""
        folder = f"tables/{table.name.lower()}/{uuid.uuid4().hex}"
        rows = rows.select(*[F.col(c.name).cast(c.kind.spark).alias(c.name) for c in table.columns])
        if table.indexes:
            rows = rows.sortWithinPartitions(*table.indexes[0].columns)
        rows.write.parquet(self.files.path(folder))
        return [f"{folder}/{n}" for n in self.files.names(folder, ".parquet")]

    def append(self, table: TableDef, rows: DataFrame) -> list[str]:
        return table.files + self.write(table, rows)

    # --- constraints ---

    def subset(self, table: TableDef, files: list[str]) -> DataFrame:
        one = TableDef(table.name, table.columns, files=files)
        return self.read(one)

    def verify(self, state: State, table: TableDef, new: list[str]) -> None:
        """Check the rows of the new files, and the table as a whole where rows meet others."""
        rows = self.subset(table, new)
        for c in table.columns:
            if not c.nullable and not rows.where(F.col(c.name).isNull()).isEmpty():
                raise EngineError("Execution", f"{table.name}.{c.name} must not be NULL")
            if c.kind.name == "VARCHAR" and c.kind.a and not rows.where(F.length(c.name) > c.kind.a).isEmpty():
                raise EngineError("Execution", f"{table.name}.{c.name} holds {c.kind.a} characters at most")
        for r in table.rules:
            # names in a check are qualified by the table's
            if r.kind == "CHECK" and not rows.alias(table.name).where(f"NOT coalesce({r.check}, true)").isEmpty():
                raise EngineError("Execution", f"check {r.name} of {table.name} fails")
        for name, columns in table.unique_keys():
            self.unique(table, name, columns, new)
        for r in table.rules:
            if r.kind == "FOREIGN":
                self.foreign(state, table, r, rows)

    def unique(self, table: TableDef, name: str, columns: list[str], new: list[str]) -> None:
        """No key of a new row occurs twice in the table; keys with a null are exempt."""
        keyed = lambda df: df.select(*columns).where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
        fresh = keyed(self.subset(table, new))
        # two counts, each aggregated before its shuffle; old rows matter only where keys meet
        old = [f for f in table.files if f not in new]
        twice = fresh.groupBy(*columns).count().where("count > 1")
        if old:
            twice = twice.select(*columns).unionByName(keyed(self.subset(table, old)).join(fresh.distinct(), columns, "left_semi"))
        if not twice.isEmpty():
            raise EngineError("Execution", f"{name} of {table.name}: the key ({', '.join(columns)}) is not unique")

    def foreign(self, state: State, table: TableDef, rule: Rule, rows: DataFrame) -> None:
        """Every complete key of the rows has its parent."""
        parent = self.read(state.table(rule.parent)).select(*[F.col(p).alias(c) for c, p in zip(rule.columns, rule.parent_columns)])
        complete = rows.select(*rule.columns).where(" AND ".join(f"`{c}` IS NOT NULL" for c in rule.columns))
        if not complete.join(parent, list(rule.columns), "left_anti").isEmpty():
            raise EngineError("Execution", f"{rule.name} of {table.name}: no such row in {rule.parent}")

    def referenced(self, state: State, table: TableDef) -> None:
        """RESTRICT: every row that refers to the table still finds its parent."""
        for child in state.tables.values():
            for r in child.rules:
                if r.kind == "FOREIGN" and r.parent.lower() == table.name.lower():
                    self.foreign(state, child, r, self.read(child))
