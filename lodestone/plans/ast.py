"""Statements and expressions as the parser gives them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Node:
    line: int
    column: int


@dataclass(frozen=True)
class Literal(Node):
    kind: str  # integer decimal float string bool date null
    value: object


@dataclass(frozen=True)
class Name(Node):
    qualifier: str | None
    name: str


@dataclass(frozen=True)
class Star(Node):
    qualifier: str | None


@dataclass(frozen=True)
class Unary(Node):
    op: str  # + - NOT
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str  # + - * / = != < <= > >= AND OR LIKE
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNull(Node):
    operand: Node
    negated: bool


@dataclass(frozen=True)
class InList(Node):
    operand: Node
    items: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Node):
    operand: Node
    query: Select
    negated: bool


@dataclass(frozen=True)
class Exists(Node):
    query: Select


@dataclass(frozen=True)
class Scalar(Node):
    query: Select


@dataclass(frozen=True)
class Cast(Node):
    operand: Node
    type: tuple  # name, *parameters


@dataclass(frozen=True)
class Aggregate(Node):
    function: str
    operand: Node | None  # none for COUNT(*)


@dataclass(frozen=True)
class Default(Node):
    pass


@dataclass(frozen=True)
class Item(Node):
    value: Node
    alias: str | None


@dataclass(frozen=True)
class Source(Node):
    table: str | None
    query: Select | None
    alias: str | None


@dataclass(frozen=True)
class Join(Node):
    kind: str  # INNER LEFT RIGHT FULL CROSS
    source: Source
    on: Node | None


@dataclass(frozen=True)
class Order(Node):
    value: Node
    descending: bool
    nulls: str | None  # FIRST LAST


@dataclass(frozen=True)
class Cte(Node):
    name: str
    columns: tuple[str, ...]
    query: Select


@dataclass(frozen=True)
class Select(Node):
    ctes: tuple[Cte, ...]
    distinct: bool
    items: tuple[Item, ...]
    source: Source
    joins: tuple[Join, ...]
    where: Node | None
    group: tuple[Node, ...]
    having: Node | None
    order: tuple[Order, ...]
    limit: int | None
    offset: int | None


@dataclass(frozen=True)
class Insert(Node):
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Node, ...], ...] | None  # none for DEFAULT VALUES


@dataclass(frozen=True)
class Update(Node):
    target: Source
    assignments: tuple[tuple[str, Node], ...]
    where: Node | None


@dataclass(frozen=True)
class Delete(Node):
    target: Source
    where: Node | None


@dataclass(frozen=True)
class Constraint(Node):
    kind: str  # PRIMARY UNIQUE FOREIGN CHECK
    name: str | None
    columns: tuple[str, ...] = ()
    parent: str | None = None
    parent_columns: tuple[str, ...] = ()
    check: Node | None = None
    text: str = ""


@dataclass(frozen=True)
class ColumnDef(Node):
    name: str
    type: tuple
    nullable: bool | None
    default: Literal | None


@dataclass(frozen=True)
class CreateTable(Node):
    name: str
    columns: tuple[ColumnDef, ...]
    constraints: tuple[Constraint, ...]


@dataclass(frozen=True)
class CreateIndex(Node):
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool


@dataclass(frozen=True)
class DropIndex(Node):
    name: str
    table: str | None


@dataclass(frozen=True)
class Transaction(Node):
    action: str  # BEGIN COMMIT ROLLBACK SAVEPOINT RELEASE ROLLBACK_TO CHECKPOINT
    name: str | None = None


@dataclass(frozen=True)
class Explain(Node):
    statement: Node
    analyze: bool


@dataclass(frozen=True)
class Analyze(Node):
    table: str


@dataclass
class Script:
    statements: list[Node] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)


def walk(node) -> Iterator[Node]:
    """A node and all nodes inside it."""
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node):
        yield node
        for f in fields(node):
            yield from walk(getattr(node, f.name))


def has_query(node) -> bool:
    return any(isinstance(n, Select) for n in walk(node))


def dump(node):
    """A node as JSON has it: its class and its fields by name; tuples are lists."""
    if isinstance(node, (tuple, list)):
        return [dump(x) for x in node]
    if is_dataclass(node):
        return {"node": type(node).__name__, **{f.name: dump(getattr(node, f.name)) for f in fields(node)}}
    return node


def load(document):
    """The node that dump() gave."""
    if isinstance(document, list):
        return tuple(load(x) for x in document)
    if not isinstance(document, dict):
        return document
    kind = globals().get(document.get("node", ""))
    if not (isinstance(kind, type) and issubclass(kind, Node)):
        raise ValueError(f"{document.get('node')} is no kind of node")
    return kind(**{k: load(v) for k, v in document.items() if k != "node"})
