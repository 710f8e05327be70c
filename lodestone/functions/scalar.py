"""Spark SQL text for the dialect's scalar rules where they differ from Spark's own.

All functions take and give SQL text, so the result stays one expression that Catalyst can fold,
push down and compile.
"""

from __future__ import annotations

from ..errors import EngineError
from ..plans import types as t
from ..plans.types import Type


def quoted(text: str) -> str:
    """A Spark string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(text: str) -> str:
    return "`" + text.replace("`", "``") + "`"


def fail_unless(test: str, value: str, message: str, kind: str) -> str:
    """value if the test holds or is null; else a run-time error."""
    return f"CASE WHEN coalesce({test}, true) THEN {value} ELSE CAST(raise_error({quoted(message)}) AS {kind}) END"


def finite(value: str) -> str:
    return fail_unless(f"abs({value}) < double('Infinity')", value, "FLOAT result is not finite", "DOUBLE")


def decimal_division(a: str, b: str, scale: int) -> str:
    """a / b, rounded once, half away from zero.

    Spark rounds to its own scale and the cast rounds again; if that carried the magnitude above
    the exact quotient by more than half a unit, the last digit steps back.
    """
    kind = f"DECIMAL(38,{scale})"
    r, unit = f"CAST(({a}) / ({b}) AS {kind})", f"CAST(1e-{scale} AS DECIMAL({scale + 1},{scale}))"
    if scale == 0:
        unit = "CAST(1 AS DECIMAL(1,0))"
    off = f"2 * abs(({a}) - {r} * ({b})) > abs({b}) * {unit}"
    return f"CASE WHEN {off} THEN CAST({r} - CASE WHEN ({a} < 0) <> ({b} < 0) THEN -{unit} ELSE {unit} END AS {kind}) ELSE {r} END"


def arithmetic(op: str, a: str, x: Type, b: str, y: Type, out: Type) -> str:
    if x.name == "NULL" or y.name == "NULL":
        return f"CAST(NULL AS {out.spark})"
    if out.integral:
        if op == "/":
            return f"CAST(({a} div {b}) AS {out.spark})" if out == t.INT else f"({a} div {b})"
        return f"({a} {op} {b})"
    if out == t.FLOAT:
        return f"({a} {op} {b})"
    wide = [c if k.name == "DECIMAL" else f"CAST({c} AS DECIMAL({10 if k == t.INT else 19},0))" for c, k in ((a, x), (b, y))]
    if op == "/":
        return decimal_division(*wide, out.scale)
    return f"CAST(({wide[0]} {op} {wide[1]}) AS {out.spark})"


def like(value: str, pattern: str, literal: str | None) -> str:
    """No character escapes in the dialect, so backslashes are doubled for Spark."""
    if literal is not None:
        return f"({value} LIKE {quoted(literal.replace(chr(92), chr(92) * 2))})"
    return f"({value} LIKE replace({pattern}, '\\\\', '\\\\\\\\'))"


def cast(value: str, source: Type, target: Type, at: tuple[int, int] = (0, 0)) -> str:
    """The dialect's CAST: exact texts only, half away from zero, no silent loss."""
    kind = target.spark
    if source.name == "NULL":
        return f"CAST(NULL AS {kind})"
    if source == target or (source.name == target.name == "VARCHAR" and target.a is None):
        return value
    allowed = {
        "DATE": ("VARCHAR", "DATE"),
        "BOOL": ("VARCHAR", "BOOL"),
        "FLOAT": ("INT", "BIGINT", "DECIMAL", "FLOAT", "VARCHAR"),
        "DECIMAL": ("INT", "BIGINT", "DECIMAL", "FLOAT", "VARCHAR"),
        "INT": ("INT", "BIGINT", "DECIMAL", "FLOAT", "VARCHAR"),
        "BIGINT": ("INT", "BIGINT", "DECIMAL", "FLOAT", "VARCHAR"),
        "VARCHAR": ("INT", "BIGINT", "DECIMAL", "FLOAT", "VARCHAR", "BOOL", "DATE"),
    }
    if source.name not in allowed[target.name]:
        raise EngineError("Semantic", f"cannot CAST {source} AS {target}", *at)

    def exact(pattern: str) -> str:
        return fail_unless(f"{value} RLIKE {quoted(pattern)}", f"CAST({value} AS {kind})", f"text is not a {target.name}", kind)

    if target.name == "DATE":
        return exact(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    if target.name == "BOOL":
        return exact(r"\A(?i:true|false)\z")
    if target.name == "FLOAT":
        if source.name == "VARCHAR":
            return finite(exact(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"))
        return f"CAST({value} AS DOUBLE)"
    if target.name == "DECIMAL":
        return exact(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z") if source.name == "VARCHAR" else f"CAST({value} AS {kind})"
    if target.integral:
        if source.name == "VARCHAR":
            return exact(r"\A[+-]?[0-9]+\z")
        if source.name == "FLOAT":
            return fail_unless(f"{value} = floor({value})", f"CAST({value} AS {kind})", "FLOAT is not integral", kind)
        return f"CAST(round({value}, 0) AS {kind})" if source.name == "DECIMAL" else f"CAST({value} AS {kind})"
    text = f"upper(CAST({value} AS STRING))" if source.name == "BOOL" else f"CAST({value} AS STRING)"
    if target.a is None:
        return text
    return fail_unless(f"length({text}) <= {target.a}", text, f"text is longer than {target.a}", "STRING")


def aggregate(function: str, value: str | None, kind: Type, at: tuple[int, int]) -> tuple[str, Type]:
    """SQL and type of an aggregate over a value of a type."""
    if function == "COUNT":
        return (f"count({value})" if value is not None else "count(1)"), t.BIGINT
    if function in ("MIN", "MAX"):
        return f"{function.lower()}({value})", kind
    if kind.name == "NULL":
        return f"sum(CAST({value} AS BIGINT))", t.BIGINT
    if not kind.numeric:
        raise EngineError("Semantic", f"{function} needs numbers, not {kind}", *at)
    if function == "SUM":
        if kind == t.FLOAT:
            return finite(f"sum({value})"), kind
        if kind.integral:
            return f"sum({value})", t.BIGINT  # Spark sums either as checked 64-bit integers
        out = t.decimal(38, kind.scale)
        return f"CAST(sum({value}) AS {out.spark})", out
    if kind == t.FLOAT:
        return finite(f"avg({value})"), kind
    out = t.decimal(38, max(6, kind.scale))
    total = f"CAST(sum({value}) AS DECIMAL(19,0))" if kind == t.INT else f"sum(CAST({value} AS DECIMAL(19,0)))" if kind == t.BIGINT else f"sum({value})"
    return decimal_division(total, f"CAST(nullif(count({value}), 0) AS DECIMAL(19,0))", out.scale), out
