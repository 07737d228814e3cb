"""Arithmetic formulas given as nested dictionaries, turned into one column.

``{"op": "divide", "left": {"op": "field", "field": "a"}, "right": ...}`` becomes
an ordinary expression, so Catalyst folds constants and compiles it. A missing
operand or a zero divisor gives NULL, never an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.columns import number_sql

MAX_DEPTH = 8
MAX_NODES = 40

# Which keys of a node hold its operands.
OPERANDS = {
    "field": (),
    "const": (),
    "add": ("left", "right"),
    "subtract": ("left", "right"),
    "multiply": ("left", "right"),
    "divide": ("left", "right"),
    "safe_divide": ("numerator", "denominator"),
    "abs": ("value",),
    "round": ("value",),
}
TEMPLATES = {
    "add": "({0} + {1})",
    "subtract": "({0} - {1})",
    "multiply": "({0} * {1})",
    "divide": "try_divide({0}, {1})",
    "safe_divide": "try_divide({0}, {1})",
    "abs": "abs({0})",
}


def walk(node: Mapping[str, Any], depth: int = 1) -> Iterator[tuple[Mapping[str, Any], int]]:
    """Every node with its depth."""
    op = node.get("op")
    if op not in OPERANDS:
        raise ValueError(f"unknown formula op {op!r}")
    yield node, depth
    for operand in OPERANDS[op]:
        if not isinstance(node.get(operand), Mapping):
            raise ValueError(f"formula op {op!r} needs {operand!r}")
        yield from walk(node[operand], depth + 1)


def fields_of(node: Mapping[str, Any]) -> list[str]:
    return sorted({n["field"] for n, _ in walk(node) if n["op"] == "field"})


def check(node: Mapping[str, Any], available: list[str]) -> None:
    """Raise ``ValueError`` for a formula too deep, too big or on unknown fields."""
    nodes = list(walk(node))
    depth = max(d for _, d in nodes)
    if depth > MAX_DEPTH:
        raise ValueError(f"formula depth {depth} is over {MAX_DEPTH}")
    if len(nodes) > MAX_NODES:
        raise ValueError(f"formula has {len(nodes)} nodes, over {MAX_NODES}")
    unknown = [f for f in fields_of(node) if f not in available]
    if unknown:
        raise ValueError(f"formula uses unknown field(s): {', '.join(unknown)}")


def _sql(df: DataFrame, node: Mapping[str, Any]) -> str:
    op = node["op"]
    if op == "field":
        return f"({number_sql(df, node['field'])})"
    if op == "const":
        return f"({float(node['value'])!r}D)"
    args = [_sql(df, node[k]) for k in OPERANDS[op]]
    if op == "round":
        scale = f"{float(10 ** int(node.get('digits') or 0))!r}D"
        # Halves go up, also for negative numbers.
        return f"(double(floor({args[0]} * {scale} + 0.5D)) / {scale})"
    quotient = TEMPLATES[op].format(*args)
    if op == "safe_divide" and node.get("whenZero", "null") == "zero":
        a, b = args
        return f"CASE WHEN {a} IS NOT NULL AND {b} = 0 THEN 0D ELSE {quotient} END"
    return quotient


def formula_sql(df: DataFrame, node: Mapping[str, Any]) -> str:
    check(node, df.columns)
    return _sql(df, node)


def compile_formula(df: DataFrame, node: Mapping[str, Any]) -> Column:
    """The checked formula as a double column over ``df``."""
    return F.expr(formula_sql(df, node))


def with_derived(df: DataFrame, name: str, node: Mapping[str, Any]) -> DataFrame:
    """Add a derived metric, usable like any other column."""
    return df.withColumn(name, compile_formula(df, node))
