"""Row filters and result ordering.

A filter is ``{"field", "operator", "value"}``; several are combined by AND.
Equality compares the key text of a cell, so a missing cell equals ``""`` and
``neq`` / ``not_in`` keep missing rows. Wherever the column's type allows, the
predicate is written on the bare column, so that it reaches the parquet scan.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Mapping, Sequence
from decimal import ROUND_FLOOR, Decimal, localcontext
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.columns import (
    FRACTIONAL, INFINITY, INTEGRAL, NUMERIC_TEXT, TIMESTAMPS, col, dtype, key_sql, list_sql,
    number_sql, quoted, text_sql,
)

OPERATORS = (
    "eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte", "between", "contains",
)
SIGNS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
DATES = (T.DateType,) + TIMESTAMPS
DOUBLES = (T.FloatType, T.DoubleType)
# Types that have a literal for every key text.
LITERAL = INTEGRAL + DOUBLES + (T.DecimalType, T.DateType)


def plain_text(d: Decimal) -> str:
    """All digits of a decimal, without filling zeros."""
    text = f"{d:f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text


def number_text(x: float) -> str:
    """Text of a number as a cell with it is keyed: plain digits, exponents only beyond."""
    if not math.isfinite(x) or x == 0:
        return "0" if x == 0 else str(x)
    if 1e-6 <= abs(x) < 1e21:
        return plain_text(Decimal(repr(x)))
    mantissa, exponent = repr(x).split("e")
    return f"{mantissa}e{int(exponent):+d}"


def value_text(v: Any) -> str:
    """Text of a filter value, as a cell with that value would be keyed."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return number_text(v)
    if isinstance(v, Decimal):
        return plain_text(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.strftime("%Y-%m-%d")
    return str(v)


def value_number(v: Any) -> float | None:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float, Decimal)):
        return float(v) if math.isfinite(v) else None
    if isinstance(v, str) and re.match(NUMERIC_TEXT, v.strip()):
        n = float(v)
        return n if math.isfinite(n) else None
    return None


def _value_date(v: Any) -> dt.date | None:
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    try:
        return dt.date.fromisoformat(v) if isinstance(v, str) else None
    except ValueError:
        return None


def _number_literal(df: DataFrame, field: str, n: float) -> str:
    """A literal in the column's own type where it fits, so no cast is added."""
    if isinstance(dtype(df, field), INTEGRAL) and n.is_integer() and abs(n) < 2**53:
        return str(int(n))
    return f"{n!r}D"


def _decimal(v: Any) -> Decimal | None:
    """The exact value of a filter value, in all its digits."""
    text = value_text(v).strip() if isinstance(v, (int, float, Decimal, str)) and not isinstance(v, bool) else ""
    if not re.match(NUMERIC_TEXT, text):
        return None
    d = Decimal(text)
    return d if abs(d.adjusted()) < 1000 else None


def _decimal_literal(t: T.DecimalType, d: Decimal) -> str:
    return f"CAST('{plain_text(d)}' AS DECIMAL({t.precision}, {t.scale}))"


def _after_sql(day: dt.date) -> str | None:
    """The first instant after a day; none for the last day that there is."""
    return f"DATE'{day + dt.timedelta(days=1)}'" if day < dt.date.max else None


def _literal(t: T.DataType, text: str) -> str | None:
    """A literal of the column's own type whose key text is ``text``; none if no cell has that text."""
    if isinstance(t, T.DateType):
        day = _value_date(text)
        return f"DATE'{day}'" if day is not None and value_text(day) == text else None
    if isinstance(t, DOUBLES):
        n = value_number(text)
        # "05" is not how any number is written, so no cell can equal it.
        return f"{n!r}D" if n is not None and value_text(n) == text else None
    d = _decimal(text)
    if d is None or plain_text(d) != text:
        return None
    if isinstance(t, T.DecimalType):
        digits = len(text.lstrip("-").partition(".")[0].lstrip("0"))
        fits = digits <= t.precision - t.scale and len(text.partition(".")[2]) <= t.scale
        return _decimal_literal(t, d) if fits else None
    return text if d == int(d) and abs(d) < 2**63 else None


def _equals_sql(df: DataFrame, field: str, text: str) -> str:
    """Never NULL: the key text of the cell is ``text``."""
    t, c = dtype(df, field), quoted(field)
    if text == "":
        return f"({c} IS NULL OR {c} = '')" if isinstance(t, T.StringType) else f"({c} IS NULL)"
    if isinstance(t, T.StringType):
        return f"({c} IS NOT NULL AND {c} = {text_sql(text)})"
    if isinstance(t, LITERAL):
        literal = _literal(t, text)
        return "false" if literal is None else f"({c} IS NOT NULL AND {c} = {literal})"
    if isinstance(t, TIMESTAMPS):
        day = _value_date(text)
        if day is None or value_text(day) != text:
            return "false"
        end = _after_sql(day)
        return f"({c} IS NOT NULL AND {c} >= DATE'{day}'" + (f" AND {c} < {end})" if end else ")")
    return f"({key_sql(df, field)} = {text_sql(text)})"


def _in_sql(df: DataFrame, field: str, texts: list[str]) -> str:
    t, c = dtype(df, field), quoted(field)
    present = [x for x in texts if x]
    if isinstance(t, (T.StringType, *LITERAL)):
        known = [text_sql(x) if isinstance(t, T.StringType) else _literal(t, x) for x in present]
        listed = ", ".join(dict.fromkeys(x for x in known if x is not None))
        hits = [f"({c} IS NOT NULL AND {c} IN ({listed}))"] if listed else []
    else:
        hits = [_equals_sql(df, field, x) for x in present]
    hits += [_equals_sql(df, field, "")] if "" in texts else []
    return "(" + " OR ".join(hits or ["false"]) + ")"


def _ordered_decimal_sql(t: T.DecimalType, c: str, op: str, v: Decimal) -> str:
    """Compare in the column's own type; a value between two of its steps goes to the lower one."""
    limit = Decimal(10) ** (t.precision - t.scale)
    if abs(v) >= limit:
        return f"({c} IS NOT NULL)" if (v > 0) == (op in ("lt", "lte")) else "false"
    with localcontext(prec=1100):
        low = v.quantize(Decimal(1).scaleb(-t.scale), ROUND_FLOOR)
    if low != v:
        op = "gt" if op in ("gt", "gte") else "lte"
    if low <= -limit:
        return f"({c} IS NOT NULL)" if op == "gt" else "false"
    return f"({c} {SIGNS[op]} {_decimal_literal(t, low)})"


def _ordered_sql(df: DataFrame, field: str, op: str, value: Any) -> str:
    t, c = dtype(df, field), quoted(field)
    if isinstance(t, DATES):
        day = _value_date(value)
        if day is None:
            return "false"
        if isinstance(t, T.DateType):
            return f"({c} {SIGNS[op]} DATE'{day}')"
        end = _after_sql(day)
        if end is None and op in ("gt", "lte"):
            return "false" if op == "gt" else f"({c} IS NOT NULL)"
        return {"gt": f"{c} >= {end}", "gte": f"{c} >= DATE'{day}'", "lt": f"{c} < DATE'{day}'", "lte": f"{c} < {end}"}[op]
    if isinstance(t, T.DecimalType):
        exact = _decimal(value)
        return "false" if exact is None else _ordered_decimal_sql(t, c, op, exact)
    n = value_number(value)
    if n is None:
        return "false"
    bare = isinstance(t, INTEGRAL + FRACTIONAL)
    x, v = (c, _number_literal(df, field, n)) if bare else (number_sql(df, field), f"{n!r}D")
    test = f"{x} {SIGNS[op]} {v}"
    if isinstance(t, DOUBLES):
        # NaN sorts above every number; infinities are not values either.
        edge = f"{c} < {INFINITY}" if op in ("gt", "gte") else f"{c} > -{INFINITY}"
        return f"({test} AND {edge})"
    return f"({test})"


def predicate_sql(df: DataFrame, flt: Mapping[str, Any]) -> str:
    """One filter as a condition."""
    field, op, value = flt["field"], flt["operator"], flt.get("value")
    if op not in OPERATORS:
        raise ValueError(f"unknown filter operator {op!r}")
    t = dtype(df, field)
    if op in ("eq", "neq"):
        hit = _equals_sql(df, field, value_text(value))
        return hit if op == "eq" else f"(NOT {hit})"
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple)):
            return "false"
        hit = _in_sql(df, field, [value_text(v) for v in value])
        return hit if op == "in" else f"(NOT {hit})"
    if op == "contains":
        text = value_text(value)
        whole = quoted(field) if isinstance(t, T.StringType) and text else key_sql(df, field)
        return f"contains({whole}, {text_sql(text)})"
    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) < 2:
            return "false"
        low, high = (_ordered_sql(df, field, o, v) for o, v in (("gte", value[0]), ("lte", value[1])))
        return f"({low} AND {high})"
    return _ordered_sql(df, field, op, value)


def filters_sql(df: DataFrame, filters: Sequence[Mapping[str, Any]] | None) -> str:
    """All filters as one condition, empty where there are none."""
    return " AND ".join(predicate_sql(df, f) for f in filters or ())


def apply_filters(df: DataFrame, filters: Sequence[Mapping[str, Any]] | None) -> DataFrame:
    """Keep the rows that pass every filter."""
    return df.filter(filters_sql(df, filters)) if filters else df


def sort_columns(
    df: DataFrame, sort: Mapping[str, str] | None, ties: Sequence[str]
) -> list[Column]:
    """Order for a result: the sort field with missing last, then the tie-breakers."""
    order = []
    if sort:
        field, direction = sort["field"], sort.get("direction", "asc")
        if direction not in ("asc", "desc"):
            raise ValueError(f"sort direction must be asc or desc, not {direction!r}")
        c = col(field)
        if isinstance(dtype(df, field), T.StringType):
            c = F.expr(f"nullif({quoted(field)}, '')")
        order.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last())
    return order + [col(t).asc() for t in ties if not sort or t != sort["field"]]

