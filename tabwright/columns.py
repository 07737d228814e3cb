"""How a column of any Spark type is read: by name, as a number, as a key text.

A cell is *missing* when it is NULL or the empty string. Every operator reads
numbers through :func:`number_sql` and group keys through :func:`group_key`, so
the rules live here once.

Expressions are written as Spark SQL text (``*_sql`` functions give the text)
and handed over with ``expr``: one call for a whole expression keeps the
building of wide plans fast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)

# Decimal text with an optional exponent: what a numeric read accepts.
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Characters removed around a cell before it is read.
BLANKS = " \t\n\r\f\u000b 　﻿"
INFINITY = "double('Infinity')"
PADDING = r"\.?0+$"


def quoted(name: str) -> str:
    """A column name in SQL text, safe for dots, brackets and backticks."""
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    """A text literal in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_sql(values: Sequence[str]) -> str:
    return ", ".join(text_sql(v) for v in values)


def struct_sql(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {c}" for n, c in fields.items()) + ")"


def inline_sql(structs: Sequence[str]) -> str:
    """One output row per struct, in the same task."""
    return "inline(array(" + ", ".join(structs) + "))"


def col(name: str) -> Column:
    """Column by exact name."""
    return F.col(quoted(name))


def literal_rows(
    spark: SparkSession, rows: Sequence[tuple], schema: Mapping[str, str]
) -> DataFrame:
    """A few constant rows, built inside the JVM."""

    def cell(value, type_: str) -> str:
        literal = "NULL" if value is None else text_sql(str(value))
        return f"cast({literal} AS {type_})"

    if not rows:
        return spark.range(0).selectExpr(*[f"{cell(None, t)} AS {quoted(n)}" for n, t in schema.items()])
    structs = [
        struct_sql(**{n: cell(v, t) for v, (n, t) in zip(row, schema.items())}) for row in rows
    ]
    return spark.range(1).selectExpr(inline_sql(structs))


def require(df: DataFrame, names: Sequence[str]) -> None:
    """Raise ``ValueError`` when a name is not a column of ``df``."""
    have = set(df.columns)
    unknown = [n for n in names if n not in have]
    if unknown:
        raise ValueError(f"unknown field(s): {', '.join(unknown)}")


def dtype(df: DataFrame, name: str) -> T.DataType:
    require(df, [name])
    return df.schema[name].dataType


def kind(df: DataFrame, name: str) -> str:
    """One of ``number``, ``date``, ``boolean``, ``string``."""
    t = dtype(df, name)
    if isinstance(t, INTEGRAL + FRACTIONAL):
        return "number"
    if isinstance(t, TIMESTAMPS + (T.DateType,)):
        return "date"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "string"


def strip_sql(c: str) -> str:
    return f"btrim({c}, {text_sql(BLANKS)})"


def finite_sql(c: str) -> str:
    """A double, with NaN and the infinities turned into NULL."""
    return f"CASE WHEN abs({c}) < {INFINITY} THEN {c} END"


def number_sql(df: DataFrame, name: str) -> str:
    """The lenient numeric read: missing, unreadable and non-finite cells are NULL."""
    t, c = dtype(df, name), quoted(name)
    if isinstance(t, INTEGRAL + (T.DecimalType,)):
        return f"double({c})"
    if isinstance(t, T.BooleanType):
        return f"double(int({c}))"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return finite_sql(c if isinstance(t, T.DoubleType) else f"double({c})")
    if isinstance(t, T.StringType):
        s = strip_sql(c)
        cast = finite_sql(f"try_cast({s} AS DOUBLE)")
        return f"CASE WHEN {s} RLIKE {text_sql(NUMERIC_TEXT)} THEN {cast} END"
    return "cast(NULL AS DOUBLE)"


def number(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


def unpadded_sql(decimal: str) -> str:
    """Text of a decimal without the zeros that only fill its scale."""
    return f"regexp_replace(string({decimal}), {text_sql(PADDING)}, '')"


def double_text_sql(c: str) -> str:
    """Text of a double in plain digits from 1e-6 up to 1e21, with an exponent beyond."""
    digits = {scale: unpadded_sql(f"cast(string({c}) AS DECIMAL(38, {scale}))") for scale in (10, 25)}
    exponent = f"regexp_replace(regexp_replace(string({c}), '([.]0)?E', 'e'), 'e([0-9])', 'e+$1')"
    return (
        f"CASE WHEN abs({c}) < 1e15 AND double(floor({c})) = {c} THEN string(floor({c})) "
        f"WHEN abs({c}) >= 1e21 OR abs({c}) < 1e-6 THEN {exponent} "
        f"WHEN abs({c}) >= 1e7 THEN {digits[10]} WHEN abs({c}) < 1e-3 THEN {digits[25]} "
        f"ELSE string({c}) END"
    )


def missing_sql(df: DataFrame, name: str) -> str:
    """True where the cell is NULL or the empty string."""
    c = quoted(name)
    if isinstance(dtype(df, name), T.StringType):
        return f"({c} IS NULL OR {c} = '')"
    return f"({c} IS NULL)"


@dataclass(frozen=True)
class Key:
    """A grouping key: what to shuffle on, and its text once grouped.

    Numbers and dates are grouped in their own fixed-width type and become text
    only on the grouped rows, so the shuffle never carries formatted strings.
    """

    name: str
    group: str
    text: Callable[[str], str]


def _plain_text(grouped: str) -> str:
    return f"coalesce(string({grouped}), '')"


def group_key(df: DataFrame, name: str) -> Key:
    t, c = dtype(df, name), quoted(name)
    if isinstance(t, T.StringType):
        return Key(name, f"coalesce({c}, '')", lambda g: g)
    if isinstance(t, T.DecimalType):
        text = unpadded_sql if t.scale else "string({})".format
        return Key(name, c, lambda g: f"coalesce({text(g)}, '')")
    if isinstance(t, FRACTIONAL):
        return Key(name, f"double({c})", lambda g: f"coalesce({double_text_sql(g)}, '')")
    if isinstance(t, TIMESTAMPS):
        return Key(name, f"date({c})", _plain_text)
    if isinstance(t, NESTED):
        # Maps cannot be grouped on, so nested values are keyed by their JSON.
        return Key(name, f"coalesce(to_json({c}), '')", lambda g: g)
    return Key(name, c, _plain_text)


def key_sql(df: DataFrame, name: str) -> str:
    """The key text of a cell, ``""`` for a missing one; never NULL."""
    k = group_key(df, name)
    return k.text(k.group)
