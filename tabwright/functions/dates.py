"""Lenient date reads and calendar buckets, as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.columns import INTEGRAL, TIMESTAMPS, dtype, quoted, strip_sql
from tabwright.functions.cells import date_of_sql

GRAINS = ("day", "week", "month", "quarter", "year")


def check_grain(grain: str) -> None:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {', '.join(GRAINS)}, not {grain!r}")


def date_sql(df: DataFrame, name: str) -> str:
    """Date of a cell, whatever the column's type; unreadable cells are NULL.

    Text may be an ISO prefix, a year-month, a year or any form accepted at
    import; a bare year-month or year means its first day.
    """
    t, c = dtype(df, name), quoted(name)
    if isinstance(t, (T.DateType,) + TIMESTAMPS):
        return f"date({c})"
    if isinstance(t, INTEGRAL):
        c = f"string({c})"
    elif not isinstance(t, T.StringType):
        return "cast(NULL AS DATE)"
    return (
        f"CASE WHEN {c} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' THEN try_cast(left({c}, 10) AS DATE) "
        f"WHEN {c} RLIKE '^[0-9]{{4}}-[0-9]{{2}}$' THEN try_cast(concat({c}, '-01') AS DATE) "
        f"WHEN {c} RLIKE '^[0-9]{{4}}$' THEN try_cast(concat({c}, '-01-01') AS DATE) "
        f"ELSE {date_of_sql(strip_sql(c))} END"
    )


def read_date(df: DataFrame, name: str) -> Column:
    return F.expr(date_sql(df, name))


def bucket_sql(day: str, grain: str) -> str:
    """First day of the bucket. Grouping on a date is cheaper than on a label."""
    check_grain(grain)
    return day if grain == "day" else f"trunc({day}, '{grain}')"


def label_sql(start: str, grain: str) -> str:
    """Text of a bucket: 2026-07-01, 2026-W27, 2026-07, 2026-Q3 or 2026."""
    check_grain(grain)
    if grain == "week":
        # The Thursday of an ISO week decides the year the week belongs to.
        year = f"date_format(date_add({start}, 3), 'yyyy')"
        return f"concat({year}, '-W', lpad(string(weekofyear({start})), 2, '0'))"
    if grain == "quarter":
        return f"concat(date_format({start}, 'yyyy'), '-Q', string(quarter({start})))"
    pattern = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[grain]
    return f"date_format({start}, '{pattern}')"
