"""Reading text cells as numbers, dates and booleans.

Everything is a built-in expression, so a whole table is read in one projection
inside code generation. ``try_cast`` keeps bad cells NULL under ANSI mode.
Functions ending in ``_sql`` take and give SQL text; the others take a column
name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.columns import finite_sql, list_sql, quoted, strip_sql, text_sql

# What a number, date or boolean cell may look like.
PERCENT_SIGNS = ["%", "％"]
CURRENCY_SIGNS = ["￥", "¥", "$", "€", "£"]
# What is removed before a percentage or an amount is read; blanks inside only from amounts.
PERCENT_NOISE = r"\s*[%％]$|[,，]"
CURRENCY_NOISE = r"^[￥¥$€£\s]+|[,，\s]"
LOOSE_NUMBER = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"
# Without a sign: plain, grouped by commas, or grouped by full-width commas.
UNSIGNED = (
    r"^-?([0-9]+(\.[0-9]+)?|[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?|[0-9]{1,3}(，[0-9]{3})+)$"
)
# Years 1900 to 2100.
YEAR = r"((19|20)[0-9]{2}|2100)"
YEAR_FIRST = (
    rf"^{YEAR}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}([ T][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)?$"
)
CHINESE_DATE = rf"^{YEAR}年[0-9]{{1,2}}月[0-9]{{1,2}}日?$"
YEAR_LAST = rf"^[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.]{YEAR}$"
TRUE_WORDS = ["true", "是", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "否", "0", "no", "n", "f"]


def _percent_sql(s: str) -> str:
    return "(" + " OR ".join(f"endswith({s}, {text_sql(p)})" for p in PERCENT_SIGNS) + ")"


def _currency_sql(s: str) -> str:
    return f"(substring({s}, 1, 1) IN ({list_sql(CURRENCY_SIGNS)}))"


def _digits_sql(s: str) -> str:
    """The digits of a number in a trimmed text.

    The kinds exclude each other by their first or last character, so one chain
    decides. A sign alone counts as zero; an amount never ends in a percent sign.
    """

    def rest(noise: str) -> str:
        bare = f"regexp_replace(regexp_replace({s}, {text_sql(noise)}, ''), '^$', '0')"
        return f"regexp_extract({bare}, {text_sql(LOOSE_NUMBER)}, 1)"

    return (
        f"CASE WHEN {_percent_sql(s)} AND NOT {_currency_sql(s)} THEN {rest(PERCENT_NOISE)} "
        f"WHEN {_currency_sql(s)} AND NOT {_percent_sql(s)} THEN {rest(CURRENCY_NOISE)} "
        f"WHEN {s} RLIKE {text_sql(UNSIGNED)} THEN translate({s}, ',，', '') END"
    )


def _value_sql(digits: str, s: str) -> str:
    scale = f"CASE WHEN {_percent_sql(s)} THEN 100D ELSE 1D END"
    return f"(try_cast({digits} AS DOUBLE) / {scale})"


def number_of_sql(s: str) -> str:
    """Number in a trimmed text; NULL when there is none."""
    return finite_sql(_value_sql(_digits_sql(s), s))


def with_cells(
    df: DataFrame,
    numbers: Mapping[str, str] | None = None,
    dates: Mapping[str, str] | None = None,
    booleans: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add columns read from texts; each mapping goes from a new name to SQL text.

    The steps of a read are projections on top of each other, so that no step's
    text is repeated inside the next and the generated code stays short however
    many columns are read.
    """
    numbers, dates, booleans = dict(numbers or {}), dict(dates or {}), dict(booleans or {})
    texts = [*numbers.values(), *dates.values(), *booleans.values()]
    trimmed = [f"_trimmed_{i}" for i in range(len(texts))]
    step = df.selectExpr("*", *[f"{strip_sql(t)} AS {n}" for t, n in zip(texts, trimmed)])
    of_numbers = trimmed[: len(numbers)]
    of_dates = trimmed[len(numbers) : len(numbers) + len(dates)]
    of_booleans = trimmed[len(numbers) + len(dates) :]
    step = step.selectExpr(
        "*",
        *[f"{_digits_sql(s)} AS _digits{s}" for s in of_numbers],
        *[f"{date_of_sql(s)} AS {quoted(n)}" for n, s in zip(dates, of_dates)],
        *[f"{boolean_of_sql(s)} AS {quoted(n)}" for n, s in zip(booleans, of_booleans)],
    )
    step = step.selectExpr("*", *[f"{_value_sql(f'_digits{s}', s)} AS _value{s}" for s in of_numbers])
    return step.selectExpr(
        *[quoted(c) for c in df.columns],
        *[f"{finite_sql(f'_value{s}')} AS {quoted(n)}" for n, s in zip(numbers, of_numbers)],
        *[quoted(n) for n in (*dates, *booleans)],
    )


def format_of_sql(s: str, value: str) -> str:
    """Format tag of a trimmed text, given the number that was read from it."""
    return (
        f"CASE WHEN {value} IS NULL THEN 'plain' WHEN {_percent_sql(s)} THEN 'percentage' "
        f"WHEN {_currency_sql(s)} THEN 'currency' "
        f"WHEN contains({s}, ',') OR contains({s}, '，') THEN 'decimal' "
        f"WHEN double(floor({value})) = {value} THEN 'integer' ELSE 'decimal' END"
    )


def date_of_sql(s: str) -> str:
    """Date in a trimmed text; impossible calendar days are NULL.

    The pattern is checked once and the parts are put in order without another;
    ``try_cast`` then accepts one-digit months and days but no 31 February.
    """
    day_part = f"substring_index(substring_index({s}, ' ', 1), 'T', 1)"
    month_day = f"translate(substring({s}, 1, length({s}) - 5), '/.', '--')"
    ordered = (
        f"CASE WHEN {s} RLIKE {text_sql(YEAR_FIRST)} THEN translate({day_part}, '/.', '--') "
        f"WHEN {s} RLIKE {text_sql(CHINESE_DATE)} THEN translate({s}, '年月日', '--') "
        f"WHEN {s} RLIKE {text_sql(YEAR_LAST)} THEN concat(right({s}, 4), '-', {month_day}) END"
    )
    return (
        f"CASE WHEN substring({s}, 1, 1) BETWEEN '0' AND '9' "
        f"THEN try_cast({ordered} AS DATE) END"
    )


def boolean_of_sql(s: str) -> str:
    return (
        f"CASE WHEN lower({s}) IN ({list_sql(TRUE_WORDS)}) THEN true "
        f"WHEN lower({s}) IN ({list_sql(FALSE_WORDS)}) THEN false END"
    )


def is_boolean_sql(c: str) -> str:
    """Only the two literal words vote for a boolean column."""
    return f"({c} IN ('true', 'false'))"


def parse_number(name: str) -> Column:
    """Number in a text cell: percent, currency, thousands or plain; else NULL."""
    return F.expr(number_of_sql(strip_sql(quoted(name))))


def number_format(name: str) -> Column:
    """Format tag of a text cell; ``plain`` when it is not a number."""
    s = strip_sql(quoted(name))
    return F.expr(format_of_sql(s, number_of_sql(s)))


def parse_date(name: str) -> Column:
    """Date in a text cell, as a ``date``."""
    return F.expr(date_of_sql(strip_sql(quoted(name))))


def parse_boolean(name: str) -> Column:
    return F.expr(boolean_of_sql(strip_sql(quoted(name))))
