"""Schema inference: what type, format and role each text column has.

The whole table is scanned once: every cell votes for a type, all columns in
one aggregate. A small sample of rows can be asked for instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.columns import (
    dtype, inline_sql, key_sql, kind, literal_rows, missing_sql, number_sql, quoted, strip_sql,
    struct_sql, text_sql,
)
from tabwright.fields import FieldSpec, default_aggregation, infer_role
from tabwright.functions.cells import format_of_sql, is_boolean_sql, with_cells
from tabwright.sources.tables import ROW_ID, rows_at

VOTES = ("boolean", "number", "date", "string")
SAMPLE_ROWS = 500
SAMPLE_VALUES = 5
PREFIX = 1000
# Every number and date is made of these characters. A text with others is a string for
# sure, whatever its length; its hash is shorter once the text is.
READABLE = r"^[0-9eE+.,，\s￥¥$€£%％/:T年月日-]*$"
HASHED_FROM = 32
# Shares of the votes a type needs.
BOOLEAN_SHARE, DATE_SHARE, NUMBER_SHARE = 0.9, 0.8, 0.8


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def sampled_rows(df: DataFrame, rows: int = SAMPLE_ROWS, row_id: str = ROW_ID) -> DataFrame:
    """Evenly spaced rows, first and last included; all rows of a small table."""
    total = df.count()
    if total <= rows:
        return df
    return rows_at(df, [i * (total - 1) // (rows - 1) for i in range(rows)], row_id)


def _cell_sql(df: DataFrame, name: str) -> str:
    """A cell in long form: its text, or the vote that its type implies."""
    have = kind(df, name)
    text, known, value = quoted(name), "cast(NULL AS STRING)", "cast(NULL AS DOUBLE)"
    if have == "number":
        text, value = "cast(NULL AS STRING)", number_sql(df, name)
        known = f"CASE WHEN ({value}) IS NULL THEN 'none' ELSE 'number' END"
    elif have != "string" or not isinstance(dtype(df, name), T.StringType):
        text = key_sql(df, name)
        known = f"CASE WHEN {missing_sql(df, name)} THEN 'none' ELSE '{have}' END"
    return struct_sql(field=text_sql(name), text=text, known=known, value=value)


def long_cells(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per cell, so that the reading code is compiled once, not per column.

    Cells that can still be read as a number, date or boolean keep their text. Any
    other is a string for sure, and where that is longer than a hash it is represented
    by its SHA-256, so that long texts are not shuffled.
    """
    cells = df.selectExpr(inline_sql([_cell_sql(df, f) for f in fields]))
    long_text = (
        f"(octet_length(text) > {HASHED_FROM} AND NOT {strip_sql('text')} RLIKE {text_sql(READABLE)})"
    )
    known = (
        "CASE WHEN known IS NOT NULL THEN known WHEN text IS NULL OR text = '' THEN 'none' "
        f"WHEN {is_boolean_sql('text')} THEN 'boolean' WHEN is_long THEN 'string' END"
    )
    return cells.selectExpr("*", f"known IS NULL AND {long_text} AS is_long").selectExpr(
        "field",
        "CASE WHEN is_long THEN decode(unhex(sha2(text, 256)), 'ISO-8859-1') ELSE coalesce(text, '') END AS text",
        f"{known} AS known",
        "value",
    )


def distinct_cells(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``long_cells`` with equal cells added up to ``n``.

    The key holds the value, so a column is spread over all tasks and a hot
    value is one row per task. Everything after this reads each value once.
    """
    cells = long_cells(df, fields)
    return cells.groupBy(*cells.columns).agg(F.expr("count(*) AS n"))


def read_cells(cells: DataFrame) -> DataFrame:
    """Add ``vote`` and, for numbers, ``value`` and ``tag``; for dates ``date``."""
    unread = "CASE WHEN known IS NULL THEN text END"
    read = with_cells(cells, numbers={"read_value": unread}, dates={"date": unread})
    voted = read.withColumn("value", F.expr("coalesce(value, read_value)")).drop("read_value")
    voted = voted.selectExpr(
        "*",
        "coalesce(known, CASE WHEN value IS NOT NULL THEN 'number' "
        "WHEN date IS NOT NULL THEN 'date' ELSE 'string' END) AS vote",
    )
    # A number column has no text: its tag follows from the value alone.
    tag = format_of_sql(strip_sql("text"), "value")
    return voted.selectExpr("*", f"CASE WHEN vote = 'number' THEN {tag} END AS tag")


def vote_counts(n: str) -> list[str]:
    """Aggregates over read cells of weight ``n``."""
    conditions = {t: f"vote = '{t}'" for t in VOTES} | {
        "percentages": "tag = 'percentage'",
        "currencies": "tag = 'currency'",
        "plains": "tag IN ('integer', 'decimal')",
        "fractions": "vote = 'number' AND double(floor(value)) <> value",
    }
    return [
        f"coalesce(sum(CASE WHEN {c} THEN {n} END), 0L) AS {name}" for name, c in conditions.items()
    ]


def count_columns(n: str) -> list[str]:
    return [
        f"sum({n}) AS rows",
        f"coalesce(sum(CASE WHEN vote = 'none' THEN {n} END), 0L) AS nullCount",
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.selectExpr(
        "*", "coalesce(try_divide(nullCount, rows), 0D) AS nullRate", "nullCount > 0 AS nullable"
    )


def every_field(counts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each field, also when the table has no rows at all."""
    named = literal_rows(counts.sparkSession, [(f,) for f in fields], {"field": "string"})
    return named.join(F.broadcast(counts), "field", "left").na.fill(0)


def grouped(df: DataFrame, keys: Sequence[str], aggs: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(a) for a in aggs])


def type_votes(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per column: votes per type, then the formats of the number votes.

    Every cell is read where it lies; only counters are exchanged.
    """
    fields = list(fields or data_columns(df))
    voted = grouped(read_cells(long_cells(df, fields)), ["field"], vote_counts("1L"))
    return every_field(voted, fields)


def decided_types(votes: DataFrame) -> DataFrame:
    """Type, confidence and format from the votes, all as columns.

    A number column takes its most frequent format, ties by name; a plain number
    column is integer when no value has a fraction.
    """
    total = "(boolean + number + date + string)"
    share = {t: f"coalesce(try_divide({t}, {total}), 0D)" for t in VOTES}
    typed = votes.selectExpr(
        "*",
        f"CASE WHEN {share['boolean']} >= {BOOLEAN_SHARE}D THEN 'boolean' "
        f"WHEN {share['date']} >= {DATE_SHARE}D THEN 'date' "
        f"WHEN {share['number']} >= {NUMBER_SHARE}D THEN 'number' ELSE 'string' END AS type",
    )
    chosen = " ".join(f"WHEN '{t}' THEN {share[t]}" for t in VOTES)
    plain = "CASE WHEN fractions = 0 THEN 'integer' ELSE 'decimal' END"
    tags = ", ".join(
        struct_sql(rank=f"-{n}", tag=tag)
        for n, tag in (("currencies", "'currency'"), ("plains", plain), ("percentages", "'percentage'"))
    )
    return typed.selectExpr(
        "*",
        f"CASE type {chosen} END AS confidence",
        f"CASE type WHEN 'number' THEN array_min(array({tags})).tag "
        "WHEN 'date' THEN 'date' ELSE 'plain' END AS format",
    )


def column_counts(
    df: DataFrame,
    fields: Sequence[str] | None = None,
    row_id: str | None = None,
    approx_distinct: bool = False,
) -> DataFrame:
    """One row per column: rows, missing, distinct and the first sample values."""
    return _profile(df, list(fields or data_columns(df)), row_id, approx_distinct, [])


def _profile(
    df: DataFrame,
    fields: list[str],
    row_id: str | None,
    approx_distinct: bool,
    more: Sequence[str],
) -> DataFrame:
    """Counts per column, and ``more`` vote counts, from one scan.

    Exact distinct counts need every distinct cell once; approximate ones need
    no shuffle of cells.
    """
    if approx_distinct:
        cells, n = long_cells(df, fields), "1L"
        identity = "CASE WHEN vote <> 'none' THEN coalesce(string(value), text) END"
        distinct = f"approx_count_distinct({identity})"
    else:
        cells, n, distinct = distinct_cells(df, fields), "n", "count_if(vote <> 'none')"
    read = read_cells(cells) if more else cells.selectExpr("*", "coalesce(known, 'some') AS vote")
    counted = grouped(
        read, ["field"], [*more, *count_columns(n), f"{distinct} AS distinctCount"]
    )
    counts = with_rates(every_field(counted, fields))
    if row_id is None:
        return counts
    samples = first_values(df, fields, row_id)
    return counts.join(F.broadcast(samples), "field", "left")


def first_values(
    df: DataFrame, fields: Sequence[str], row_id: str = ROW_ID, k: int = SAMPLE_VALUES
) -> DataFrame:
    """The first ``k`` non-missing values of each column, in row order.

    Most columns have them among the first rows: ids below ``PREFIX`` come before
    all others. Only columns that do not are looked up in the whole table.
    """
    prefix = df.filter(f"{quoted(row_id)} < {PREFIX}")
    enough = [
        f"count_if(NOT {missing_sql(df, f)}) >= {k} AS f{i}" for i, f in enumerate(fields)
    ]
    full = prefix.agg(*[F.expr(e) for e in enough]).first()
    early = [f for i, f in enumerate(fields) if full[f"f{i}"]]
    late = [f for f in fields if f not in early]
    parts = [_first_cells(d, fs, row_id, k) for d, fs in ((prefix, early), (df, late)) if fs]
    first = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ordered = "transform(array_sort(collect_list(struct(place, value))), s -> s.value)"
    return grouped(first, ["field"], [f"{ordered} AS sampleValues"])


def _first_cells(df: DataFrame, fields: Sequence[str], row_id: str, k: int) -> DataFrame:
    """``row_number() <= k`` lets Spark keep k rows per column and task early."""
    cells = [
        struct_sql(
            field=text_sql(f),
            value=f"CASE WHEN NOT {missing_sql(df, f)} THEN {key_sql(df, f)} END",
        )
        for f in fields
    ]
    return (
        df.selectExpr(f"{quoted(row_id)} AS at", inline_sql(cells))
        .filter("value IS NOT NULL")
        .withColumn("place", F.expr("row_number() OVER (PARTITION BY field ORDER BY at)"))
        .filter(f"place <= {k}")
        .drop("at")
    )


def infer_columns(
    df: DataFrame, sample_rows: int | None = None, approx_distinct: bool = False
) -> DataFrame:
    """The column profile: votes, type, format, confidence, counts; one row each."""
    fields = data_columns(df)
    row_id = ROW_ID if ROW_ID in df.columns else None
    if sample_rows is None:
        weight = "1L" if approx_distinct else "n"
        return decided_types(_profile(df, fields, row_id, approx_distinct, vote_counts(weight)))
    votes = type_votes(sampled_rows(df, sample_rows), fields)
    counts = column_counts(df, fields, row_id, approx_distinct)
    # Both sides have one row per column of the table.
    return decided_types(votes.join(F.broadcast(counts), "field"))


@dataclass(frozen=True)
class Inferred:
    """Specs in column order, and the profile rows they were decided from."""

    specs: list[FieldSpec]
    columns: dict[str, dict[str, Any]]


def infer(
    df: DataFrame,
    overrides: Mapping[str, Mapping[str, Any]] | None = None,
    sample_rows: int | None = None,
    approx_distinct: bool = False,
) -> Inferred:
    """Decide the specs now: one row per column comes to the driver.

    ``overrides`` replaces any decided attribute, as a user's correction would.
    """
    found = {
        r["field"]: r.asDict()
        for r in infer_columns(df, sample_rows, approx_distinct).collect()
    }
    specs = []
    for name in data_columns(df):
        c = found[name]
        role = infer_role(name, c["type"], c["format"], c["distinctCount"], c["rows"])
        spec = FieldSpec(
            name,
            c["type"],
            role,
            c["format"],
            aggregation=default_aggregation(c["type"], role, c["format"]),
        )
        specs.append(replace(spec, **(overrides or {}).get(name, {})))
    return Inferred(specs, found)
