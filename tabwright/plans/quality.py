"""The data-quality report: one row per finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.columns import key_sql, literal_rows, missing_sql, quoted, strip_sql, struct_sql
from tabwright.fields import FieldSpec
from tabwright.functions.cells import boolean_of_sql
from tabwright.plans.infer import (
    VOTES, data_columns, distinct_cells, grouped, read_cells, vote_counts, with_rates,
)
from tabwright.plans.normalize import normalize

HIGH_NULL_RATE = 0.3
MIN_VOTES, SECOND_SHARE, MAIN_SHARE = 5, 0.1, 0.9
MANY_VALUES = 50
MIN_ROWS_FOR_IDENTIFIER = 10
NARROW_ROW = 4
SCHEMA = {
    "code": "string", "level": "string", "field": "string", "count": "bigint", "rate": "double",
}


def _row_identity(df: DataFrame, fields: Sequence[str]) -> list[str]:
    """What two equal rows share. Wide or text rows are compared by SHA-256.

    Hashing on the map side sends 32 bytes per distinct row through the shuffle
    instead of the row itself. A text is preceded by its length and a number or
    date never holds the separator, so no two different rows give the same bytes.
    """
    kinds = {f: df.schema[f].dataType for f in fields}
    plain = (T.NumericType, T.BooleanType, T.DateType)
    if len(fields) <= NARROW_ROW and all(isinstance(t, plain) for t in kinds.values()):
        return [quoted(f) for f in fields]
    parts = []
    for f, t in kinds.items():
        c = quoted(f)
        if isinstance(t, (T.FloatType, T.DoubleType)):
            parts.append(f"coalesce(string({c} + 0D), '')")
        elif isinstance(t, plain):
            parts.append(f"coalesce(string({c}), '')")
        else:
            text = f"coalesce({c}, '')" if isinstance(t, T.StringType) else key_sql(df, f)
            parts += [f"CASE WHEN {c} IS NULL THEN '-' ELSE string(length({text})) END", text]
    return [f"unhex(sha2(concat_ws(':', {', '.join(parts)}), 256))"]


def duplicate_rows(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row: repeats beyond the first, and rows without any value.

    Equal rows collapse before the shuffle, so one row repeated a billion times
    costs no more than a few.
    """
    fields = list(fields or data_columns(df))
    empty = " AND ".join(missing_sql(df, f) for f in fields)
    ids = [f"{c} AS id{i}" for i, c in enumerate(_row_identity(df, fields))]
    rows = df.selectExpr(f"({empty}) AS empty", *ids)
    counted = grouped(rows, rows.columns, ["count(*) AS n"])
    return counted.agg(
        F.expr("coalesce(sum(CASE WHEN NOT empty THEN n - 1 END), 0L) AS duplicateRowCount"),
        F.expr("coalesce(sum(CASE WHEN empty THEN n END), 0L) AS emptyRowCount"),
    )


def _findings_sql() -> str:
    """All findings of one column as an array, NULL where a rule does not fire."""
    votes = "array_sort(array(boolean, number, date, string))"
    total = "(boolean + number + date + string)"
    main, second = f"{votes}[3]", f"{votes}[2]"
    mixed = (
        f"{total} >= {MIN_VOTES} AND ({second} >= {total} * {SECOND_SHARE}D "
        f"OR {main} < {total} * {MAIN_SHARE}D)"
    )
    is_empty = "(rows > 0 AND nullRate >= 1)"
    no_rate = "NULL"
    rules = [
        (is_empty, "EMPTY_COLUMN", "error", "nullCount", "nullRate"),
        (f"NOT {is_empty} AND nullRate > {HIGH_NULL_RATE}D", "HIGH_NULL_RATE", "warning", "nullCount", "nullRate"),
        (mixed, "MIXED_TYPE", "warning", second, f"try_divide({second}, {total})"),
        (
            f"type = 'string' AND distinctCount > {MANY_VALUES} AND distinctCount < rows",
            "HIGH_CARDINALITY", "info", "distinctCount", no_rate,
        ),
        (
            f"rows > {MIN_ROWS_FOR_IDENTIFIER} AND distinctCount = rows AND role <> 'identifier'",
            "POSSIBLE_IDENTIFIER", "info", "distinctCount", no_rate,
        ),
        ("invalidDate > 0", "INVALID_DATE", "warning", "invalidDate", no_rate),
        ("invalidNumber > 0", "INVALID_NUMBER", "warning", "invalidNumber", no_rate),
    ]
    return "array(" + ", ".join(
        f"CASE WHEN {fires} THEN "
        + struct_sql(
            code=f"'{code}'", level=f"'{level}'", field="field",
            count=f"bigint({count})", rate=f"cast({rate} AS DOUBLE)",
        )
        + " END"
        for fires, code, level, count, rate in rules
    ) + ")"


def _checked_columns(df: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """One row per column: votes of the raw cells, counts of the final cells.

    One scan. Every distinct raw cell is read once and becomes a final value;
    equal final values are then added up for the distinct count.
    """
    described = literal_rows(
        df.sparkSession,
        [(s.name, s.type, s.role) for s in specs],
        {"field": "string", "type": "string", "role": "string"},
    )
    # The other side of this join has one row per column of the table.
    cells = read_cells(distinct_cells(df, [s.name for s in specs])).join(
        F.broadcast(described), "field"
    )
    as_text = "CASE WHEN known = 'number' THEN string(value) ELSE text END"
    final = (
        f"CASE WHEN vote = 'none' THEN NULL WHEN role = 'ignored' THEN {as_text} "
        "WHEN type = 'number' THEN string(value) "
        "WHEN type = 'date' THEN CASE WHEN known = 'date' THEN text ELSE string(date) END "
        f"WHEN type = 'boolean' THEN string({boolean_of_sql(strip_sql('text'))}) ELSE {as_text} END"
    )
    checked = cells.selectExpr("*", f"{final} AS final")
    by_value = grouped(
        checked,
        ["field", "type", "role", "final"],
        [
            *vote_counts("n")[: len(VOTES)],
            "sum(n) AS n",
            "coalesce(sum(CASE WHEN vote <> 'none' AND final IS NULL THEN n END), 0L) AS unread",
        ],
    )
    counted = grouped(
        by_value,
        ["field", "type", "role"],
        [
            *[f"sum({v}) AS {v}" for v in VOTES],
            "sum(n) AS rows",
            "coalesce(sum(CASE WHEN final IS NULL THEN n END), 0L) AS nullCount",
            "count(final) AS distinctCount",
            "sum(CASE WHEN type = 'number' THEN unread ELSE 0 END) AS invalidNumber",
            "sum(CASE WHEN type = 'date' THEN unread ELSE 0 END) AS invalidDate",
        ],
    )
    return with_rates(counted)


def quality_report(
    df: DataFrame,
    specs: Sequence[FieldSpec],
    original_rows: int | None = None,
    stored_rows: int | None = None,
    duplicate_names: bool = False,
) -> DataFrame:
    """Findings over the raw table: ``code, level, field, count, rate``.

    Column rules read the votes, the counts of the normalized cells and the
    cells that could not be read; table rules read the rows as a whole.
    """
    found = _checked_columns(df, specs).selectExpr(f"inline(array_compact({_findings_sql()}))")
    repeats = (
        duplicate_rows(normalize(df, specs), [s.name for s in specs])
        .filter("duplicateRowCount > 0")
        .selectExpr(
            "'DUPLICATE_ROWS' AS code", "'warning' AS level", "cast(NULL AS STRING) AS field",
            "duplicateRowCount AS count", "cast(NULL AS DOUBLE) AS rate",
        )
    )
    table = []
    if original_rows is not None and stored_rows is not None and stored_rows < original_rows:
        table.append(("TRUNCATED", "warning", None, original_rows - stored_rows, None))
    if duplicate_names:
        table.append(("DUPLICATE_COLUMN_NAME", "warning", None, None, None))
    out = found.unionByName(repeats)
    return literal_rows(df.sparkSession, table, SCHEMA).unionByName(out) if table else out
