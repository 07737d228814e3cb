"""Casting a text table to its final column types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabwright.columns import (
    double_text_sql, inline_sql, key_sql, kind, literal_rows, missing_sql, number_sql, quoted, strip_sql,
    struct_sql, text_sql,
)
from tabwright.fields import FieldSpec
from tabwright.functions.cells import with_cells
from tabwright.plans.infer import every_field, grouped
from tabwright.sources.tables import save_table


def _reads_text(df: DataFrame, spec: FieldSpec) -> bool:
    return (
        spec.type != "string"
        and spec.role != "ignored"
        and kind(df, spec.name) != spec.type
        and not (spec.type == "number" and kind(df, spec.name) == "boolean")
    )


def _typed_sql(df: DataFrame, spec: FieldSpec) -> str:
    """A cell that needs no reading: its type is right, or it becomes a text."""
    name, have = spec.name, kind(df, spec.name)
    if spec.role == "ignored":
        return quoted(name)
    if spec.type == "number":
        return number_sql(df, name)
    if spec.type == "string" and have != "string":
        return f"CASE WHEN NOT {missing_sql(df, name)} THEN {key_sql(df, name)} END"
    return f"date({quoted(name)})" if have == "date" else quoted(name)


def _staged(df: DataFrame, specs: Sequence[FieldSpec]) -> tuple[DataFrame, list[str], dict[str, tuple[str, str]]]:
    """The raw cells beside the cells read, how both become the final columns, and where a field was read."""
    by_name = {s.name: s for s in specs}
    read = {
        s.name: (f"_final_{i}", s.type) for i, s in enumerate(specs) if _reads_text(df, s)
    }

    def texts(type_: str) -> dict[str, str]:
        return {n: key_sql(df, name) for name, (n, t) in read.items() if t == type_}

    out = []
    for c in df.columns:
        if c in read:
            out.append(f"{read[c][0]} AS {quoted(c)}")
        elif c in by_name:
            out.append(f"{_typed_sql(df, by_name[c])} AS {quoted(c)}")
        else:
            out.append(quoted(c))
    return with_cells(df, texts("number"), texts("date"), texts("boolean")), out, read


def normalize(df: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """All rows under the final types; other columns stay as they are.

    It always starts from the raw text, so a corrected type can be applied again
    without losing what an earlier type could not read. Unreadable cells are NULL.
    """
    staged, out, _ = _staged(df, specs)
    return staged.selectExpr(*out)


def normalize_and_save(df: DataFrame, specs: Sequence[FieldSpec], path: str, mode: str = "errorifexists") -> DataFrame:
    """Normalize, keep the table, and count on the way: no second scan.

    One row per field: ``field, rows, invalidNumber, invalidDate, changed``, as
    :func:`normalization_counts` has them. The counts are observed by the tasks that write.
    """
    staged, out, read = _staged(df, specs)
    counted = [s for s in specs if s.type in ("number", "date") and s.name in read and kind(df, s.name) == "string"]
    metrics = [F.expr("count(*) AS rows")]
    for i, s in enumerate(counted):
        text, final = f"CASE WHEN NOT {missing_sql(df, s.name)} THEN {strip_sql(key_sql(df, s.name))} END", read[s.name][0]
        metrics.append(F.expr(f"count_if(({text}) IS NOT NULL AND {final} IS NULL) AS unread_{i}"))
        if s.type == "number":
            metrics.append(F.expr(f"count_if({double_text_sql(final)} <> ({text})) AS changed_{i}"))
    seen = Observation()
    save_table(staged.observe(seen, *metrics).selectExpr(*out), path, mode, specs)
    got = seen.get
    at = {s.name: i for i, s in enumerate(counted)}
    rows = []
    for s in specs:
        unread = got[f"unread_{at[s.name]}"] if s.name in at else 0
        changed = got.get(f"changed_{at[s.name]}", 0) if s.name in at else 0
        rows.append((s.name, got["rows"], unread if s.type == "number" else 0, unread if s.type == "date" else 0, changed))
    columns = ("rows", "invalidNumber", "invalidDate", "changed")
    return literal_rows(df.sparkSession, rows, {"field": "string", **dict.fromkeys(columns, "bigint")})


def normalization_counts(df: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """One row per field: cells that could not be read, and cells that changed.

    Read in long form, like the type votes: number and date code is compiled
    once for the whole table.
    """
    cells = [
        struct_sql(
            field=text_sql(s.name),
            type=f"'{s.type}'",
            text=f"CASE WHEN NOT {missing_sql(df, s.name)} THEN {strip_sql(key_sql(df, s.name))} END",
        )
        for s in specs
        if s.type in ("number", "date") and s.role != "ignored" and kind(df, s.name) == "string"
    ]
    # Without a column to read there is still one row per field.
    cells = cells or [struct_sql(field="''", type="''", text="cast(NULL AS STRING)")]
    read = with_cells(
        df.selectExpr(inline_sql(cells)),
        numbers={"number": "CASE WHEN type = 'number' THEN text END"},
        dates={"date": "CASE WHEN type = 'date' THEN text END"},
    )
    unread = "text IS NOT NULL AND number IS NULL AND date IS NULL"
    counted = grouped(
        read,
        ["field"],
        [
            f"count_if(type = 'number' AND {unread}) AS invalidNumber",
            f"count_if(type = 'date' AND {unread}) AS invalidDate",
            f"count_if({double_text_sql('number')} <> text) AS changed",
        ],
    )
    return every_field(counted, [s.name for s in specs])
