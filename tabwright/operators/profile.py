from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import (
    group_key, inline_sql, key_sql, kind, missing_sql, number_sql, require, struct_sql, text_sql,
)
from tabwright.functions.aggregates import or_zero
from tabwright.functions.predicates import apply_filters
from tabwright.functions.quantiles import quantiles


def profile(
    df: DataFrame,
    fields: Sequence[str] | None = None,
    filters: Sequence[Mapping[str, Any]] | None = None,
    quantile_method: str = "auto",
    approx_distinct: bool = False,
) -> DataFrame:
    """One row per field: counts for all, min, max, mean and median for numbers.

    All fields share one wide aggregate, turned into rows afterwards. Exact distinct
    counts come from a second one with a row per cell, whose key holds the value, so
    that no field's values meet in one task.
    """
    fields = list(fields or df.columns)
    require(df, fields)
    kept = apply_filters(df, filters)
    numbers = [f for f in fields if kind(kept, f) == "number"]
    names = {f: f"_f{i}" for i, f in enumerate(fields)}
    # What is counted, in its own type; a missing cell is NULL.
    base = kept.selectExpr(
        *[
            f"CASE WHEN NOT {missing_sql(kept, f)} THEN {group_key(kept, f).group} END AS {n}"
            for f, n in names.items()
        ],
        *[f"{number_sql(kept, f)} AS {names[f]}x" for f in numbers],
    )
    aggs = ["count(*) AS rows"]
    for f, n in names.items():
        aggs.append(f"count({n}) AS {n}_count")
        if approx_distinct:
            aggs.append(f"approx_count_distinct({n}) AS {n}_distinct")
        if f in numbers:
            aggs.append(
                struct_sql(count=f"count({n}x)", min=f"min({n}x)", max=f"max({n}x)", mean=f"avg({n}x)")
                + f" AS {n}_stats"
            )
    if numbers:
        inputs = {f"{names[f]}_q": f"{names[f]}x" for f in numbers}
        wide = quantiles(base, [], inputs, [0.5], quantile_method, aggs)
    else:
        wide = base.agg(*[F.expr(a) for a in aggs])
    rows = []
    for f, n in names.items():
        count = f"{n}_stats.count" if f in numbers else f"{n}_count"
        if f in numbers:
            statistics = {k: or_zero(f"{n}_stats.{k}") for k in ("min", "max", "mean")}
            statistics["median"] = or_zero(f"{n}_q.q[0]")
        else:
            statistics = dict.fromkeys(("min", "max", "mean", "median"), "cast(NULL AS DOUBLE)")
        rows.append(
            struct_sql(
                field=text_sql(f),
                type=text_sql(kind(kept, f)),
                count=count,
                distinctCount=f"{n}_distinct" if approx_distinct else "0L",
                nullRate=or_zero(f"try_divide(rows - {count}, rows)"),
                **statistics,
            )
        )
    out = wide.selectExpr(inline_sql(rows))
    if approx_distinct:
        return out
    # Both sides have one row per field.
    counts = F.broadcast(_distinct_counts(kept, fields))
    columns = [F.coalesce("n", F.lit(0)).alias(c) if c == "distinctCount" else F.col(c) for c in out.columns]
    return out.join(counts, "field", "left").select(*columns)


def _distinct_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, n``: distinct values of the cells that are there; long ones by their hash."""
    cells = [
        struct_sql(field=text_sql(f), value=f"CASE WHEN NOT {missing_sql(df, f)} THEN {key_sql(df, f)} END")
        for f in fields
    ]
    short = "CASE WHEN octet_length(value) > 32 THEN unhex(sha2(value, 256)) ELSE cast(value AS binary) END"
    values = df.selectExpr(inline_sql(cells)).filter("value IS NOT NULL").selectExpr("field", f"{short} AS value")
    return values.distinct().groupBy("field").agg(F.count("*").alias("n"))
