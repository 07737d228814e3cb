from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import col, number, number_sql
from tabwright.functions.predicates import apply_filters
from tabwright.functions.quantiles import quantiles
from tabwright.operators.checks import check_columns, check_limit
from tabwright.operators.grouping import order_columns

MIN_SAMPLES = 8
FENCE = 1.5
Z_LIMIT = 3.0
ROW_LIMIT = 50
METHODS = ("iqr", "zscore")


def anomaly_bounds(
    df: DataFrame, metric: str, method: str = "iqr", quantile_method: str = "auto"
) -> DataFrame:
    """One row ``lower, upper``: values strictly outside are outliers.

    Both are NULL when there are fewer than eight values, and for the z-score
    also when the values do not vary.
    """
    if method not in METHODS:
        raise ValueError(f"anomaly method must be one of {', '.join(METHODS)}, not {method!r}")
    values = df.selectExpr(f"{number_sql(df, metric)} AS x")
    if method == "iqr":
        found = quantiles(values, [], {"v": "x"}, [0.25, 0.75], quantile_method)
        reach = f"(v.q[1] - v.q[0]) * {FENCE}D"
        return found.selectExpr(
            f"CASE WHEN v.n >= {MIN_SAMPLES} THEN v.q[0] - {reach} END AS lower",
            f"CASE WHEN v.n >= {MIN_SAMPLES} THEN v.q[1] + {reach} END AS upper",
        )
    usable = f"count(x) >= {MIN_SAMPLES} AND stddev_samp(x) > 0"
    return values.agg(
        F.expr(f"CASE WHEN {usable} THEN avg(x) - stddev_samp(x) * {Z_LIMIT}D END AS lower"),
        F.expr(f"CASE WHEN {usable} THEN avg(x) + stddev_samp(x) * {Z_LIMIT}D END AS upper"),
    )


def anomaly(
    df: DataFrame,
    metric: str,
    method: str = "iqr",
    filters: Sequence[Mapping[str, Any]] | None = None,
    limit: int | None = ROW_LIMIT,
    order_by: Sequence[str] | None = None,
    quantile_method: str = "auto",
) -> DataFrame:
    """Rows whose metric is a statistical outlier, with ``_direction``.

    ``limit=None`` returns all of them; otherwise the first ones by ``order_by``.
    """
    check_columns(df, [], [metric], (0, 0), (1, 1), "anomaly")
    check_limit(limit)
    kept = apply_filters(df, filters)
    bounds = anomaly_bounds(kept, metric, method, quantile_method)
    # One row of bounds: a scalar subquery, evaluated once before the scan.
    value, fences = "_outlier_value", "_outlier_bounds"
    direction = (
        f"CASE WHEN {value} < {fences}.lower THEN 'lower' "
        f"WHEN {value} > {fences}.upper THEN 'upper' END"
    )
    found = (
        kept.withColumns(
            {value: number(kept, metric), fences: bounds.select(F.struct("lower", "upper")).scalar()}
        )
        .withColumn("_direction", F.expr(direction))
        .filter("_direction IS NOT NULL")
        .withColumn(metric, col(value))
        .drop(value, fences)
    )
    if limit is None:
        return found
    order = order_columns(found, order_by)
    return (found.orderBy(*order) if order else found).limit(limit)
