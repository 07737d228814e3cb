from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import col, key_sql
from tabwright.functions import aggregates
from tabwright.functions.predicates import apply_filters
from tabwright.operators.checks import check_columns
from tabwright.operators.grouping import group_metrics, keys_of

MANY_COLUMNS = 20


def pivot_values(df: DataFrame, dimension: str) -> list[str]:
    """The sorted values that become columns, within Spark's own pivot bound."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = df.selectExpr(f"{key_sql(df, dimension)} AS v").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{dimension} has more than {most} values: too many pivot columns")
    return sorted(r["v"] for r in found)


def pivot(
    df: DataFrame,
    dimensions: Sequence[str],
    metrics: Sequence[str],
    aggregation: str = "sum",
    filters: Sequence[Mapping[str, Any]] | None = None,
    values: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    quantile_method: str = "auto",
    groups: DataFrame | None = None,
) -> DataFrame:
    """The last dimension becomes columns ``metric[value]``; the rest stay as rows.

    A cell without numbers is NULL, not 0. Pass ``values`` to spare the job that
    looks them up. Grouping comes first and only the groups are pivoted.
    """
    check_columns(df, dimensions, metrics, (2, 3), (1, 3), "pivot")
    aggregates.check(aggregation)
    kept = apply_filters(df, filters)
    rows, across = list(dimensions[:-1]), dimensions[-1]
    if values is None:
        values = pivot_values(kept if groups is None else groups, across)
    cells = groups if groups is not None else group_metrics(
        kept,
        keys_of(kept, dimensions),
        dict.fromkeys(metrics, aggregation),
        order_by,
        quantile_method,
        empty_as_zero=False,
    )
    wide = (
        cells.groupBy(*[col(r) for r in rows])
        .pivot(across, list(values))
        .agg(*[F.first(col(m)).alias(m) for m in metrics])
    )
    # Spark names a pivoted column by its value, and by value_metric for several.
    spark_name = (lambda v, m: v) if len(metrics) == 1 else (lambda v, m: f"{v}_{m}")
    return wide.select(
        *[col(r) for r in rows],
        *[col(spark_name(v, m)).alias(f"{m}[{v}]") for v in values for m in metrics],
    ).orderBy(*[col(r) for r in rows])
