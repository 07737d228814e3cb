from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tabwright.columns import require
from tabwright.functions.predicates import apply_filters, sort_columns
from tabwright.operators.checks import check_columns, check_limit
from tabwright.operators.grouping import group_metrics, keys_of


def sort_and_limit(
    out: DataFrame, sort: Mapping[str, str] | None, limit: int | None, ties: Sequence[str]
) -> DataFrame:
    """Order a grouped result and cut it: Spark plans a distributed top-k."""
    check_limit(limit)
    if sort:
        require(out, [sort["field"]])
    if sort or limit:
        out = out.orderBy(*sort_columns(out, sort, ties))
    return out.limit(limit) if limit else out


def aggregate(
    df: DataFrame,
    dimensions: Sequence[str] = (),
    metrics: Sequence[str] = (),
    aggregation: str = "sum",
    filters: Sequence[Mapping[str, Any]] | None = None,
    sort: Mapping[str, str] | None = None,
    limit: int | None = None,
    order_by: Sequence[str] | None = None,
    quantile_method: str = "auto",
    groups: DataFrame | None = None,
) -> DataFrame:
    """One aggregate of up to five metrics over up to three dimensions."""
    check_columns(df, dimensions, metrics, (0, 3), (1, 5), "aggregate")
    kept = apply_filters(df, filters)
    out = groups if groups is not None else group_metrics(
        kept,
        keys_of(kept, dimensions),
        dict.fromkeys(metrics, aggregation),
        order_by,
        quantile_method,
    )
    return sort_and_limit(out, sort, limit, list(dimensions))
