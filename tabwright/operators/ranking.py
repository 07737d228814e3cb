from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.columns import col
from tabwright.functions.predicates import apply_filters, sort_columns
from tabwright.operators.aggregate import sort_and_limit
from tabwright.operators.checks import check_columns
from tabwright.operators.grouping import group_metrics, keys_of


def ranking(
    df: DataFrame,
    dimensions: Sequence[str],
    metrics: Sequence[str],
    aggregation: str,
    sort: Mapping[str, str],
    limit: int = 10,
    filters: Sequence[Mapping[str, Any]] | None = None,
    order_by: Sequence[str] | None = None,
    quantile_method: str = "auto",
    groups: DataFrame | None = None,
) -> DataFrame:
    """The first ``limit`` groups by a metric, with their position as ``rank``.

    Equal values get different ranks, in the order of their keys.
    """
    check_columns(df, dimensions, metrics, (1, None), (1, None), "ranking")
    if not aggregation:
        raise ValueError("ranking needs an aggregation")
    if not sort or sort.get("field") not in metrics:
        raise ValueError("ranking must be sorted by one of its metrics")
    kept = apply_filters(df, filters)
    groups = groups if groups is not None else group_metrics(
        kept,
        keys_of(kept, dimensions),
        dict.fromkeys(metrics, aggregation),
        order_by,
        quantile_method,
    )
    top = sort_and_limit(groups, sort, limit, list(dimensions))
    # The window sees the rows of the top-k only, never the groups.
    place = Window.orderBy(*sort_columns(top, sort, list(dimensions)))
    ranked = top.withColumn("rank", F.row_number().over(place))
    return ranked.select("rank", *[col(c) for c in top.columns])
