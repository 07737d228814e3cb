from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import col
from tabwright.functions.predicates import apply_filters
from tabwright.operators.aggregate import sort_and_limit
from tabwright.operators.checks import check_columns
from tabwright.operators.grouping import group_metrics, keys_of

MODES = ("absolute", "difference", "rate")


def compare(
    df: DataFrame,
    dimensions: Sequence[str],
    metrics: Sequence[str],
    aggregation: str = "sum",
    mode: str | None = None,
    filters: Sequence[Mapping[str, Any]] | None = None,
    sort: Mapping[str, str] | None = None,
    limit: int | None = None,
    order_by: Sequence[str] | None = None,
    quantile_method: str = "auto",
    groups: DataFrame | None = None,
) -> DataFrame:
    """Groups side by side; a mode also compares the first metric with the second.

    ``difference`` adds ``a_减_b`` and ``rate`` adds ``a_比_b``, both computed on
    the aggregates: the rate is a ratio of sums, NULL when the target is 0.
    """
    check_columns(df, dimensions, metrics, (1, None), (1, None), "compare")
    if mode is not None and mode not in MODES:
        raise ValueError(f"compare mode must be one of {', '.join(MODES)}, not {mode!r}")
    kept = apply_filters(df, filters)
    out = groups if groups is not None else group_metrics(
        kept,
        keys_of(kept, dimensions),
        dict.fromkeys(metrics, aggregation),
        order_by,
        quantile_method,
    )
    if mode and len(metrics) >= 2:
        actual, target = metrics[0], metrics[1]
        a, t = col(actual).cast("double"), col(target).cast("double")
        if mode == "difference":
            out = out.withColumn(f"{actual}_减_{target}", a - t)
        elif mode == "rate":
            out = out.withColumn(f"{actual}_比_{target}", F.try_divide(a, t))
    return sort_and_limit(out, sort, limit, list(dimensions))
