from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import col, quoted
from tabwright.functions.predicates import apply_filters
from tabwright.operators.checks import check_columns
from tabwright.operators.compare import MODES
from tabwright.operators.grouping import group_metrics
from tabwright.operators.timeseries import dated


def growth(
    df: DataFrame,
    time: str,
    metric: str,
    grain: str = "month",
    aggregation: str = "sum",
    mode: str = "rate",
    filters: Sequence[Mapping[str, Any]] | None = None,
    order_by: Sequence[str] | None = None,
    quantile_method: str = "auto",
    groups: DataFrame | None = None,
) -> DataFrame:
    """Change against the previous bucket that has data.

    ``growthRate`` is the change over the absolute previous value, NULL after a
    zero, on the first bucket and in every mode but ``rate``.
    """
    check_columns(df, [time], [metric], (1, 1), (1, 1), "growth")
    if mode not in MODES:
        raise ValueError(f"growth mode must be one of {', '.join(MODES)}, not {mode!r}")
    kept, bucket = dated(apply_filters(df, filters), time, grain)
    series = groups if groups is not None else group_metrics(
        kept, [bucket], {metric: aggregation}, order_by, quantile_method, drop_missing=True
    )
    # One partition is enough here: the window sees one row per calendar bucket.
    m, t = quoted(metric), quoted(time)
    rate = "try_divide(change, abs(_previous))" if mode == "rate" else "cast(NULL AS DOUBLE)"
    return (
        series.withColumn("_previous", F.expr(f"double(lag({m}) OVER (ORDER BY {t}))"))
        .withColumn("change", F.expr(f"{m} - _previous"))
        .withColumn("growthRate", F.expr(rate))
        .drop("_previous")
        .orderBy(col(time))
    )
