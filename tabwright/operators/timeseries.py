from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tabwright.columns import Key, col
from tabwright.fields import FieldSpec, behavior_aggregation
from tabwright.functions.dates import bucket_sql, check_grain, label_sql, read_date
from tabwright.functions.predicates import apply_filters
from tabwright.operators.checks import check_columns
from tabwright.operators.grouping import group_metrics


DAY = "_bucket_day"


def dated(df: DataFrame, time: str, grain: str) -> tuple[DataFrame, Key]:
    """Rows with a readable date, and the key that puts them into buckets.

    Buckets are grouped by their first day and labelled afterwards.
    """
    check_grain(grain)
    with_day = df.withColumn(DAY, read_date(df, time)).filter(f"{DAY} IS NOT NULL")
    return with_day, Key(time, bucket_sql(DAY, grain), lambda g: label_sql(g, grain))


def timeseries(
    df: DataFrame,
    time: str,
    metrics: Sequence[str],
    grain: str = "month",
    aggregation: str | None = None,
    specs: Sequence[FieldSpec] = (),
    filters: Sequence[Mapping[str, Any]] | None = None,
    order_by: Sequence[str] | None = None,
    quantile_method: str = "auto",
    groups: DataFrame | None = None,
) -> DataFrame:
    """Metrics per calendar bucket, ascending.

    Without an aggregation each metric follows its behavior: a stock keeps its
    last value, a rate or score averages, the rest add up. Rows without a
    readable date are dropped; a bucket without numbers stays, with 0.
    """
    check_columns(df, [time], metrics, (1, 1), (1, None), "timeseries")
    behaviors = {s.name: s for s in specs}
    how = {m: aggregation or behavior_aggregation(behaviors.get(m)) for m in metrics}
    kept, bucket = dated(apply_filters(df, filters), time, grain)
    out = groups if groups is not None else group_metrics(kept, [bucket], how, order_by, quantile_method)
    return out.orderBy(col(time))
