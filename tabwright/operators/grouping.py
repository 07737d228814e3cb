"""Grouped metrics: the one aggregation that most operators share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.columns import Key, col, group_key, number_sql, quoted, require
from tabwright.functions import aggregates
from tabwright.functions.quantiles import quantiles, resolve_method


def order_columns(df: DataFrame, order_by: Sequence[str] | None) -> list[Column]:
    require(df, list(order_by or []))
    return [col(c) for c in order_by or []]


def keys_of(df: DataFrame, dimensions: Sequence[str]) -> list[Key]:
    return [group_key(df, d) for d in dimensions]


def group_metrics(
    df: DataFrame,
    keys: Sequence[Key],
    metrics: Mapping[str, str],
    order_by: Sequence[str] | None = None,
    quantile_method: str = "auto",
    drop_missing: bool = False,
    empty_as_zero: bool = True,
) -> DataFrame:
    """Group by ``keys`` and apply one aggregate per metric, all in one pass.

    ``metrics`` maps a number column to its aggregate. Keys come out as text.
    Without keys there is one row, or none when no row survived.
    ``drop_missing`` first drops the rows without any of the metrics;
    ``empty_as_zero=False`` leaves an aggregate of nothing NULL.
    """
    for how in metrics.values():
        aggregates.check(how)
    order_by = list(order_by or [])
    require(df, [*metrics, *order_by])
    medians = [m for m, how in metrics.items() if how == "median"]
    narrow = bool(medians) and resolve_method(df, quantile_method) == "narrow"

    names = [f"_key_{i}" for i in range(len(keys))] or ["_key_all"]
    inputs = {m: f"_in_{i}" for i, m in enumerate(metrics)}
    order = [f"_order_{i}" for i in range(len(order_by))]
    # The narrowing joins on its keys, so there they are text, never NULL.
    groups = [k.text(k.group) if narrow else k.group for k in keys] or ["0"]
    base = df.selectExpr(
        *[f"{g} AS {n}" for g, n in zip(groups, names)],
        *[f"{number_sql(df, m)} AS {i}" for m, i in inputs.items()],
        *[f"{quoted(c)} AS {o}" for c, o in zip(order_by, order)],
    )
    if drop_missing:
        base = base.dropna(how="all", subset=list(inputs.values()))
    simple = [
        f"{aggregates.aggregate_sql(inputs[m], how, order)} AS {quoted(m)}"
        for m, how in metrics.items()
        if how != "median"
    ]
    if medians:
        wanted = {m: inputs[m] for m in medians}
        method = "narrow" if narrow else quantile_method
        out = quantiles(base, names, wanted, [0.5], method, simple)
    else:
        out = base.groupBy(*names).agg(*[F.expr(a) for a in simple])

    values = []
    for m, how in metrics.items():
        value = f"{quoted(m)}.q[0]" if how == "median" else quoted(m)
        value = aggregates.or_zero(value, how) if empty_as_zero else value
        values.append(f"{value} AS {quoted(m)}")
    texts = [
        f"{n if narrow else k.text(n)} AS {quoted(k.name)}" for k, n in zip(keys, names)
    ]
    return out.selectExpr(*texts, *values)
