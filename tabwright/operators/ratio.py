from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import col, quoted, require
from tabwright.functions.formula import compile_formula
from tabwright.functions.predicates import apply_filters
from tabwright.operators.checks import check_limit
from tabwright.operators.grouping import group_metrics, keys_of, order_columns

ROW_LIMIT = 100


def _computed(df: DataFrame, formula: Mapping[str, Any], output: str, filters) -> DataFrame:
    kept = apply_filters(df, filters)
    return kept.withColumn(output, compile_formula(kept, formula))


def ratio(
    df: DataFrame,
    formula: Mapping[str, Any],
    output: str,
    dimensions: Sequence[str] = (),
    filters: Sequence[Mapping[str, Any]] | None = None,
    limit: int | None = None,
    order_by: Sequence[str] | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """A formula per row, and its mean per group when there are dimensions.

    The mean of row values is not the ratio of sums: ``compare`` has that one.
    Without dimensions the result is the first ``limit`` rows that have a value,
    in the order of ``order_by``.
    """
    require(df, list(dimensions))
    valued = _computed(df, formula, output, filters).filter(col(output).isNotNull())
    if dimensions:
        return groups if groups is not None else group_metrics(valued, keys_of(valued, dimensions), {output: "avg"})
    check_limit(limit)
    order = order_columns(valued, order_by)
    rows = valued.orderBy(*order) if order else valued
    return rows.limit(limit or ROW_LIMIT)


def ratio_scalar(
    df: DataFrame,
    formula: Mapping[str, Any],
    output: str,
    dimensions: Sequence[str] = (),
    filters: Sequence[Mapping[str, Any]] | None = None,
) -> DataFrame:
    """One row: the overall mean, and how many rows had no value.

    With dimensions the mean is taken over the groups' means, unweighted.
    """
    require(df, list(dimensions))
    computed = _computed(df, formula, output, filters)
    o = quoted(output)
    no_value = F.expr(f"count_if({o} IS NULL) AS null_count")
    if not dimensions:
        return computed.agg(F.expr(f"avg({o}) AS scalar"), no_value)
    keys = [F.expr(k.group).alias(f"_key_{i}") for i, k in enumerate(keys_of(computed, dimensions))]
    groups = computed.groupBy(*keys).agg(F.expr(f"avg({o}) AS mean"), no_value)
    return groups.agg(
        F.expr("avg(mean) AS scalar"), F.expr("coalesce(sum(null_count), 0L) AS null_count")
    )
