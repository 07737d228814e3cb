from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import number_sql, text_sql
from tabwright.functions.predicates import apply_filters
from tabwright.operators.checks import check_columns

MIN_PAIRS = 8


def correlation(
    df: DataFrame,
    first: str,
    second: str,
    filters: Sequence[Mapping[str, Any]] | None = None,
) -> DataFrame:
    """Pearson correlation over the rows where both fields are numbers.

    NULL below eight pairs or when a column is constant. One map-side combined
    aggregate of moments; ``corr`` itself would fail on a constant column.
    """
    check_columns(df, [], [first, second], (0, 0), (2, 2), "correlation")
    kept = apply_filters(df, filters)
    pairs = kept.selectExpr(
        f"{number_sql(kept, first)} AS x", f"{number_sql(kept, second)} AS y"
    ).dropna()
    pearson = "try_divide(regr_sxy(x, y), sqrt(regr_sxx(x, y) * regr_syy(x, y)))"
    return pairs.agg(
        F.expr(f"{text_sql(first)} AS metric1"),
        F.expr(f"{text_sql(second)} AS metric2"),
        F.expr(f"CASE WHEN count(*) >= {MIN_PAIRS} THEN {pearson} END AS pearson"),
        F.expr("count(*) AS sampleSize"),
    )
