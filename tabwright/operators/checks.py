"""Argument checks shared by the operators: they fail before a plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabwright.columns import require


def check_columns(
    df: DataFrame,
    dimensions: Sequence[str] = (),
    metrics: Sequence[str] = (),
    dims: tuple[int, int | None] = (0, None),
    mets: tuple[int, int | None] = (1, None),
    what: str = "operator",
) -> None:
    for names, (low, high), noun in ((dimensions, dims, "dimension"), (metrics, mets, "metric")):
        if len(names) < low:
            raise ValueError(f"{what} needs at least {low} {noun}(s)")
        if high is not None and len(names) > high:
            raise ValueError(f"{what} takes at most {high} {noun}(s)")
    require(df, [*dimensions, *metrics])


def check_limit(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
