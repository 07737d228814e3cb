"""The seven aggregate functions over numbers that may be missing.

An empty group gives 0, not NULL, and ``count`` counts valid numbers, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

AGGREGATIONS = ("sum", "avg", "count", "min", "max", "median", "last")


def check(how: str) -> None:
    if how not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {', '.join(AGGREGATIONS)}, not {how!r}")


def aggregate_sql(x: str, how: str, order: Sequence[str] = ()) -> str:
    """One aggregate over the number ``x``; NULL when there is no number.

    ``last`` is the last valid number in row order: rows without a number do not
    count. Medians go through :mod:`tabwright.functions.quantiles`.
    """
    if how == "count":
        return f"nullif(count({x}), 0)"
    if how == "last":
        if not order:
            raise ValueError("aggregation 'last' needs order_by: a DataFrame has no row order")
        if len(order) == 1:
            # A bare key keeps the aggregate in a hash table; rows without a key come first.
            keyless = f"max({x}) FILTER (WHERE {order[0]} IS NULL)"
            return f"coalesce(max_by({x}, {order[0]}) FILTER (WHERE {x} IS NOT NULL), {keyless})"
        return f"max_by({x}, struct({', '.join(order)})) FILTER (WHERE {x} IS NOT NULL)"
    return f"{how}({x})"


def or_zero(value: str, how: str = "sum") -> str:
    """The value of an aggregate, 0 where there was nothing to aggregate."""
    return f"coalesce({value}, {'0L' if how == 'count' else '0D'})"
