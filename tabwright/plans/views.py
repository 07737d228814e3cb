"""Chart-ready result sets: the data of a view, not its drawing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import (
    col, key_sql, kind, missing_sql, number_sql, quoted, require, text_sql,
)
from tabwright.fields import FieldSpec, resolve_aggregation, split_roles
from tabwright.plans.infer import grouped
from tabwright.plans.stats import category_totals, value_counts
from tabwright.sources.tables import preview

COUNT, ROWS = "__count__", "__rows__"
OTHER, ALL = "其他", "__all__"
LINE_TYPES, CUT_TYPES = ("line", "area"), ("bar", "stacked_bar", "pie")
VIEW_TYPES = LINE_TYPES + CUT_TYPES + ("table", "kpi", "scatter", "heatmap")
VIEW_AGGREGATIONS = ("sum", "avg", "count", "max", "min")
MAX_VIEWS, TREND_VIEWS, COMPARISON_VIEWS = 8, 3, 2
PIE_MIN, PIE_MAX, TOP_N = 2, 6, 10
FEW_CATEGORIES = 1000
# Trends first, then comparisons, shares, the rest and the raw rows.
VIEW_ORDER = {"line": 1, "bar": 2, "pie": 3, "table": 5}


@dataclass(frozen=True)
class View:
    type: str
    x: str
    y: str
    aggregation: str = "sum"
    group: str | None = None
    limit: int | None = None
    max_series: int | None = None


def series_matrix(df: DataFrame, view: View) -> DataFrame:
    """``x, series, value`` for every pair of a category and a series.

    Cells without data are 0. Lines are in x order; the other types come by
    falling total, and only their first ``limit`` categories are kept. With ``max_series``
    the series of the greatest totals are kept and all others become one, ``其他``.
    """
    if view.aggregation not in VIEW_AGGREGATIONS:
        raise ValueError(f"a view cannot be aggregated by {view.aggregation!r}")
    counting = view.aggregation == "count" or view.y == COUNT
    require(df, [view.x] + ([view.group] if view.group else []))
    group = text_sql(ALL)
    if view.group:
        # Only an absent group is named; an empty text stays an empty text.
        g = quoted(view.group)
        group = f"CASE WHEN {g} IS NULL THEN {text_sql(OTHER)} ELSE {key_sql(df, view.group)} END"
    value = "1D" if counting else number_sql(df, view.y)
    rows = df.filter(f"NOT {missing_sql(df, view.x)}").selectExpr(
        f"{key_sql(df, view.x)} AS x", f"{group} AS series", f"{value} AS v"
    )
    how = "count" if counting else view.aggregation
    cells = grouped(rows, ["x", "series"], [f"coalesce(double({how}(v)), 0D) AS value"])
    if view.type in LINE_TYPES:
        order, cells = [col("x").asc()], cells.selectExpr("*", "0D AS total")
    else:
        totals = grouped(cells, ["x"], ["sum(value) AS total"])
        order = [col("total").desc(), col("x").asc()]
        if view.limit and view.type in CUT_TYPES:
            totals = totals.orderBy(*order).limit(view.limit)
            # A top-k is as short as its limit, so a small one can be broadcast.
            totals = F.broadcast(totals) if view.limit <= FEW_CATEGORIES else totals
        cells = cells.join(totals, "x")
    if not view.group:
        return cells.orderBy(*order).select("x", "series", "value")
    if view.max_series is not None:
        cells = _top_series(rows, cells, how, view.max_series)
    # Every category is spread over the list of series, which the result has once per category
    # anyway, and meets its own cells by an equi-join on both names.
    names = rows.select("series").distinct() if view.max_series is None else cells.select("series").distinct()
    listed = names.agg(F.sort_array(F.collect_list("series"))).scalar()
    grid = cells.select("x", "total").distinct().withColumn("series", F.explode(listed))
    filled = grid.join(cells.drop("total"), ["x", "series"], "left").na.fill(0.0, ["value"])
    return filled.orderBy(*order, col("series")).select("x", "series", "value")


def _top_series(rows: DataFrame, cells: DataFrame, how: str, most: int) -> DataFrame:
    """Cells of the ``most`` series with the greatest totals; the rows of the others are one series more.

    The others are aggregated from their rows, so that an average or a maximum of them is right.
    """
    totals = grouped(cells, ["series"], ["sum(value) AS series_total"])
    top = totals.orderBy(col("series_total").desc(), col("series")).limit(most).select("series", F.lit(True).alias("top"))
    named = rows.join(cells.select("x", "total").distinct(), "x").join(F.broadcast(top) if most <= FEW_CATEGORIES else top, "series", "left")
    named = named.withColumn("series", F.expr(f"CASE WHEN top THEN series ELSE {text_sql(OTHER)} END"))
    return grouped(named, ["x", "total", "series"], [f"coalesce(double({how}(v)), 0D) AS value"])


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Cells of an aggregated result; anything but a number is 0."""
    v = number_sql(df, value) if kind(df, value) == "number" else "0D"
    return df.selectExpr(
        f"{key_sql(df, x)} AS x", f"{key_sql(df, y)} AS y", f"coalesce({v}, 0D) AS value"
    )


def heatmap_max(cells: DataFrame) -> DataFrame:
    """One row: the top of the color scale, never below 0."""
    return cells.agg(F.expr("greatest(coalesce(max(value), 0D), 0D) AS max"))


def scatter(df: DataFrame, x: str | None = None, y: str | None = None) -> DataFrame:
    """Pairs of the first two number columns, or of the given ones."""
    numbers = [c for c in df.columns if kind(df, c) == "number"]
    if x is None or y is None:
        if len(numbers) < 2:
            raise ValueError("a scatter view needs two number columns")
        x, y = x or numbers[0], y or numbers[1]
    return df.selectExpr(f"{number_sql(df, x)} AS x", f"{number_sql(df, y)} AS y").dropna()


def kpi(rows: DataFrame, metric: str, scalar: DataFrame | None = None) -> DataFrame:
    """One row ``value``: the scalar if there is one, else the first row's metric."""
    first = rows.select(col(metric).cast("double").alias("value")).limit(1)
    if scalar is None:
        return first.agg(F.first("value").alias("value"))
    given = scalar.select(col(scalar.columns[0]).cast("double").alias("value"))
    return given.agg(F.first("value").alias("given")).select(
        F.coalesce(col("given"), first.agg(F.first("value")).scalar()).alias("value")
    )


def distinct_counts(df: DataFrame, fields: Sequence[str]) -> dict[str, int]:
    """How many values each field has; one small row per field is read."""
    if not fields:
        return {}
    found = category_totals(value_counts(df, list(fields))).collect()
    return {**dict.fromkeys(fields, 0), **{r["field"]: r["distinctCount"] for r in found}}


def recommend(df: DataFrame, specs: Sequence[FieldSpec], most: int = MAX_VIEWS) -> list[View]:
    """The views a table gets by itself, from its roles and distinct counts."""
    roles = split_roles(list(specs))
    asked = [s.name for s in (roles.dimension, *roles.statuses[:1]) if s]
    distinct = distinct_counts(df, asked)
    views = []
    if roles.time:
        views += [
            View("line", roles.time.name, m.name, resolve_aggregation(m))
            for m in roles.metrics[:TREND_VIEWS]
        ]
    if roles.dimension and distinct[roles.dimension.name] >= 2:
        views += [
            View("bar", roles.dimension.name, m.name, resolve_aggregation(m), limit=TOP_N)
            for m in roles.metrics[:COMPARISON_VIEWS]
        ]
    if roles.statuses:
        name = roles.statuses[0].name
        pie = PIE_MIN <= distinct[name] <= PIE_MAX
        views.append(
            View("pie" if pie else "bar", name, COUNT, "count", limit=None if pie else TOP_N)
        )
    first = roles.active[0].name if roles.active else "index"
    views.append(View("table", first, ROWS, "count", limit=TOP_N))
    return views[:most]


def check_view(view: View, specs: Sequence[FieldSpec]) -> list[str]:
    """Why a view cannot be shown; empty when it can."""
    by_name = {s.name: s for s in specs}
    problems = [
        f"unknown field {n!r}"
        for n in (view.x, view.group)
        if n is not None and n not in by_name
    ]
    if view.y in (COUNT, ROWS):
        return problems
    y = by_name.get(view.y)
    if y is None:
        return problems + [f"unknown field {view.y!r}"]
    if view.type == "line" and y.type != "number":
        problems.append(f"{y.name} is not a number, so it has no line")
    if y.format == "percentage" and view.aggregation == "sum":
        problems.append(f"percentages do not add up: {y.name}")
    if y.role == "identifier" and view.type in ("line", "bar"):
        problems.append(f"{y.name} is an identifier, not a metric")
    return problems


def usable_views(
    df: DataFrame, views: Sequence[View], specs: Sequence[FieldSpec]
) -> tuple[list[View], list[str]]:
    """The views that can be shown, adjusted and in display order, and the problems.

    A pie of more than six values becomes a bar, and more than ten categories
    are cut to the first ten. A bad view is left out; it does not stop the rest.
    """
    problems, good = [], []
    for v in views:
        found = check_view(v, specs)
        problems += found
        if not found:
            good.append(v)
    asked = {v.x for v in good if v.type == "pie" or (v.type == "bar" and v.limit is None)}
    distinct = distinct_counts(df, sorted(asked))
    out = []
    for v in good:
        if v.type == "pie" and distinct[v.x] > PIE_MAX:
            problems.append(f"{v.x} has {distinct[v.x]} values: shown as a bar")
            v = replace(v, type="bar", limit=v.limit or TOP_N)
        if v.type in ("bar", "pie") and v.limit is None and distinct[v.x] > TOP_N:
            v = replace(v, limit=TOP_N)
        out.append(v)
    return sorted(out, key=lambda v: VIEW_ORDER.get(v.type, 4)), problems


def view_data(df: DataFrame, view: View, order_by: Sequence[str] = ()) -> DataFrame:
    """The rows behind a view."""
    if view.type == "table":
        return preview(df, view.limit or TOP_N, order_by or df.columns[:1])
    if view.type == "scatter":
        return scatter(df, view.x, view.y)
    return series_matrix(df, view)

