"""Chart-ready result sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.operators import DATE, MISSING_SQL, PRIORITY, TOTAL, orders_by_year, orders_with_missing
from catalog.registry import query
from catalog.reports import event_specs
from tabwright.operators import aggregate, ratio_scalar
from tabwright.plans import views
from tabwright.plans.views import View

GRID_SQL = """
    SELECT x, series, round(coalesce(v, 0), 2) AS value
    FROM (SELECT DISTINCT x FROM r) CROSS JOIN (SELECT DISTINCT series FROM r)
    LEFT JOIN (SELECT x, series, {agg} AS v FROM r GROUP BY 1, 2) USING (x, series)
"""


@query(
    MISSING_SQL
    + """
    , r AS (SELECT year(o_orderdate)::VARCHAR AS x, coalesce(o_orderpriority, '其他') AS series, o_totalprice AS v FROM o)
    """
    + GRID_SQL.format(agg="sum(v)"),
    2,
)
def view_lines(t):
    df = orders_with_missing(t).withColumn("year", F.year(DATE).cast("string"))
    return views.series_matrix(df, View("line", "year", TOTAL, "sum", group=PRIORITY))


@query(
    MISSING_SQL
    + """
    , c AS (SELECT o_custkey::VARCHAR AS x, o_orderstatus AS series, max(o_totalprice) AS v FROM o GROUP BY 1, 2),
      top AS (SELECT x FROM c GROUP BY x ORDER BY sum(coalesce(v, 0)) DESC, x LIMIT 10)
    SELECT x, series, round(coalesce(v, 0), 2) AS value
    FROM top CROSS JOIN (SELECT DISTINCT o_orderstatus AS series FROM o) LEFT JOIN c USING (x, series)
    """,
    2,
)
def view_stacked_top(t):
    view = View("stacked_bar", "o_custkey", TOTAL, "max", group="o_orderstatus", limit=10)
    return views.series_matrix(orders_with_missing(t), view)


@query(
    MISSING_SQL
    + """
    SELECT o_orderpriority AS x, '__all__' AS series, count(*)::DOUBLE AS value
    FROM o WHERE coalesce(o_orderpriority, '') <> '' GROUP BY 1
    """
)
def view_pie(t):
    return views.series_matrix(orders_with_missing(t), View("pie", PRIORITY, views.COUNT, "count"))


@query(
    """
    SELECT o_orderpriority AS x, year(o_orderdate)::VARCHAR AS y, round(avg(o_totalprice), 2) AS value
    FROM orders GROUP BY 1, 2
    """,
    2,
)
def view_heatmap(t):
    cells = aggregate(orders_by_year(t), [PRIORITY, "year"], [TOTAL], "avg")
    return views.heatmap(cells, PRIORITY, "year", TOTAL)


@query(
    """
    SELECT round(max(v), 2) AS max
    FROM (SELECT avg(o_totalprice) AS v FROM orders GROUP BY o_orderpriority, year(o_orderdate))
    """,
    2,
)
def view_heatmap_max(t):
    cells = aggregate(orders_by_year(t), [PRIORITY, "year"], [TOTAL], "avg")
    return views.heatmap_max(views.heatmap(cells, PRIORITY, "year", TOTAL))


@query("SELECT event_id::DOUBLE AS x, user_id::DOUBLE AS y FROM events")
def view_scatter(t):
    return views.scatter(t.events)


@query("SELECT round(max(o_totalprice), 2) AS value FROM orders", 2)
def view_kpi(t):
    return views.kpi(aggregate(t.orders, [], [TOTAL], "max"), TOTAL)


@query("SELECT round(avg(o_totalprice / nullif(o_custkey, 0)), 4) AS value FROM orders")
def view_kpi_scalar(t):
    formula = {
        "op": "divide",
        "left": {"op": "field", "field": TOTAL},
        "right": {"op": "field", "field": "o_custkey"},
    }
    rows = aggregate(t.orders, [], [TOTAL], "max")
    return views.kpi(rows, TOTAL, ratio_scalar(t.orders, formula, "per_customer"))


@query(
    """
    WITH u AS (SELECT user_id::VARCHAR AS x, sum(value) AS v FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT 'line' AS type, strftime(ts, '%Y-%m-%d') AS x, round(sum(value), 2) AS value FROM events GROUP BY 2
    UNION ALL SELECT 'bar', x, round(v, 2) FROM u
    UNION ALL SELECT 'pie', event_type, count(*)::DOUBLE FROM events GROUP BY 2
    """,
    2,
)
def views_recommended(t):
    """The views a table gets by itself, checked, with the rows behind them."""
    specs = event_specs(t)
    chosen, _ = views.usable_views(t.events, views.recommend(t.events, specs), specs)
    out = None
    for v in chosen:
        if v.type == "table":
            continue
        rows = views.view_data(t.events, v).select(F.lit(v.type).alias("type"), "x", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
