"""Statistics, trends, comparisons, status analysis, insights and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.operators import FLAG, MISSING_SQL, PRICE, PRIORITY, QTY, TOTAL, orders_with_missing
from catalog.registry import query
from tabwright.columns import literal_rows
from tabwright.fields import FieldSpec, specs_of
from tabwright.plans import insights as insight_rows
from tabwright.plans import stats, tasks, trends

STATS_SQL = """
    SELECT '{f}' AS field, count({f}) AS count, count(*) - count({f}) AS "nullCount",
           round((count(*) - count({f})) / count(*), 2) AS "nullRate",
           round(sum({f}), 2) AS sum, round(avg({f}), 4) AS avg, round(min({f}), 4)::DOUBLE AS min,
           round(max({f}), 4)::DOUBLE AS max, round(quantile_cont({f}::DOUBLE, 0.5), 4) AS median,
           round(quantile_cont({f}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({f}::DOUBLE, 0.75), 4) AS p75,
           round(stddev_samp({f}), 4) AS std, count_if({f} = 0) AS "zeroCount",
           count_if({f} < 0) AS "negativeCount"
    FROM {table}
"""
STATS_FIELDS = [PRICE, QTY, "l_discount", "l_tax"]


def rounded_sum(df):
    """Sums of cents differ in the last bits with the order of adding."""
    return df.withColumn("sum", F.round("sum", 2))


@query(" UNION ALL ".join(STATS_SQL.format(f=f, table="lineitem") for f in STATS_FIELDS))
def numeric_stats(t):
    return rounded_sum(stats.numeric_stats(t.lineitem, STATS_FIELDS))


@query(" UNION ALL ".join(STATS_SQL.format(f=f, table="lineitem") for f in STATS_FIELDS))
def numeric_stats_narrowed(t):
    """The same numbers by the way that large tables take."""
    return rounded_sum(stats.numeric_stats(t.lineitem, STATS_FIELDS, "narrow"))


@query(
    """
    SELECT 'c_acctbal' AS field, count(*) - count(x) AS "nullCount",
           round((count(*) - count(x)) / count(*), 4) AS "nullRate"
    FROM (SELECT CASE WHEN c_custkey % 5 > 1 THEN c_acctbal END AS x FROM customer)
    """
)
def missingness(t):
    sparse = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 > 1, F.col("c_acctbal")))
    return stats.missingness(stats.numeric_stats(sparse, ["c_acctbal", "c_custkey"]))


CATEGORY_SQL = """
    WITH c AS (SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY 1, 2
               UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 1, 2
               UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS up,
                      row_number() OVER (PARTITION BY field ORDER BY n, value) AS down,
                      count(*) OVER (PARTITION BY field) AS distinct_values,
                      sum(n) OVER (PARTITION BY field) AS total FROM c)
"""
CATEGORIES = ["p_brand", "p_type", "p_name"]


@query(
    CATEGORY_SQL
    + """
    SELECT field, count(*) AS "distinctCount", 0::BIGINT AS "nullCount", sum(n)::BIGINT AS total,
           round(1 - sum(n) FILTER (up <= 3) / sum(n), 4) AS "longTailRate",
           count(*) <= 30 AS "lowCardinality"
    FROM r GROUP BY field
    """
)
def category_stats(t):
    return stats.category_stats(t.part, CATEGORIES)


@query(
    CATEGORY_SQL
    + """
    SELECT field, 'top' AS side, up AS rank, value, n AS count, round(n / total, 4) AS rate
    FROM r WHERE up <= 10
    UNION ALL
    SELECT field, 'bottom', down, value, n, round(n / total, 4) FROM r
    WHERE down <= 10 AND distinct_values > 10
    """
)
def category_values(t):
    return stats.category_values(t.part, CATEGORIES)


@query(
    MISSING_SQL
    + """
    , c AS (SELECT o_orderpriority AS value, count(*) AS n FROM o
            WHERE coalesce(o_orderpriority, '') <> '' GROUP BY 1)
    SELECT 'o_orderpriority' AS field, 'top' AS side,
           row_number() OVER (ORDER BY n DESC, value) AS rank, value, n AS count,
           round(n / sum(n) OVER (), 4) AS rate
    FROM c
    """
)
def status_distribution(t):
    return stats.category_values(orders_with_missing(t), [PRIORITY], top=30, bottom=0)


BOUNDS_SQL = """
    WITH v AS (SELECT 'value' AS field, value AS x, event_id FROM events
               UNION ALL SELECT 'user_id', user_id::DOUBLE, event_id FROM events),
         q AS (SELECT field, count(x) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
               FROM v GROUP BY 1),
         b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
"""


@query(
    BOUNDS_SQL
    + """
    SELECT b.field, true AS detected, any_value(n) AS "sampleSize", round(any_value(q1), 4) AS q1,
           round(any_value(q3), 4) AS q3, round(any_value(q3 - q1), 4) AS iqr,
           round(any_value(lo), 4) AS "lowerBound", round(any_value(hi), 4) AS "upperBound",
           count_if(x < lo OR x > hi) AS "outlierCount"
    FROM b JOIN v USING (field) GROUP BY 1
    """
)
def outliers(t):
    return stats.outliers(t.events, ["value", "user_id"])


@query(
    BOUNDS_SQL
    + """
    SELECT field, row_number() OVER (PARTITION BY field ORDER BY event_id) AS rank, x AS value,
           CASE WHEN x < lo THEN 'lower' ELSE 'upper' END AS direction, event_id
    FROM v JOIN b USING (field) WHERE x < lo OR x > hi
    QUALIFY rank <= 5
    """
)
def outlier_samples(t):
    return stats.outlier_samples(t.events, ["value", "user_id"], ["event_id"])


VALUE = FieldSpec("value", "number", "metric")
MEAN_USER = FieldSpec("user_id", "number", "metric", "percentage")
EVENT_TREND_SQL = """
    WITH p AS (
        SELECT 'value' AS field, 'day' AS grain, strftime(ts, '%Y-%m-%d') AS label,
               sum(value) AS value, count(value) AS n FROM events GROUP BY 3
        UNION ALL
        SELECT 'user_id', 'day', strftime(ts, '%Y-%m-%d'), avg(user_id), count(user_id)
        FROM events GROUP BY 3)
"""


@query(EVENT_TREND_SQL + "SELECT field, grain, label, round(value, 4) AS value, n AS count FROM p")
def trend_points_by_day(t):
    return trends.trends(t.events, "ts", [VALUE, MEAN_USER])


@query(
    """
    SELECT 'o_totalprice' AS field, 'month' AS grain, strftime(o_orderdate, '%Y-%m') AS label,
           round(sum(o_totalprice), 2) AS value, count(*) AS count
    FROM orders GROUP BY 3
    """,
    2,
)
def trend_points_by_month(t):
    return trends.trends(t.orders, "o_orderdate", [FieldSpec(TOTAL, "number", "metric")])


@query(
    """
    SELECT 'o_totalprice' AS field, 'week' AS grain, strftime(o_orderdate, '%G-W%V') AS label,
           round(sum(o_totalprice), 2) AS value, count(*) AS count
    FROM (SELECT DATE '1996-01-01' + (date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 270)::INTEGER AS o_orderdate,
                 o_totalprice FROM orders)
    GROUP BY 3
    """,
    2,
)
def trend_points_by_week(t):
    """All orders, their dates folded into nine months so that weeks are the grain."""
    days = t.orders.withColumn("o_orderdate", F.expr(
        "date_add(DATE '1996-01-01', datediff(o_orderdate, DATE '1992-01-01') % 270)"
    ))
    return trends.trends(days, "o_orderdate", [FieldSpec(TOTAL, "number", "metric")])


@query(
    EVENT_TREND_SQL
    + """
    , e AS (SELECT field, grain, arg_min(value, label) AS a, arg_max(value, label) AS z,
                   count(*) AS periods, sum(n)::BIGINT AS size FROM p GROUP BY 1, 2)
    SELECT field, grain, round(a, 4) AS first, round(z, 4) AS last, round(z - a, 4) AS "absoluteChange",
           round((z - a) / abs(a), 4) AS "changeRate", periods, size AS "sampleSize"
    FROM e
    """
)
def trend_changes(t):
    return trends.trend_changes(trends.trends(t.events, "ts", [VALUE, MEAN_USER]))


COMPARE_SQL = """
    WITH g AS (SELECT user_id::VARCHAR AS label, sum(value) AS value, count(value) AS n
               FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(value) > 0),
         r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rank FROM g)
"""


@query(
    COMPARE_SQL
    + """
    SELECT 'value' AS field, rank, label, round(value, 2) AS value, n AS count
    FROM r WHERE rank <= 10
    """,
    2,
)
def comparison_top_groups(t):
    return trends.top_groups(trends.comparisons(t.events, "user_id", [VALUE]))


@query(
    COMPARE_SQL
    + """
    SELECT 'value' AS field, a.label AS "topLabel", round(a.value, 2) AS "topValue",
           z.label AS "bottomLabel", round(z.value, 2) AS "bottomValue",
           round(a.value / abs(z.value), 2) AS ratio
    FROM r a, r z WHERE a.rank = 1 AND z.rank = 10
    """,
    2,
)
def comparison_gap(t):
    return trends.group_gaps(trends.top_groups(trends.comparisons(t.events, "user_id", [VALUE])))


@query(
    """
    SELECT 'event_type' AS field, count(*) AS total, count_if(event_type LIKE '%err%') AS "warnCount",
           round(count_if(event_type LIKE '%err%') / count(*), 4) AS "warnRate", 'value' AS metric,
           round(avg(value) FILTER (event_type LIKE '%err%'), 4) AS "warnAvg",
           round(avg(value) FILTER (event_type NOT LIKE '%err%'), 4) AS "normalAvg",
           round(avg(value) FILTER (event_type LIKE '%err%')
                 - avg(value) FILTER (event_type NOT LIKE '%err%'), 4) AS diff
    FROM events
    """
)
def status_summary(t):
    return trends.status_summary(t.events, "event_type", "value", ["ERR"])


EVENT_ROLES = {
    "event_id": {"role": "identifier"},
    "user_id": {"role": "dimension"},
    "event_type": {"role": "status"},
    "props": {"role": "ignored"},
}


def event_specs(t) -> list[FieldSpec]:
    return specs_of(t.events, EVENT_ROLES)


@query(
    """
    WITH s AS (SELECT count(value) AS n, avg(value) AS m, quantile_cont(value, 0.5) AS med,
                      quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
         b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s),
         o AS (SELECT count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM events, b
               WHERE value < lo OR value > hi),
         v AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1),
         d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value) AS x FROM events GROUP BY 1),
         t AS (SELECT count(*) AS n, arg_min(x, day) AS a, arg_max(x, day) AS z FROM d),
         w AS (SELECT count(*) AS n, count_if(event_type LIKE '%err%') AS k,
                      avg(value) FILTER (event_type LIKE '%err%') AS wa,
                      avg(value) FILTER (event_type NOT LIKE '%err%') AS na FROM events),
         g AS (SELECT user_id::VARCHAR AS k, sum(value) AS x FROM events GROUP BY 1),
         r AS (SELECT *, row_number() OVER (ORDER BY x DESC, k) AS i, count(*) OVER () AS n FROM g),
         e AS (SELECT a.k || ' / ' || z.k AS label, a.x AS hi, z.x AS lo, a.x / abs(z.x) AS q
               FROM r a, r z WHERE a.n <= 30 AND a.i = 1 AND z.i = least(z.n, 10))
    SELECT 'statistics' AS kind, 'info' AS level, 'value' AS fields, NULL AS label, n AS count,
           round(m, 4) AS value, round(med, 4) AS other, 0.0::DOUBLE AS rate FROM s
    UNION ALL SELECT 'outliers', 'warning', 'value', NULL, n, round(lo, 4), round(hi, 4), NULL
    FROM o WHERE n > 0
    UNION ALL SELECT 'top_value', 'info', 'event_type', event_type, n, NULL, NULL,
                     round(n / (SELECT count(*) FROM events), 4) FROM v
    UNION ALL SELECT 'trend', CASE WHEN abs((z - a) / a) > 0.2 THEN 'warning' ELSE 'info' END,
                     'value,ts', CASE WHEN z > a THEN 'up' ELSE 'down' END, n, round(a, 4),
                     round(z, 4), round((z - a) / abs(a), 4) FROM t
    UNION ALL SELECT 'group_gap', CASE WHEN q > 2 THEN 'warning' ELSE 'info' END, 'value,user_id',
                     label, NULL, round(hi, 4), round(lo, 4), round(q, 4) FROM e
    UNION ALL SELECT 'warning_share', CASE WHEN k / n > 0.15 THEN 'warning' ELSE 'info' END,
                     'event_type', NULL, k, NULL, NULL, round(k / n, 4) FROM w
    UNION ALL SELECT 'warning_gap', 'info', 'event_type,value', NULL, NULL, round(wa, 4),
                     round(na, 4), round(wa - na, 4) FROM w
    """
)
def insights(t):
    rows = insight_rows.insights(t.events, event_specs(t), warning_words=["err"])
    return rows.withColumn("fields", F.concat_ws(",", "fields"))


@query(
    """
    WITH g AS (SELECT c_mktsegment AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1),
         r AS (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS rank, count(*) OVER () AS n FROM g),
         e AS (SELECT a.k || ' / ' || z.k AS label, a.v AS hi, z.v AS lo, a.v / abs(z.v) AS ratio
               FROM r a, r z WHERE a.rank = 1 AND z.rank = z.n)
    SELECT 'group_gap' AS kind, CASE WHEN abs(ratio) > 2 THEN 'warning' ELSE 'info' END AS level,
           'c_acctbal,c_mktsegment' AS fields, label, NULL::BIGINT AS count, round(hi, 4) AS value,
           round(lo, 4) AS other, round(ratio, 4) AS rate
    FROM e
    """
)
def insights_group_gap(t):
    df = t.customer.select("c_acctbal", "c_mktsegment")
    specs = specs_of(df, {"c_acctbal": {"aggregation": "avg"}})
    rows = insight_rows.insights(df, specs).filter("kind = 'group_gap'")
    return rows.withColumn("fields", F.concat_ws(",", "fields"))


TASKS = [
    {"id": "by_flag", "operator": "aggregate", "dimensions": [FLAG], "metrics": [PRICE]},
    {
        "id": "top_suppliers",
        "operator": "ranking",
        "dimensions": ["l_suppkey"],
        "metrics": [QTY],
        "aggregation": "sum",
        "sort": {"field": QTY, "direction": "desc"},
        "dependsOn": ["by_flag"],
    },
    {"id": "by_month", "operator": "timeseries", "metrics": [QTY], "time": {"field": "l_shipdate", "grain": "month"}},
    {"id": "no_such_field", "operator": "aggregate", "metrics": ["nope"]},
    {"id": "after_failure", "operator": "profile", "dependsOn": ["no_such_field"]},
    {
        "id": "per_discount",
        "operator": "ratio",
        "dimensions": [FLAG],
        "filters": [{"field": QTY, "operator": "lte", "value": 40}],
        "formula": {
            "outputField": "v",
            "expression": {
                "op": "divide",
                "left": {"op": "field", "field": QTY},
                "right": {"op": "field", "field": "l_discount"},
            },
        },
    },
]


@query(
    """
    SELECT 'by_flag' AS task, 'ready' AS status, count(DISTINCT l_returnflag) AS n FROM lineitem
    UNION ALL SELECT 'top_suppliers', 'ready', least(count(DISTINCT l_suppkey), 10) FROM lineitem
    UNION ALL SELECT 'by_month', 'ready', count(DISTINCT strftime(l_shipdate, '%Y-%m')) FROM lineitem
    UNION ALL SELECT 'no_such_field', 'failed', 0
    UNION ALL SELECT 'after_failure', 'skipped', 0
    UNION ALL SELECT 'per_discount', 'ready', count(DISTINCT l_returnflag) FROM lineitem
    """
)
def task_list(t):
    """A list of tasks: a bad one does not stop the rest, only what depends on it."""
    schema = {"task": "string", "status": "string", "n": "bigint"}
    out = None
    for name, outcome in tasks.run_tasks(t.lineitem, TASKS).items():
        if outcome.rows is None:
            row = literal_rows(t.spark, [(name, outcome.status, 0)], schema)
        else:
            row = outcome.rows.agg(F.count("*").alias("n")).select(
                F.lit(name).alias("task"), F.lit(outcome.status).alias("status"), "n"
            )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """
    SELECT 'per_discount' AS "taskId", 'ratio' AS operator, 'ratio' AS method,
           count(*) AS "sampleSize", count(DISTINCT l_returnflag) AS "rowCount",
           count_if(l_discount = 0) AS "nullCount"
    FROM lineitem WHERE l_quantity <= 40
    """
)
def task_evidence(t):
    found = tasks.evidence(t.lineitem, TASKS[-1])
    return found.select("taskId", "operator", "method", "sampleSize", "rowCount", "nullCount")


@query(
    """
    SELECT 'by_flag' AS task, l_returnflag AS key, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 2
    UNION ALL
    SELECT 'top_suppliers', k, v FROM (SELECT l_suppkey::VARCHAR AS k, round(sum(l_quantity), 2) AS v
                                       FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    UNION ALL SELECT 'by_month', strftime(l_shipdate, '%Y-%m'), round(sum(l_quantity), 2) FROM lineitem GROUP BY 2
    UNION ALL
    SELECT 'per_discount', l_returnflag, round(avg(l_quantity / l_discount), 2) FROM lineitem
    WHERE l_quantity <= 40 AND l_discount <> 0 GROUP BY 2
    """,
    2,
)
def task_rows(t):
    """The rows of the tasks that group the table, all from one scan."""
    out = None
    for name, outcome in tasks.run_tasks(t.lineitem, TASKS).items():
        if outcome.rows is not None:
            key, value = outcome.rows.columns[-2:]
            rows = outcome.rows.select(F.lit(name).alias("task"), F.col(key).alias("key"), F.col(value).alias("value"))
            out = rows if out is None else out.unionByName(rows)
    return out
