"""Queries whose data, derived from the tables, reaches the rarer cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.files import new_folder
from catalog.operators import DATE, PRIORITY, TOTAL
from catalog.raw import RAW_SPECS, RAW_SQL, raw_orders
from catalog.registry import query
from tabwright.columns import literal_rows
from tabwright.fields import FieldSpec
from tabwright.operators import aggregate, timeseries
from tabwright.plans import context, insights, normalize, stats, tasks, views
from tabwright.plans.views import View
from tabwright.sources import read_table, save_table

# --- reading ---------------------------------------------------------------------------


@query(
    """
    SELECT o_orderpriority, coalesce(sum(CASE o_orderkey % 6 WHEN 0 THEN 12 WHEN 1 THEN 1000 WHEN 5 THEN -0.5 END), 0)::DOUBLE AS cell
    FROM orders GROUP BY 1
    """
)
def aggregate_number_texts(t):
    """Texts are read as numbers where they are numbers; others, also NaN, are missing."""
    cell = "CASE o_orderkey % 6 WHEN 0 THEN '12' WHEN 1 THEN ' 1e3 ' WHEN 2 THEN 'NaN' WHEN 3 THEN '' WHEN 4 THEN '12 apples' ELSE '-.5' END"
    return aggregate(t.orders.selectExpr(PRIORITY, f"{cell} AS cell"), [PRIORITY], ["cell"], "sum")


@query(
    """
    SELECT CASE o_orderkey % 6 WHEN 3 THEN year(o_orderdate) || '-01' ELSE strftime(o_orderdate, '%Y-%m') END AS day,
           round(sum(o_totalprice), 2) AS o_totalprice
    FROM orders WHERE o_orderkey % 6 <> 4 GROUP BY 1
    """,
    2,
)
def timeseries_text_dates(t):
    """A month or a year alone is its first day; unreadable dates are left out."""
    y, m, d = (f"{part}({DATE})" for part in ("year", "month", "day"))
    cell = (
        f"CASE o_orderkey % 6 WHEN 0 THEN date_format({DATE}, 'yyyy-MM') WHEN 1 THEN date_format({DATE}, \"yyyy-MM-dd'T'HH:mm:ss\") "
        f"WHEN 2 THEN concat_ws('/', {y}, {m}, {d}) WHEN 3 THEN string({y}) WHEN 4 THEN 'soon' "
        f"ELSE concat({y}, '年', {m}, '月', {d}, '日') END"
    )
    return timeseries(t.orders.selectExpr(f"{cell} AS day", TOTAL), "day", [TOTAL], "month")


@query(
    RAW_SQL
    + """
    SELECT 'o_orderkey' AS field, count(*) AS rows, 0::BIGINT AS "invalidNumber", 0::BIGINT AS "invalidDate", 0::BIGINT AS changed FROM r
    UNION ALL SELECT 'amount', count(*), count_if(k % 7 = 5), 0, count_if(k % 7 IN (0, 1, 2) OR (k % 7 = 3 AND whole >= 1000)) FROM r
    UNION ALL SELECT 'day', count(*), 0, count_if(k % 8 = 3), 0 FROM r
    UNION ALL SELECT 'urgent', count(*), 0, 0, 0 FROM r
    UNION ALL SELECT 'status', count(*), 0, 0, 0 FROM r
    """
)
def counts_while_saving(t):
    """Cells that could not be read, counted by the tasks that write the table."""
    return normalize.normalize_and_save(raw_orders(t), RAW_SPECS, new_folder(t, "observed"))


@query(
    """
    SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders
    WHERE o_totalprice BETWEEN 1000 AND 3000 OR o_orderkey = 77
    """,
    2,
)
def laid_out_table(t):
    """A table kept in ranges of a column, with Bloom filters on another, answers filters on both."""
    path = new_folder(t, "laid-out")
    save_table(t.orders, path, cluster_by=[TOTAL], lookup=["o_orderkey"])
    kept = read_table(t.spark, path).select("o_orderkey", "o_orderstatus", TOTAL)
    return kept.filter(F.col(TOTAL).between(1000, 3000)).unionByName(
        kept.filter(f"o_orderkey = 77 AND NOT {TOTAL} BETWEEN 1000 AND 3000")
    )


# --- counts and hashes -------------------------------------------------------------------


def cell_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c}::VARCHAR) || ':' || {c}::VARCHAR END"


FINGERPRINT_SQL = f"""
    WITH h AS (SELECT md5({' || '.join(cell_sql(c) for c in ('doc_id', 'text', 'lang', 'source', 'n_chars'))}) AS h FROM documents)
    SELECT sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 16))::UBIGINT) || ':' || sum(('0x' || substr(h, 17, 16))::UBIGINT))
           AS fingerprint
    FROM h
"""


@query(FINGERPRINT_SQL)
def fingerprint(t):
    """A digest of the whole table."""
    return context.fingerprint(t.documents)


@query(FINGERPRINT_SQL)
def fingerprint_of_growing_files(t):
    """The same digest from states of files, the second half of which came later."""
    path, states = new_folder(t, "grown"), new_folder(t, "states")
    t.documents.filter("doc_id % 2 = 0").write.parquet(path)
    context.growing_fingerprint(t.spark, path, states).collect()
    t.documents.filter("doc_id % 2 = 1").write.mode("append").parquet(path)
    return context.growing_fingerprint(t.spark, path, states)


@query(
    """
    WITH r AS (SELECT md5(to_json({'o_orderstatus': s, 'n': n})::VARCHAR) AS h
               FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1))
    SELECT sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 16))::UBIGINT) || ':' || sum(('0x' || substr(h, 17, 16))::UBIGINT))
           AS "resultHash"
    FROM r
    """
)
def hash_of_rows(t):
    return tasks.result_hash(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))


@query(
    """
    SELECT 'o_orderkey' AS field, true AS close, count(DISTINCT o_orderkey) AS exact FROM orders
    UNION ALL SELECT 'o_custkey', true, count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'o_orderpriority', true, count(DISTINCT o_orderpriority) FROM orders
    """
)
def distinct_from_sketches(t):
    """Sketches of the years, merged, tell the distinct values of the whole within two percent."""
    fields = ["o_orderkey", "o_custkey", "o_orderpriority"]
    old, new = t.orders.filter(f"year({DATE}) < 1998"), t.orders.filter(f"NOT year({DATE}) < 1998")
    parts = stats.distinct_sketches(old, fields).unionByName(stats.distinct_sketches(new, fields))
    exact = stats.category_stats(t.orders, fields).select("field", F.col("distinctCount").alias("exact"))
    close = F.expr("abs(distinctCount - exact) <= 0.02 * exact")
    return stats.merged_distinct(parts).join(exact, "field").select("field", close.alias("close"), "exact")


# --- reports -------------------------------------------------------------------------------


@query(
    """
    WITH d AS (SELECT CASE WHEN c_custkey % 5 > 1 THEN c_acctbal END AS balance, 'town ' || c_custkey % 40 AS town
               FROM customer, range(2)),
         n AS (SELECT town, count(*) AS n FROM d GROUP BY 1),
         top AS (SELECT sum(n) AS n FROM (SELECT n FROM n ORDER BY n DESC, town LIMIT 3))
    SELECT 'missing' AS kind, 'warning' AS level, 'balance' AS fields, NULL::VARCHAR AS label, count_if(balance IS NULL) AS count,
           NULL::DOUBLE AS value, NULL::DOUBLE AS other, round(count_if(balance IS NULL) / count(*), 4) AS rate FROM d
    UNION ALL
    SELECT 'long_tail', 'info', 'town', NULL, count(*), NULL, NULL, round(1 - (SELECT n FROM top) / sum(n), 4) FROM n
    UNION ALL
    SELECT 'duplicate_rows', 'warning', '', NULL, count(*) - count(DISTINCT (balance, town)), NULL, NULL, NULL FROM d
    UNION ALL
    SELECT 'truncated', 'warning', '', NULL, count(*), 1000000, NULL, NULL FROM d HAVING count(*) < 1000000
    """
)
def insights_of_gaps(t):
    """Missing cells, a long tail, repeated rows and a cut table."""
    once = t.customer.selectExpr("CASE WHEN c_custkey % 5 > 1 THEN c_acctbal END AS balance", "concat('town ', c_custkey % 40) AS town")
    specs = [FieldSpec("balance", "number", "metric"), FieldSpec("town", "string", "status")]
    rows = insights.insights(once.unionByName(once), specs, original_rows=1_000_000)
    kinds = "kind IN ('missing', 'long_tail', 'duplicate_rows', 'truncated')"
    return rows.filter(kinds).withColumn("fields", F.concat_ws(",", "fields"))


LEGAL = [
    FieldSpec("l_discount", "number", "metric", "percentage"),
    FieldSpec("l_orderkey", "number", "identifier"),
    FieldSpec("l_quantity", "number", "metric", behavior="stock"),
]
RULES = [
    {"id": "sum_of_rates", "operator": "aggregate", "metrics": ["l_discount"], "aggregation": "sum"},
    {"id": "mean_of_rates", "operator": "aggregate", "metrics": ["l_discount"], "aggregation": "avg"},
    {"id": "sum_of_keys", "operator": "aggregate", "metrics": ["l_orderkey"], "aggregation": "sum"},
    {"id": "count_of_keys", "operator": "aggregate", "metrics": ["l_orderkey"], "aggregation": "count"},
    {"id": "stock_over_time", "operator": "timeseries", "metrics": ["l_quantity"], "aggregation": "sum", "time": {"field": "l_shipdate", "grain": "year"}},
    {"id": "stock_by_flag", "operator": "aggregate", "metrics": ["l_quantity"], "aggregation": "sum"},
]


@query(
    """
    SELECT 'sum_of_rates' AS task, 'failed' AS status, NULL::DOUBLE AS value
    UNION ALL SELECT 'mean_of_rates', 'ready', round(avg(l_discount), 4) FROM lineitem
    UNION ALL SELECT 'sum_of_keys', 'failed', NULL
    UNION ALL SELECT 'count_of_keys', 'ready', count(l_orderkey)::DOUBLE FROM lineitem
    UNION ALL SELECT 'stock_over_time', 'failed', NULL
    UNION ALL SELECT 'stock_by_flag', 'ready', sum(l_quantity) FROM lineitem
    """
)
def aggregation_rules(t):
    """What may be added up follows from the role, format and behaviour of a field."""
    out = None
    for name, outcome in tasks.run_tasks(t.lineitem, RULES, LEGAL).items():
        if outcome.rows is None:
            row = literal_rows(t.spark, [(name, outcome.status, None)], {"task": "string", "status": "string", "value": "double"})
        else:
            value = F.col(outcome.rows.columns[-1]).cast("double")
            row = outcome.rows.select(F.lit(name).alias("task"), F.lit(outcome.status).alias("status"), value.alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


# --- views -------------------------------------------------------------------------------


@query(
    """
    WITH r AS (SELECT o_orderstatus AS x, o_custkey::VARCHAR AS series, o_totalprice AS v FROM orders)
    SELECT x, series, round(coalesce(v, 0), 2) AS value
    FROM (SELECT DISTINCT x FROM r) CROSS JOIN (SELECT DISTINCT series FROM r)
    LEFT JOIN (SELECT x, series, sum(v) AS v FROM r GROUP BY 1, 2) USING (x, series)
    """,
    2,
)
def view_many_series(t):
    """A series per customer: the whole grid, however many there are."""
    return views.series_matrix(t.orders, View("bar", "o_orderstatus", TOTAL, "sum", group="o_custkey"))


@query(
    """
    WITH r AS (SELECT o_orderstatus AS x, o_custkey::VARCHAR AS series, o_totalprice AS v FROM orders),
         top AS (SELECT series FROM (SELECT x, series, max(v) AS v FROM r GROUP BY 1, 2) GROUP BY 1 ORDER BY sum(v) DESC, 1 LIMIT 4),
         n AS (SELECT x, CASE WHEN series IN (SELECT series FROM top) THEN series ELSE '其他' END AS series, v FROM r)
    SELECT x, series, round(coalesce(v, 0), 2) AS value
    FROM (SELECT DISTINCT x FROM n) CROSS JOIN (SELECT DISTINCT series FROM n)
    LEFT JOIN (SELECT x, series, max(v) AS v FROM n GROUP BY 1, 2) USING (x, series)
    """,
    2,
)
def view_top_series(t):
    """The four greatest series, and all others as one."""
    view = View("stacked_bar", "o_orderstatus", TOTAL, "max", group="o_custkey", max_series=4)
    return views.series_matrix(t.orders, view)


VIEW_SPECS = [
    FieldSpec("o_orderkey", "number", "identifier"),
    FieldSpec("o_custkey", "string", "dimension"),
    FieldSpec(PRIORITY, "string", "status"),
    FieldSpec(TOTAL, "number", "metric", "currency"),
    FieldSpec("share", "number", "metric", "percentage"),
]
ASKED = [
    View("pie", "o_custkey", TOTAL),
    View("bar", PRIORITY, TOTAL),
    View("bar", "o_custkey", TOTAL, "max"),
    View("line", "o_custkey", PRIORITY, "count"),
    View("bar", PRIORITY, "share"),
    View("bar", PRIORITY, "o_orderkey"),
    View("bar", "nowhere", TOTAL),
    View("table", PRIORITY, views.ROWS, "count", limit=7),
]


@query(
    """
    WITH n AS (SELECT count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, count(*) AS rows FROM orders)
    SELECT 'bar' AS type, 'o_custkey' AS x, 'sum' AS how, 10 AS most, least(c, 10) AS rows, 5 AS problems FROM n
    UNION ALL SELECT 'bar', 'o_orderpriority', 'sum', NULL, p, 5 FROM n
    UNION ALL SELECT 'bar', 'o_custkey', 'max', 10, least(c, 10), 5 FROM n
    UNION ALL SELECT 'table', 'o_orderpriority', 'count', 7, least(rows, 7), 5 FROM n
    """
)
def views_adjusted(t):
    """Bad views are left out, a crowded pie is a bar, crowded bars are cut; with the rows behind each."""
    df = t.orders.withColumn("share", F.lit(0.5))
    usable, problems = views.usable_views(df, ASKED, VIEW_SPECS)
    out = None
    for v in usable:
        rows = views.view_data(df, v).agg(F.count("*").alias("rows"))
        row = rows.select(
            F.lit(v.type).alias("type"), F.lit(v.x).alias("x"), F.lit(v.aggregation).alias("how"),
            F.lit(v.limit).cast("int").alias("most"), "rows", F.lit(len(problems)).alias("problems"),
        )
        out = row if out is None else out.unionByName(row)
    return out
