"""The eleven operators, the filters, sorts and formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import QUERIES, SQL, Tables, comparable, query
from tabwright import operators as ops
from tabwright.fields import FieldSpec
from tabwright.functions.formula import with_derived
from tabwright.functions.predicates import apply_filters
from tabwright.plans.summary import summary

PRICE, QTY, FLAG, STATUS = "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"
TOTAL, DATE, PRIORITY, CUSTOMER = "o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey"


def flt(field: str, operator: str, value) -> dict:
    return {"field": field, "operator": operator, "value": value}


# --- aggregate -----------------------------------------------------------------

AGGREGATE_SQL = {
    "sum": "sum({0})", "avg": "avg({0})", "count": "count({0})", "min": "min({0})",
    "max": "max({0})", "median": "quantile_cont({0}::DOUBLE, 0.5)",
}
for _how, _sql in AGGREGATE_SQL.items():

    def _run(spark, folder, how=_how) -> DataFrame:
        t = Tables(spark, folder)
        out = ops.aggregate(t.lineitem, [FLAG, STATUS], [PRICE, QTY], how)
        return comparable(out, 2 if how == "sum" else 4)

    QUERIES[f"aggregate_{_how}"] = _run
    _digits = "" if _how == "count" else ", 2" if _how == "sum" else ", 4"
    _one = lambda c, s=_sql, d=_digits: f"round({s.format(c)}{d})"
    SQL[f"aggregate_{_how}"] = (
        f"SELECT {FLAG}, {STATUS}, {_one(PRICE)} AS {PRICE}, {_one(QTY)} AS {QTY} "
        f"FROM lineitem GROUP BY {FLAG}, {STATUS}"
    )


@query(
    """
    SELECT round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS l_extendedprice,
           round(quantile_cont(l_tax::DOUBLE, 0.5), 4) AS l_tax
    FROM lineitem
    """
)
def aggregate_median_narrowed(t):
    """The way medians are found on large tables."""
    return ops.aggregate(t.lineitem, [], [PRICE, "l_tax"], "median", quantile_method="narrow")


@query(
    """
    SELECT o_orderpriority, o_orderstatus,
           round(quantile_cont(o_totalprice::DOUBLE, 0.5), 4) AS o_totalprice
    FROM orders GROUP BY ALL
    """
)
def aggregate_median_narrowed_groups(t):
    return ops.aggregate(
        t.orders, [PRIORITY, "o_orderstatus"], [TOTAL], "median", quantile_method="narrow"
    )


@query(
    """
    SELECT o_custkey::VARCHAR AS o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
    FROM orders GROUP BY o_custkey
    """
)
def aggregate_last(t):
    return ops.aggregate(t.orders, [CUSTOMER], [TOTAL], "last", order_by=[DATE, "o_orderkey"])


@query(
    """
    SELECT round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_quantity), 2) AS l_quantity
    FROM lineitem
    """,
    2,
)
def aggregate_without_dimensions(t):
    return ops.aggregate(t.lineitem, [], [PRICE, QTY])


@query(
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice
    FROM lineitem WHERE l_quantity > 10
    GROUP BY 1, 2 ORDER BY sum(l_extendedprice) DESC, 1, 2 LIMIT 3
    """,
    2,
)
def aggregate_filter_sort_limit(t):
    return ops.aggregate(
        t.lineitem, [FLAG, STATUS], [PRICE], "sum", [flt(QTY, "gt", 10)],
        {"field": PRICE, "direction": "desc"}, 3,
    )


@query("SELECT l_returnflag, l_extendedprice FROM (SELECT '' AS l_returnflag, 0.0::DOUBLE AS l_extendedprice) WHERE false")
def aggregate_of_nothing(t):
    return ops.aggregate(t.lineitem, [FLAG], [PRICE], "sum", [flt(QTY, "lt", 0)])


def orders_with_missing(t: Tables) -> DataFrame:
    """Orders where one priority is NULL and another is an empty text."""
    p = F.col(PRIORITY)
    return t.orders.withColumns(
        {
            PRIORITY: F.when(p == "5-LOW", F.lit(None)).when(p == "1-URGENT", "").otherwise(p),
            TOTAL: F.when(F.col("o_orderkey") % 5 != 0, F.col(TOTAL)),
        }
    )


MISSING_SQL = """
    WITH o AS (
        SELECT * REPLACE (
            CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN ''
                 ELSE o_orderpriority END AS o_orderpriority,
            CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice)
        FROM orders)
"""


@query(
    MISSING_SQL
    + """
    SELECT coalesce(o_orderpriority, '') AS o_orderpriority,
           round(coalesce(sum(o_totalprice), 0), 2) AS o_totalprice
    FROM o GROUP BY 1
    """,
    2,
)
def aggregate_missing_keys(t):
    """NULL and the empty text are one group."""
    return ops.aggregate(orders_with_missing(t), [PRIORITY], [TOTAL])


# --- filters -------------------------------------------------------------------

FILTERS = {
    "eq": (flt(PRIORITY, "eq", "2-HIGH"), "o_orderpriority = '2-HIGH'"),
    "eq_missing": (flt(PRIORITY, "eq", ""), "coalesce(o_orderpriority, '') = ''"),
    "neq": (flt(PRIORITY, "neq", "2-HIGH"), "coalesce(o_orderpriority, '') <> '2-HIGH'"),
    "in": (
        flt(PRIORITY, "in", ["2-HIGH", "3-MEDIUM"]),
        "coalesce(o_orderpriority, '') IN ('2-HIGH', '3-MEDIUM')",
    ),
    "not_in": (
        flt(PRIORITY, "not_in", ["2-HIGH", "3-MEDIUM"]),
        "coalesce(o_orderpriority, '') NOT IN ('2-HIGH', '3-MEDIUM')",
    ),
    "gt": (flt(TOTAL, "gt", 250000), "o_totalprice > 250000"),
    "gte": (flt("o_orderkey", "gte", 100), "o_orderkey >= 100"),
    "lt": (flt(TOTAL, "lt", "1e5"), "o_totalprice < 100000"),
    "lte": (flt("o_orderkey", "lte", 99.5), "o_orderkey <= 99.5"),
    "between": (flt(TOTAL, "between", [1000, 200000]), "o_totalprice BETWEEN 1000 AND 200000"),
    "contains": (flt(PRIORITY, "contains", "MED"), "contains(coalesce(o_orderpriority, ''), 'MED')"),
    "date": (flt(DATE, "between", ["1996-03-01", "1997-02-28"]), "o_orderdate >= '1996-03-01' AND o_orderdate < '1997-03-01'"),
    "number_text": (flt("o_orderkey", "eq", "42"), "o_orderkey = 42"),
}
for _name, (_flt, _where) in FILTERS.items():

    def _run(spark, folder, f=_flt) -> DataFrame:
        kept = apply_filters(orders_with_missing(Tables(spark, folder)), [f])
        return comparable(kept.select("o_orderkey", PRIORITY, TOTAL), 2)

    QUERIES[f"filter_{_name}"] = _run
    SQL[f"filter_{_name}"] = (
        MISSING_SQL + f"SELECT o_orderkey, o_orderpriority, o_totalprice FROM o WHERE {_where}"
    )


@query(
    MISSING_SQL
    + """
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM o
    WHERE coalesce(o_orderpriority, '') <> '2-HIGH' AND o_totalprice > 100000
      AND o_orderstatus IN ('F', 'O')
    """
)
def filter_conjunction(t):
    kept = apply_filters(
        orders_with_missing(t),
        [flt(PRIORITY, "neq", "2-HIGH"), flt(TOTAL, "gt", 1e5), flt("o_orderstatus", "in", ["F", "O"])],
    )
    return kept.select("o_orderkey", PRIORITY, TOTAL)


# --- time ----------------------------------------------------------------------

BUCKET_SQL = {
    "day": "strftime({0}, '%Y-%m-%d')",
    "week": "strftime({0}, '%G-W%V')",
    "month": "strftime({0}, '%Y-%m')",
    "quarter": "year({0})::VARCHAR || '-Q' || quarter({0})::VARCHAR",
    "year": "year({0})::VARCHAR",
}
for _grain, _bucket in BUCKET_SQL.items():

    def _run(spark, folder, grain=_grain) -> DataFrame:
        return comparable(ops.timeseries(Tables(spark, folder).orders, DATE, [TOTAL], grain), 2)

    QUERIES[f"timeseries_{_grain}"] = _run
    SQL[f"timeseries_{_grain}"] = (
        f"SELECT {_bucket.format(DATE)} AS {DATE}, round(sum({TOTAL}), 2) AS {TOTAL} "
        "FROM orders GROUP BY 1"
    )


@query(
    """
    SELECT strftime(ts, '%Y-%m-%d') AS ts, round(sum(value), 2) AS value,
           arg_max(user_id, event_id)::DOUBLE AS user_id, round(avg(event_id), 4) AS event_id
    FROM events GROUP BY 1
    """
)
def timeseries_by_behavior(t):
    """A flow adds up, a stock keeps its last value, a score averages."""
    specs = [
        FieldSpec("value", "number", "metric", behavior="flow"),
        FieldSpec("user_id", "number", "metric", behavior="stock"),
        FieldSpec("event_id", "number", "metric", behavior="score"),
    ]
    names = [s.name for s in specs]
    return ops.timeseries(t.events, "ts", names, "day", specs=specs, order_by=["event_id"])


@query(
    """
    WITH b AS (SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate, sum(o_totalprice) AS v
               FROM orders GROUP BY 1),
         c AS (SELECT *, lag(v) OVER (ORDER BY o_orderdate) AS p FROM b)
    SELECT o_orderdate, round(v, 2) AS o_totalprice, round(v - p, 2) AS "change",
           round(CASE WHEN p <> 0 THEN (v - p) / abs(p) END, 2) AS "growthRate"
    FROM c
    """,
    2,
)
def growth_rate(t):
    return ops.growth(t.orders, DATE, TOTAL, "month")


@query(
    """
    WITH b AS (SELECT year(o_orderdate)::VARCHAR AS o_orderdate, avg(o_totalprice) AS v
               FROM orders GROUP BY 1)
    SELECT o_orderdate, round(v, 4) AS o_totalprice,
           round(v - lag(v) OVER (ORDER BY o_orderdate), 4) AS "change",
           NULL::DOUBLE AS "growthRate"
    FROM b
    """
)
def growth_difference(t):
    return ops.growth(t.orders, DATE, TOTAL, "year", "avg", "difference")


# --- compare, ranking, distribution ---------------------------------------------


@query(
    """
    SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice,
           round(sum(l_quantity), 2) AS l_quantity,
           round(sum(l_extendedprice) / sum(l_quantity), 2) AS "l_extendedprice_比_l_quantity"
    FROM lineitem GROUP BY 1
    """,
    2,
)
def compare_rate(t):
    return ops.compare(t.lineitem, [FLAG], [PRICE, QTY], mode="rate")


@query(
    """
    SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity,
           round(avg(l_linenumber), 4) AS l_linenumber,
           round(avg(l_quantity) - avg(l_linenumber), 4) AS "l_quantity_减_l_linenumber"
    FROM lineitem GROUP BY 1, 2
    """
)
def compare_difference(t):
    return ops.compare(t.lineitem, [FLAG, STATUS], [QTY, "l_linenumber"], "avg", "difference")


@query(
    """
    SELECT row_number() OVER (ORDER BY v DESC, k)::BIGINT AS rank, k AS o_custkey, round(v, 2) AS o_totalprice
    FROM (SELECT o_custkey::VARCHAR AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    ORDER BY v DESC, k LIMIT 10
    """,
    2,
)
def ranking_top(t):
    return ops.ranking(t.orders, [CUSTOMER], [TOTAL], "sum", {"field": TOTAL, "direction": "desc"})


@query(
    """
    SELECT row_number() OVER (ORDER BY v, k)::BIGINT AS rank, k AS o_custkey, v AS o_totalprice
    FROM (SELECT o_custkey::VARCHAR AS k, count(o_totalprice) AS v FROM orders GROUP BY 1)
    ORDER BY v, k LIMIT 25
    """
)
def ranking_bottom(t):
    sort = {"field": TOTAL, "direction": "asc"}
    return ops.ranking(t.orders, [CUSTOMER], [TOTAL], "count", sort, 25)


@query(
    """
    SELECT p_brand, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 4) AS rate
    FROM part GROUP BY p_brand
    """
)
def distribution_category(t):
    return ops.distribution(t.part, "p_brand")


@query(
    """
    SELECT o_custkey::VARCHAR AS o_custkey, count(*) AS count,
           round(count(*) / sum(count(*)) OVER (), 6) AS rate
    FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, 1 LIMIT 100
    """,
    6,
)
def distribution_many_classes(t):
    """Customers as text classes: only the hundred most frequent are listed."""
    return ops.distribution(t.orders.withColumn(CUSTOMER, F.col(CUSTOMER).cast("string")), CUSTOMER)


BINS_SQL = """
    WITH s AS (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi, count({x}) AS n FROM {table}),
         w AS (SELECT *, (hi - lo) / {bins} AS width FROM s),
         c AS (SELECT least(floor(({x} - lo) / width), {bins} - 1)::INT AS b, count(*) AS c
               FROM {table}, w WHERE {x} IS NOT NULL GROUP BY 1)
    SELECT round(lo + i * width, 4) AS lower, round(lo + (i + 1) * width, 4) AS upper,
           coalesce(c, 0)::BIGINT AS count, round(coalesce(c, 0) / n, 4) AS rate
    FROM range({bins}) r(i) LEFT JOIN c ON c.b = r.i, w
"""


@query(BINS_SQL.format(x="value", table="events", bins=10))
def distribution_bins(t):
    return ops.distribution(t.events, "value").drop("value")


@query(BINS_SQL.format(x="n_chars", table="documents", bins=20))
def distribution_many_bins(t):
    return ops.distribution(t.documents, "n_chars", limit=50).drop("n_chars")


@query("SELECT '7' AS x, 7.0::DOUBLE AS lower, 7.0::DOUBLE AS upper, count(*) AS count, 1.0::DOUBLE AS rate FROM part")
def distribution_constant(t):
    return ops.distribution(t.part.select(F.when(F.col("p_partkey") >= 0, 7).alias("x")), "x")


# --- ratio and formulas ----------------------------------------------------------

NET = {
    "op": "multiply",
    "left": {"op": "field", "field": PRICE},
    "right": {
        "op": "subtract",
        "left": {"op": "const", "value": 1},
        "right": {"op": "field", "field": "l_discount"},
    },
}
UNIT = {"op": "divide", "left": NET, "right": {"op": "field", "field": QTY}}
BY_DISCOUNT = {
    "op": "divide",
    "left": {"op": "field", "field": QTY},
    "right": {"op": "field", "field": "l_discount"},
}


@query(
    """
    SELECT l_returnflag, round(avg(l_extendedprice * (1 - l_discount) / l_quantity), 4) AS unit_price
    FROM lineitem GROUP BY 1
    """
)
def ratio_grouped(t):
    return ops.ratio(t.lineitem, UNIT, "unit_price", [FLAG])


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           round(l_quantity / nullif(l_discount, 0), 4) AS per_discount
    FROM lineitem WHERE l_discount <> 0
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 100
    """
)
def ratio_rows(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", QTY]
    rows = ops.ratio(t.lineitem, BY_DISCOUNT, "per_discount", order_by=order)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "per_discount")


@query(
    """
    SELECT round(avg(v), 4) AS scalar, sum(n)::BIGINT AS null_count
    FROM (SELECT avg(l_quantity / nullif(l_discount, 0)) AS v, count_if(l_discount = 0) AS n
          FROM lineitem GROUP BY l_returnflag)
    """
)
def ratio_scalar(t):
    return ops.ratio_scalar(t.lineitem, BY_DISCOUNT, "per_discount", [FLAG])


@query(
    """
    SELECT l_orderkey, l_linenumber,
           round(l_extendedprice + l_tax, 4) AS added,
           round(abs(l_discount - l_quantity), 4) AS apart,
           CASE WHEN l_discount = 0 THEN 0 ELSE round(l_quantity / l_discount, 4) END AS zeroed,
           round(l_quantity / nullif(l_discount, 0), 4) AS nulled,
           floor((l_linenumber - 4) * 0.5 + 0.5) AS halves_up
    FROM lineitem
    """
)
def formula_nodes(t):
    def field(name):
        return {"op": "field", "field": name}

    quantity, discount = field(QTY), field("l_discount")
    safe = {"op": "safe_divide", "numerator": quantity, "denominator": discount}
    nodes = {
        "added": {"op": "add", "left": field(PRICE), "right": field("l_tax")},
        "apart": {"op": "abs", "value": {"op": "subtract", "left": discount, "right": quantity}},
        "zeroed": {**safe, "whenZero": "zero"},
        "nulled": {**safe, "whenZero": "null"},
        "halves_up": {
            "op": "round",
            "value": {
                "op": "multiply",
                "left": {"op": "subtract", "left": field("l_linenumber"), "right": {"op": "const", "value": 4}},
                "right": {"op": "const", "value": 0.5},
            },
        },
    }
    df = t.lineitem
    for name, node in nodes.items():
        df = with_derived(df, name, node)
    return df.select("l_orderkey", "l_linenumber", *nodes)


# --- correlation, anomaly, pivot, profile ------------------------------------------


@query(
    """
    SELECT 'l_extendedprice' AS metric1, 'l_quantity' AS metric2,
           round(corr(l_extendedprice, l_quantity), 6) AS pearson, count(*) AS "sampleSize"
    FROM lineitem
    """,
    6,
)
def correlation(t):
    return ops.correlation(t.lineitem, PRICE, QTY)


@query(
    """
    SELECT 'o_totalprice' AS metric1, 'fixed' AS metric2, NULL::DOUBLE AS pearson,
           count(*) AS "sampleSize"
    FROM orders
    """
)
def correlation_constant(t):
    fixed = F.when(F.col("o_orderkey") >= 0, 3.0)
    return ops.correlation(t.orders.withColumn("fixed", fixed), TOTAL, "fixed")


IQR_SQL = """
    WITH q AS (SELECT quantile_cont({x}::DOUBLE, 0.25) AS q1, quantile_cont({x}::DOUBLE, 0.75) AS q3 FROM {table}),
         b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT {columns}, {x}, CASE WHEN {x} < lo THEN 'lower' ELSE 'upper' END AS _direction
    FROM {table}, b WHERE {x} < lo OR {x} > hi
"""


@query(IQR_SQL.format(x="value", table="events", columns="event_id, user_id"))
def anomaly_iqr(t):
    return ops.anomaly(t.events, "value", limit=None).select(
        "event_id", "user_id", "value", "_direction"
    )


@query(IQR_SQL.format(x="value", table="events", columns="event_id, user_id") + " ORDER BY event_id LIMIT 50")
def anomaly_iqr_first(t):
    return ops.anomaly(t.events, "value", order_by=["event_id"]).select(
        "event_id", "user_id", "value", "_direction"
    )


@query(
    """
    WITH s AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS d FROM documents)
    SELECT doc_id, n_chars::DOUBLE AS n_chars, CASE WHEN n_chars < m THEN 'lower' ELSE 'upper' END AS _direction
    FROM documents, s WHERE abs(n_chars - m) / d > 3
    """
)
def anomaly_zscore(t):
    found = ops.anomaly(t.documents, "n_chars", "zscore", limit=None)
    return found.select("doc_id", "n_chars", "_direction")


@query(
    """
    WITH q AS (SELECT quantile_cont(value::DOUBLE, 0.25) AS q1, quantile_cont(value::DOUBLE, 0.75) AS q3 FROM events)
    SELECT round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper FROM q
    """
)
def anomaly_bounds(t):
    return ops.anomaly_bounds(t.events, "value")


def orders_by_year(t: Tables) -> DataFrame:
    return t.orders.withColumn("year", F.year(DATE).cast("string"))


_YEARS = range(1995, 2002)


@query(
    "SELECT o_orderpriority, "
    + ", ".join(
        f"round(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 2) AS \"o_totalprice[{y}]\""
        for y in _YEARS
    )
    + " FROM orders GROUP BY 1",
    2,
)
def pivot(t):
    return ops.pivot(orders_by_year(t), [PRIORITY, "year"], [TOTAL])


@query(
    "SELECT l_returnflag, l_linenumber::VARCHAR AS l_linenumber, "
    + ", ".join(
        f"round(max(l_quantity) FILTER (l_linestatus = '{s}'), 2) AS \"l_quantity[{s}]\", "
        f"round(max(l_tax) FILTER (l_linestatus = '{s}'), 2) AS \"l_tax[{s}]\""
        for s in "FO"
    )
    + " FROM lineitem GROUP BY 1, 2",
    2,
)
def pivot_two_row_dimensions(t):
    dims = [FLAG, "l_linenumber", STATUS]
    return ops.pivot(t.lineitem, dims, [QTY, "l_tax"], "max", values=["F", "O"])


PROFILE_NUMBER = """
    SELECT '{f}' AS field, 'number' AS type, count({f}) AS count, count(DISTINCT {f}) AS "distinctCount",
           round((count(*) - count({f})) / count(*), 4) AS "nullRate", round(min({f}), 4)::DOUBLE AS min,
           round(max({f}), 4)::DOUBLE AS max, round(avg({f}), 4) AS mean,
           round(quantile_cont({f}::DOUBLE, 0.5), 4) AS median FROM {table}
"""
PROFILE_OTHER = """
    SELECT '{f}' AS field, '{type}' AS type, count({f}) AS count, count(DISTINCT {f}) AS "distinctCount",
           round((count(*) - count({f})) / count(*), 4) AS "nullRate", NULL::DOUBLE AS min,
           NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median FROM {table}
"""


@query(
    " UNION ALL ".join(
        [PROFILE_NUMBER.format(f=f, table="part") for f in ("p_partkey", "p_size", "p_retailprice")]
        + [PROFILE_OTHER.format(f=f, type="string", table="part") for f in ("p_name", "p_brand", "p_type")]
    )
)
def profile(t):
    return ops.profile(t.part)


@query(
    MISSING_SQL
    + " UNION ALL ".join(
        [
            PROFILE_NUMBER.format(f="o_totalprice", table="o"),
            PROFILE_OTHER.format(
                f="o_orderpriority", type="string",
                table="(SELECT * REPLACE (nullif(o_orderpriority, '') AS o_orderpriority) FROM o)",
            ),
            PROFILE_OTHER.format(f="o_orderdate", type="date", table="o"),
        ]
    )
)
def profile_with_missing(t):
    return ops.profile(orders_with_missing(t), [TOTAL, PRIORITY, DATE])


# --- decimals, large fractions, open end dates ------------------------------------

QUANTITY = "CASE WHEN l_quantity < 50 THEN CAST(l_quantity AS DECIMAL(12, 2)) END"


def _decimals(t) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", f"{QUANTITY} AS quantity")


for _name, _operator, _value, _where in (
    ("eq", "eq", 17, "quantity = 17"),
    ("neq", "neq", "17", "quantity IS DISTINCT FROM 17"),
    ("in", "in", [3, "24", 17.0, "5.00"], "quantity IN (3, 24, 17)"),
    ("not_in", "not_in", [3, "", 24.0], "quantity NOT IN (3, 24)"),
    ("between", "between", [16.995, "20.0"], "quantity BETWEEN 17 AND 20"),
):

    def _run_filter(spark, folder, operator=_operator, value=_value) -> DataFrame:
        return apply_filters(_decimals(Tables(spark, folder)), [flt("quantity", operator, value)])

    QUERIES[f"filter_{_name}_decimal"] = _run_filter
    SQL[f"filter_{_name}_decimal"] = (
        f"SELECT * FROM (SELECT l_orderkey, l_linenumber, {QUANTITY} AS quantity FROM lineitem) WHERE {_where}"
    )


@query(
    """
    SELECT (9007199254740993 + l_linenumber)::VARCHAR AS key, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1
    """
)
def aggregate_decimal_keys(t):
    """Keys that differ only beyond the precision of a double."""
    keyed = t.lineitem.selectExpr(
        "CAST(9007199254740993 + l_linenumber AS DECIMAL(20, 0)) AS key", "l_quantity AS quantity"
    )
    return ops.aggregate(keyed, ["key"], ["quantity"], "sum")


@query(
    """
    SELECT (12345678.5::DOUBLE + l_linenumber)::VARCHAR AS key, count(l_quantity) AS quantity
    FROM lineitem WHERE contains((12345678.5::DOUBLE + l_linenumber)::VARCHAR, '680.5') GROUP BY 1
    """
)
def group_by_large_fractions(t):
    keyed = t.lineitem.selectExpr("12345678.5D + l_linenumber AS key", "l_quantity AS quantity")
    return ops.aggregate(keyed, ["key"], ["quantity"], "count", [flt("key", "contains", "680.5")])


OPEN_END = "CASE WHEN o_orderstatus = 'O' THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) END"


@query(
    f"""
    SELECT CAST(d AS VARCHAR) AS "until", count(*) AS n FROM (SELECT {OPEN_END} AS d FROM orders)
    WHERE d >= '1995-03-01' AND d <= '9999-12-31' GROUP BY 1
    """
)
def filter_open_end_date(t):
    df = t.orders.selectExpr(f"{OPEN_END} AS until")
    kept = apply_filters(df, [flt("until", "between", ["1995-03-01", "9999-12-31"]), flt("until", "lte", "9999-12-31")])
    return kept.groupBy("until").agg(F.count("*").alias("n"))


# --- what results leave out --------------------------------------------------------


def _summary(task: dict, sql: str, table: str = "orders"):
    def run(spark, folder) -> DataFrame:
        df = getattr(Tables(spark, folder), table)
        out = summary(df, task)
        return comparable(out.withColumn("warnings", F.array_join("warnings", ",")), 4)

    QUERIES[f"summary_{task['operator']}"] = run
    SQL[f"summary_{task['operator']}"] = f"""
        SELECT "rowCount"::BIGINT AS "rowCount", "fullCount"::BIGINT AS "fullCount", "nullCount"::BIGINT AS "nullCount",
               "rowCount" < "fullCount" AS truncated, warnings
        FROM ({sql})
    """


_summary(
    {"operator": "aggregate", "dimensions": [CUSTOMER], "metrics": [TOTAL], "aggregation": "sum", "limit": 5},
    """SELECT 5 AS "rowCount", count(DISTINCT o_custkey) AS "fullCount", 0 AS "nullCount", 'CUT' AS warnings FROM orders""",
)
_summary(
    {"operator": "ranking", "dimensions": [PRIORITY], "metrics": [TOTAL], "aggregation": "sum",
     "sort": {"field": TOTAL, "direction": "desc"}},
    """SELECT n AS "rowCount", n AS "fullCount", 0 AS "nullCount", '' AS warnings
       FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders)""",
)
_summary(
    {"operator": "distribution", "dimensions": ["source"], "limit": 5},
    """SELECT least(n, 5) AS "rowCount", n AS "fullCount", absent AS "nullCount",
              concat_ws(',', CASE WHEN n > 8 THEN 'MANY_CLASSES' END, CASE WHEN n > 5 THEN 'CUT' END) AS warnings
       FROM (SELECT count(DISTINCT source) AS n, count_if(source IS NULL) AS absent FROM documents)""",
    "documents",
)
_summary(
    {"operator": "anomaly", "metrics": ["value"], "limit": 3},
    """SELECT least(n, 3) AS "rowCount", n AS "fullCount", 0 AS "nullCount",
              CASE WHEN n = 0 THEN 'NO_OUTLIER' WHEN n > 3 THEN 'CUT' ELSE '' END AS warnings
       FROM (WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
             SELECT count_if(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS n FROM events, q)""",
    "events",
)
_summary(
    {"operator": "pivot", "dimensions": [PRIORITY, "o_orderstatus"], "metrics": [TOTAL], "aggregation": "sum"},
    """SELECT n AS "rowCount", n AS "fullCount", 0 AS "nullCount", CASE WHEN c > 20 THEN 'MANY_COLUMNS' ELSE '' END AS warnings
       FROM (SELECT count(DISTINCT o_orderpriority) AS n, count(DISTINCT o_orderstatus) AS c FROM orders)""",
)
_summary(
    {"operator": "correlation", "metrics": ["value", "user_id"]},
    """SELECT 1 AS "rowCount", 1 AS "fullCount", 0 AS "nullCount",
              CASE WHEN count(*) < 8 THEN 'FEW_PAIRS' WHEN corr(value, user_id) IS NULL THEN 'CONSTANT' ELSE '' END AS warnings
       FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL""",
    "events",
)
_summary(
    {"operator": "growth", "metrics": [TOTAL], "time": {"field": DATE, "grain": "month"}, "aggregation": "sum"},
    """SELECT n AS "rowCount", n AS "fullCount", zero AS "nullCount", CASE WHEN zero > 0 THEN 'ZERO_BASE' ELSE '' END AS warnings
       FROM (SELECT count(*) AS n, count_if(before = 0) AS zero FROM (
             SELECT lag(v) OVER (ORDER BY m) AS before FROM (
             SELECT strftime(o_orderdate, '%Y-%m') AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1)))""",
)
_summary(
    {"operator": "ratio", "formula": {"outputField": "r", "expression": {
        "op": "safe_divide", "numerator": {"op": "field", "field": "l_tax"}, "denominator": {"op": "field", "field": "l_discount"}}}},
    """SELECT least(n, 100) AS "rowCount", n AS "fullCount", z AS "nullCount",
              concat_ws(',', CASE WHEN z > 0 THEN 'NO_VALUE' END, CASE WHEN n > 100 THEN 'CUT' END) AS warnings
       FROM (SELECT count_if(l_discount <> 0) AS n, count_if(l_discount = 0) AS z FROM lineitem)""",
    "lineitem",
)
