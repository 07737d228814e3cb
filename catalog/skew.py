"""Exact quantiles where values and groups are uneven."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from tabwright.functions.quantiles import quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
NAMES = ["p0", "p10", "p25", "p50", "p75", "p90", "p100"]
# Two thirds of all rows are one group; prices are spread over twelve powers of ten, and a third of them are equal.
UNEVEN = """
    SELECT CASE WHEN l_linenumber > 2 THEN 'hot' ELSE l_returnflag END AS k,
           CASE l_suppkey % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN l_extendedprice
                ELSE l_extendedprice * pow(10.0, l_partkey % 12 - 6) END AS v
    FROM lineitem
"""
PERCENTILES = ", ".join(f"round(quantile_cont(v::DOUBLE, {p}), 4) AS {n}" for p, n in zip(PROBS, NAMES))


def uneven(t):
    t.lineitem.createOrReplaceTempView("_uneven_lineitem")
    return t.spark.sql(UNEVEN.replace("FROM lineitem", "FROM _uneven_lineitem"))


def as_columns(df, *keys):
    return df.select(*keys, F.col("x.n").alias("n"), *[F.col("x.q")[i].alias(n) for i, n in enumerate(NAMES)])


@query(f"WITH u AS ({UNEVEN}) SELECT k, count(v) AS n, {PERCENTILES} FROM u GROUP BY k")
def quantiles_of_a_hot_group(t):
    """Groups of very different sizes and values of very different density, by the way of large tables."""
    return as_columns(quantiles(uneven(t), ["k"], {"x": "v"}, PROBS, "narrow", accuracy=100), "k")


@query(f"WITH u AS ({UNEVEN}) SELECT count(v) AS n, {PERCENTILES} FROM u")
def quantiles_of_uneven_values(t):
    return as_columns(quantiles(uneven(t), [], {"x": "v"}, PROBS, "narrow", accuracy=100))
