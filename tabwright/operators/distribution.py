from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import col, double_text_sql, group_key, kind, missing_sql, number_sql, quoted
from tabwright.functions.predicates import apply_filters
from tabwright.operators.checks import check_columns, check_limit

MAX_BINS = 20
DEFAULT_BINS = 10
MAX_CLASSES = 100


def distribution(
    df: DataFrame,
    dimension: str,
    filters: Sequence[Mapping[str, Any]] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """How the values of one field are spread.

    A number field gives equal-width bins, also the empty ones; any other field
    gives its most frequent values. ``rate`` is the share of non-missing rows.
    """
    check_columns(df, [dimension], what="distribution", mets=(0, 0))
    check_limit(limit)
    kept = apply_filters(df, filters)
    if kind(kept, dimension) == "number":
        return _bins(kept, dimension, min(limit or DEFAULT_BINS, MAX_BINS))
    return _classes(kept, dimension, min(limit or MAX_CLASSES, MAX_CLASSES))


def _classes(df: DataFrame, dimension: str, limit: int) -> DataFrame:
    key = group_key(df, dimension)
    counts = (
        df.filter(f"NOT {missing_sql(df, dimension)}")
        .groupBy(F.expr(key.group).alias("_key"))
        .agg(F.expr("count(*) AS count"))
    )
    total = counts.agg(F.sum("count")).scalar()
    return (
        counts.selectExpr(f"{key.text('_key')} AS {quoted(dimension)}", "count")
        .withColumn("rate", col("count") / total)
        .orderBy(col("count").desc(), col(dimension).asc())
        .limit(limit)
    )


def _bins(df: DataFrame, field: str, requested: int) -> DataFrame:
    values = df.selectExpr(f"{number_sql(df, field)} AS x").filter("x IS NOT NULL")
    bins = f"CASE WHEN min(x) = max(x) THEN 1 ELSE least({requested}, int(count(x))) END"
    # The shape is one row, looked at first; the rows are then only counted.
    shape = values.agg(
        F.expr(f"struct(min(x) AS low, max(x) AS high, count(x) AS n, {bins} AS bins)").alias("s")
    )
    placed = values.withColumn("s", shape.scalar()).selectExpr(
        "s",
        "CASE WHEN s.bins <= 1 THEN 0 ELSE "
        "int(least(floor((x - s.low) / ((s.high - s.low) / s.bins)), s.bins - 1)) END AS bin",
    )
    counts = placed.groupBy("bin").agg(F.expr("count(*) AS count"))
    slots = df.sparkSession.range(requested).selectExpr("int(id) AS bin")
    slots = slots.withColumn("s", shape.scalar()).filter("bin < s.bins")
    # At most MAX_BINS rows on either side, so broadcasting is bounded.
    filled = slots.join(F.broadcast(counts), "bin", "left").selectExpr(
        "s",
        "bin = s.bins - 1 AS closed",
        "CASE WHEN s.bins = 1 THEN s.low ELSE s.low + bin * ((s.high - s.low) / s.bins) END AS lower",
        "CASE WHEN s.bins = 1 THEN s.high ELSE s.low + (bin + 1) * ((s.high - s.low) / s.bins) END AS upper",
        "coalesce(count, 0L) AS count",
    )
    span = (
        "concat(format_string('%.6g', lower), CASE WHEN closed THEN ' ≤ x ≤ ' ELSE ' ≤ x < ' END, "
        "format_string('%.6g', upper))"
    )
    return filled.selectExpr(
        f"CASE WHEN s.bins = 1 THEN {double_text_sql('s.low')} ELSE {span} END AS {quoted(field)}",
        "lower",
        "upper",
        "count",
        "try_divide(double(count), s.n) AS rate",
    ).orderBy("lower")
