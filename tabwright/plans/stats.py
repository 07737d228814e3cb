"""Whole-table statistics: numbers, categories, outliers. One scan for all fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import (
    inline_sql, key_sql, missing_sql, number_sql, quoted, require, struct_sql, text_sql,
)
from tabwright.functions.aggregates import or_zero
from tabwright.functions.quantiles import quantiles
from tabwright.operators.anomaly import FENCE, MIN_SAMPLES
from tabwright.plans.infer import grouped
from tabwright.scale import pin

TOP_N = 10
LOW_CARDINALITY = 30
LONG_TAIL_HEAD = 3
OUTLIER_SAMPLES = 5
QUARTILES = [0.25, 0.5, 0.75]


def numeric_stats(
    df: DataFrame, metrics: Sequence[str], quantile_method: str = "auto"
) -> DataFrame:
    """Thirteen statistics per metric, all 0 when there is no number."""
    require(df, metrics)
    base = df.selectExpr(*[f"{number_sql(df, m)} AS x{i}" for i, m in enumerate(metrics)])
    aggs = ["count(*) AS rows"] + [
        struct_sql(
            sum=f"sum(x{i})",
            avg=f"avg(x{i})",
            min=f"min(x{i})",
            max=f"max(x{i})",
            std=f"stddev_samp(x{i})",
            zeros=f"count_if(x{i} = 0)",
            negatives=f"count_if(x{i} < 0)",
        )
        + f" AS s{i}"
        for i in range(len(metrics))
    ]
    inputs = {f"q{i}": f"x{i}" for i in range(len(metrics))}
    wide = quantiles(base, [], inputs, QUARTILES, quantile_method, aggs)
    rows = [
        struct_sql(
            field=text_sql(m),
            count=f"q{i}.n",
            nullCount=f"rows - q{i}.n",
            nullRate=or_zero(f"try_divide(rows - q{i}.n, rows)"),
            **{k: or_zero(f"s{i}.{k}") for k in ("sum", "avg", "min", "max")},
            median=or_zero(f"q{i}.q[1]"),
            p25=or_zero(f"q{i}.q[0]"),
            p75=or_zero(f"q{i}.q[2]"),
            std=or_zero(f"s{i}.std"),
            zeroCount=f"s{i}.zeros",
            negativeCount=f"s{i}.negatives",
        )
        for i, m in enumerate(metrics)
    ]
    return wide.selectExpr(inline_sql(rows))


def missingness(stats: DataFrame, over: float = 0.3) -> DataFrame:
    """Fields whose share of missing cells is too high, from the statistics."""
    return stats.filter(f"nullRate > {over}").select("field", "nullCount", "nullRate")


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, value, count`` for every distinct value; ``""`` is missing.

    The shuffle key includes the value and equal values are added up before it,
    so neither a long column nor a hot value gathers in one task.
    """
    require(df, fields)
    cells = [struct_sql(field=text_sql(f), value=key_sql(df, f)) for f in fields]
    return grouped(df.selectExpr(inline_sql(cells)), ["field", "value"], ["count(*) AS count"])


def _ranked(counts: DataFrame, direction: str, keep: int) -> DataFrame:
    """The first values per field. Spark drops the rest before the shuffle.

    A missing value is ranked last and removed afterwards: removed earlier, the
    filter would sink into the scan and the counts could not be shared.
    """
    place = f"row_number() OVER (PARTITION BY field ORDER BY value = '', count {direction}, value)"
    return counts.withColumn("rank", F.expr(place)).filter(f"rank <= {keep} AND value <> ''")


def category_totals(counts: DataFrame) -> DataFrame:
    """One row per field: distinct values, missing cells and all cells."""
    return grouped(
        counts,
        ["field"],
        [
            "count_if(value <> '') AS distinctCount",
            "coalesce(sum(CASE WHEN value = '' THEN count END), 0L) AS nullCount",
            "sum(count) AS total",
        ],
    )


def category_stats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per field with its counts, long-tail share and cardinality flag."""
    counts = value_counts(df, fields)
    head = grouped(_ranked(counts, "DESC", LONG_TAIL_HEAD), ["field"], ["sum(count) AS head"])
    tail = "try_divide(total - nullCount - coalesce(head, 0L), total - nullCount)"
    # Both sides have one row per field.
    return (
        category_totals(counts)
        .join(F.broadcast(head), "field", "left")
        .selectExpr(
            "field",
            "distinctCount",
            "nullCount",
            "total",
            f"coalesce({tail}, 1D) AS longTailRate",
            f"distinctCount <= {LOW_CARDINALITY} AS lowCardinality",
        )
    )


def category_values(
    df: DataFrame, fields: Sequence[str], top: int = TOP_N, bottom: int = TOP_N
) -> DataFrame:
    """The most and least frequent values of each field, with their share.

    The bottom list is given only where there are more values than the top holds.
    """
    counts = value_counts(df, fields)
    totals = F.broadcast(category_totals(counts))
    listed = _ranked(counts, "DESC", top).selectExpr("*", "'top' AS side")
    if bottom:
        last = _ranked(counts, "ASC", bottom).selectExpr("*", "'bottom' AS side")
        listed = listed.unionByName(last)
    return (
        listed.join(totals, "field")
        .filter(f"side = 'top' OR distinctCount > {top}")
        .selectExpr(
            "field", "side", "rank", "value", "count",
            "try_divide(double(count), total - nullCount) AS rate",
        )
    )


def bounds_of(stats: DataFrame) -> DataFrame:
    """Fences from the quartiles of the statistics; 0 below eight values."""
    quartile = "CASE WHEN count >= {n} THEN {q} ELSE 0D END AS {name}"
    return stats.selectExpr(
        "field",
        f"count >= {MIN_SAMPLES} AS detected",
        "count AS sampleSize",
        quartile.format(n=MIN_SAMPLES, q="p25", name="q1"),
        quartile.format(n=MIN_SAMPLES, q="p75", name="q3"),
    ).selectExpr(
        "*",
        "q3 - q1 AS iqr",
        f"q1 - (q3 - q1) * {FENCE}D AS lowerBound",
        f"q3 + (q3 - q1) * {FENCE}D AS upperBound",
    )


def outlier_bounds(
    df: DataFrame, metrics: Sequence[str], quantile_method: str = "auto"
) -> DataFrame:
    """One row per metric: quartiles and fences."""
    return bounds_of(numeric_stats(df, metrics, quantile_method))


def _outside(
    df: DataFrame, metrics: Sequence[str], bounds: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """Values outside the fences in long form, tested against one row per metric."""
    cells = [struct_sql(field=text_sql(m), value=number_sql(df, m)) for m in metrics]
    direction = (
        "CASE WHEN value < lowerBound THEN 'lower' WHEN value > upperBound THEN 'upper' END"
    )
    return (
        df.selectExpr(*keep, inline_sql(cells))
        .join(F.broadcast(bounds.filter("detected")), "field")
        .selectExpr("*", f"{direction} AS direction")
        .filter("direction IS NOT NULL")
    )


def outliers(
    df: DataFrame, metrics: Sequence[str], quantile_method: str = "auto"
) -> DataFrame:
    """Bounds per metric and how many values lie strictly outside them."""
    return outliers_beyond(df, metrics, pin(outlier_bounds(df, metrics, quantile_method)))


def outliers_beyond(df: DataFrame, metrics: Sequence[str], bounds: DataFrame) -> DataFrame:
    """The same for bounds that are known already."""
    found = grouped(_outside(df, metrics, bounds), ["field"], ["count(*) AS outlierCount"])
    return bounds.join(F.broadcast(found), "field", "left").na.fill(0, ["outlierCount"])


def outlier_samples(
    df: DataFrame,
    metrics: Sequence[str],
    order_by: Sequence[str],
    k: int = OUTLIER_SAMPLES,
    quantile_method: str = "auto",
) -> DataFrame:
    """The first ``k`` outliers of each metric in row order."""
    require(df, order_by)
    order = [f"_at_{i}" for i in range(len(order_by))]
    keep = [f"{quoted(c)} AS {o}" for c, o in zip(order_by, order)]
    found = _outside(df, metrics, pin(outlier_bounds(df, metrics, quantile_method)), keep)
    place = f"row_number() OVER (PARTITION BY field ORDER BY {', '.join(order)})"
    return (
        found.withColumn("rank", F.expr(place))
        .filter(f"rank <= {k}")
        .selectExpr(
            "field", "rank", "value", "direction",
            *[f"{o} AS {quoted(c)}" for o, c in zip(order, order_by)],
        )
    )


def date_stats(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """One row per date field: first and last day, and how many different days.

    ``fields`` maps a name to the SQL text of its date.
    """
    parts = {"min": "min({0})", "max": "max({0})", "distinctDays": "count(DISTINCT {0})"}
    wide = df.agg(
        *[
            F.expr(f"{sql.format(f'({d})')} AS d{i}_{k}")
            for i, d in enumerate(fields.values())
            for k, sql in parts.items()
        ]
    )
    rows = [
        struct_sql(
            field=text_sql(name),
            min=f"string(d{i}_min)",
            max=f"string(d{i}_max)",
            distinctDays=f"d{i}_distinctDays",
        )
        for i, name in enumerate(fields)
    ]
    return wide.selectExpr(inline_sql(rows))


# Sketches of 2^15 registers err by about 0.6 %.
SKETCH_LOG = 15


def distinct_sketches(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, sketch``: a HyperLogLog sketch of the values of each field, missing cells left out.

    The sketches of parts can be kept as a table and merged later; the exact distinct counts of
    :func:`category_stats` stay the default.
    """
    sketches = [
        f"hll_sketch_agg(CASE WHEN NOT {missing_sql(df, f)} THEN {key_sql(df, f)} END, {SKETCH_LOG}) AS s{i}"
        for i, f in enumerate(fields)
    ]
    rows = [struct_sql(field=text_sql(f), sketch=f"s{i}") for i, f in enumerate(fields)]
    return df.agg(*[F.expr(x) for x in sketches]).selectExpr(inline_sql(rows))


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """``field, distinctCount`` (estimated) of all parts together."""
    return grouped(sketches, ["field"], ["hll_sketch_estimate(hll_union_agg(sketch)) AS distinctCount"])
