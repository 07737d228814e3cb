"""Trends over time, group comparisons and status analysis of the automatic report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import (
    group_key, inline_sql, key_sql, missing_sql, number_sql, struct_sql, text_sql,
)
from tabwright.fields import FieldSpec, resolve_aggregation
from tabwright.functions.dates import bucket_sql, date_sql, label_sql
from tabwright.plans.infer import grouped

DAILY_SPAN, WEEKLY_SPAN = 31, 365
TOP_GROUPS = 10
# What makes a status value a warning.
WARNING_WORDS = [
    "预警", "异常", "风险", "告警", "不达标", "失败", "负", "warn", "fail", "risk", "alert", "lost",
]


def _metric_parts(metrics: Sequence[FieldSpec], inputs: Sequence[str]) -> list[str]:
    """Per metric the parts every aggregate is made of; parts of parts add up."""
    return [
        struct_sql(
            field=text_sql(m.name),
            how=f"'{resolve_aggregation(m)}'",
            n=f"count({x})",
            total=f"sum({x})",
            low=f"min({x})",
            high=f"max({x})",
        )
        + f" AS _part{x}"
        for m, x in zip(metrics, inputs)
    ]


def _value_sql(n: str, total: str, low: str, high: str) -> str:
    return (
        f"CASE how WHEN 'count' THEN double({n}) WHEN 'avg' THEN {total} / {n} "
        f"WHEN 'min' THEN {low} WHEN 'max' THEN {high} ELSE {total} END"
    )


def _inputs(df: DataFrame, metrics: Sequence[FieldSpec]) -> tuple[list[str], list[str]]:
    names = [f"_x{i}" for i in range(len(metrics))]
    return names, [f"{number_sql(df, m.name)} AS {x}" for m, x in zip(metrics, names)]


def trends(
    df: DataFrame, time: str, metrics: Sequence[FieldSpec], grain: str | None = None
) -> DataFrame:
    """Points ``field, grain, label, value, count`` of all metrics, from one scan.

    Rows are added up by day first, and the days by grain. Without a given grain
    each metric gets day, week or month by the span of days it has. Rows without
    the metric do not count.
    """
    names, inputs = _inputs(df, metrics)
    rows = df.selectExpr(f"{date_sql(df, time)} AS day", *inputs).filter("day IS NOT NULL")
    daily = (
        grouped(rows, ["day"], _metric_parts(metrics, names))
        .selectExpr("day", inline_sql([f"_part{x}" for x in names]))
        .filter("n > 0")
    )
    if grain is None:
        # The window sees one row per day and metric.
        span = "datediff(max(day) OVER (PARTITION BY field), min(day) OVER (PARTITION BY field))"
        daily = daily.selectExpr("*", f"{span} AS span")
        chosen = (
            f"CASE WHEN span <= {DAILY_SPAN} THEN 'day' "
            f"WHEN span <= {WEEKLY_SPAN} THEN 'week' ELSE 'month' END"
        )
        grains = ["day", "week", "month"]
    else:
        chosen, grains = f"'{grain}'", [grain]

    def by_grain(sql, column: str) -> str:
        return "CASE grain " + " ".join(f"WHEN '{g}' THEN {sql(column, g)}" for g in grains) + " END"

    dated = daily.selectExpr("*", f"{chosen} AS grain").selectExpr(
        "*", f"{by_grain(bucket_sql, 'day')} AS start"
    )
    value = _value_sql("sum(n)", "sum(total)", "min(low)", "max(high)")
    return (
        grouped(
            dated, ["field", "how", "grain", "start"], [f"{value} AS value", "sum(n) AS count"]
        )
        .selectExpr("field", "grain", f"{by_grain(label_sql, 'start')} AS label", "value", "count")
        .orderBy("field", "label")
    )


def trend_changes(points: DataFrame) -> DataFrame:
    """Per metric: first and last value, their change and its rate.

    The change needs two periods; the rate also a first value other than 0.
    """
    ends = grouped(
        points,
        ["field", "grain"],
        [
            "min_by(value, label) AS first",
            "max_by(value, label) AS last",
            "count(*) AS periods",
            "sum(count) AS sampleSize",
        ],
    )
    change = "CASE WHEN periods >= 2 THEN last - first END"
    return ends.selectExpr(
        "field",
        "grain",
        "first",
        "last",
        f"{change} AS absoluteChange",
        f"try_divide({change}, abs(first)) AS changeRate",
        "periods",
        "sampleSize",
    )


def comparisons(df: DataFrame, dimension: str, metrics: Sequence[FieldSpec]) -> DataFrame:
    """``field, label, value, count`` per metric and group, from one scan.

    Rows without a label, or without the metric, do not count.
    """
    key = group_key(df, dimension)
    names, inputs = _inputs(df, metrics)
    rows = df.filter(f"NOT {missing_sql(df, dimension)}").selectExpr(f"{key.group} AS _key", *inputs)
    return (
        grouped(rows, ["_key"], _metric_parts(metrics, names))
        .selectExpr("_key", inline_sql([f"_part{x}" for x in names]))
        .filter("n > 0")
        .selectExpr(
            "field",
            f"{key.text('_key')} AS label",
            f"{_value_sql('n', 'total', 'low', 'high')} AS value",
            "n AS count",
        )
    )


def top_groups(groups: DataFrame, n: int = TOP_GROUPS) -> DataFrame:
    """The first groups of each metric by value; Spark cuts before the shuffle."""
    place = "row_number() OVER (PARTITION BY field ORDER BY value DESC, label)"
    ranked = groups.withColumn("rank", F.expr(place)).filter(f"rank <= {n}")
    return ranked.select("field", "rank", "label", "value", "count")


def group_gaps(top: DataFrame) -> DataFrame:
    """Per metric: best group, last of the listed ones, and how many times apart.

    Groups of equal value are not apart, nor is a group from itself.
    """
    ends = grouped(
        top,
        ["field"],
        [
            "min_by(struct(label, value), rank) AS top",
            "max_by(struct(label, value), rank) AS bottom",
        ],
    )
    return ends.selectExpr(
        "field",
        "top.label AS topLabel",
        "top.value AS topValue",
        "bottom.label AS bottomLabel",
        "bottom.value AS bottomValue",
        "CASE WHEN top.value <> bottom.value "
        "THEN try_divide(top.value, abs(bottom.value)) END AS ratio",
    )


def is_warning_sql(text: str, words: Sequence[str] | None = None) -> str:
    """True where a status text contains a warning word, in any letter case."""
    found = [f"contains(lower({text}), {text_sql(w.lower())})" for w in words or WARNING_WORDS]
    return "(" + " OR ".join(found) + ")"


def status_summary(
    df: DataFrame, status: str, metric: str | None = None, words: Sequence[str] | None = None
) -> DataFrame:
    """One row: warnings among the rows with a status, and the metric's mean on both sides."""
    x = number_sql(df, metric) if metric else "cast(NULL AS DOUBLE)"
    rows = df.filter(f"NOT {missing_sql(df, status)}").selectExpr(
        f"{is_warning_sql(key_sql(df, status), words)} AS warn", f"{x} AS x"
    )
    found = rows.agg(
        F.expr("count(*) AS total"),
        F.expr("count_if(warn) AS warnCount"),
        F.expr("coalesce(avg(CASE WHEN warn THEN x END), 0D) AS warned"),
        F.expr("coalesce(avg(CASE WHEN NOT warn THEN x END), 0D) AS normal"),
        F.expr("count(x) AS measured"),
    )
    name = text_sql(metric) if metric else "cast(NULL AS STRING)"
    return found.selectExpr(
        f"{text_sql(status)} AS field",
        "total",
        "warnCount",
        "coalesce(try_divide(warnCount, total), 0D) AS warnRate",
        f"{name} AS metric",
        "CASE WHEN measured > 0 THEN warned END AS warnAvg",
        "CASE WHEN measured > 0 THEN normal END AS normalAvg",
        "CASE WHEN measured > 0 THEN warned - normal END AS diff",
    )
