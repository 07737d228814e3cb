"""Insights: facts over a threshold, in one fixed schema, and the report around them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import text_sql
from tabwright.fields import FieldSpec, split_roles
from tabwright.plans import stats, trends
from tabwright.plans.quality import duplicate_rows
from tabwright.scale import materialize, pin

MISSING_OVER = 0.3
LONG_TAIL_OVER, LONG_TAIL_VALUES = 0.5, 5
TREND_WARNING = 0.2
GAP_WARNING = 2
WARN_SHARE_WARNING = 0.15
TREND_METRICS = COMPARED_METRICS = 3
CATEGORY_FIELDS = 5
# SQL texts of the two levels, and the place of a row's own field.
INFO, WARNING, FIELD = "'info'", "'warning'", "field"
SCHEMA = {
    "kind": "string",
    "level": "string",
    "fields": "array<string>",
    "label": "string",
    "count": "bigint",
    "value": "double",
    "other": "double",
    "rate": "double",
}


def _insight(df: DataFrame, kind: str, level: str, fields: Sequence[str], **values: str) -> DataFrame:
    """Rows of ``df`` as insights of one kind; columns not given are NULL.

    ``level`` and ``values`` are SQL text; ``fields`` are texts of their own, or
    ``FIELD`` for the row's own field.
    """
    named = {
        "kind": f"'{kind}'",
        "level": level,
        "fields": "array(" + ", ".join(f if f == FIELD else text_sql(f) for f in fields) + ")",
        **values,
    }
    return df.selectExpr(
        *[f"cast({named.get(n, 'NULL')} AS {t}) AS {n}" for n, t in SCHEMA.items()]
    )


def _warn_if(condition: str) -> str:
    return f"CASE WHEN {condition} THEN {WARNING} ELSE {INFO} END"


def report(
    df: DataFrame,
    specs: Sequence[FieldSpec],
    quantile_method: str = "auto",
    original_rows: int | None = None,
    warning_words: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """The automatic analysis of a typed table, as named DataFrames.

    Roles decide what is computed: statistics and outliers of the metrics,
    values of the categories, trends over the time field, groups of the first
    dimension, warnings in the status fields, and ``insights`` over all of it.
    All parts are a few rows each and are computed now, once, since the insights read
    them again; only the search for repeated rows stays lazy.
    """
    roles = split_roles(list(specs))
    metrics = [m.name for m in roles.metrics]
    out: dict[str, DataFrame] = {}
    facts: list[DataFrame] = []

    if metrics:
        out["stats"] = pin(stats.numeric_stats(df, metrics, quantile_method))
        out["outliers"] = pin(stats.outliers_beyond(df, metrics, stats.bounds_of(out["stats"])))
        facts += _metric_insights(out["stats"], out["outliers"])

    lead = roles.dimension.name if roles.dimension else None
    categories = [s.name for s in roles.statuses]
    categories += [d.name for d in roles.dimensions if d.name != lead]
    categories = categories[:CATEGORY_FIELDS]
    if categories:
        out["categories"] = pin(stats.category_stats(df, categories))
        out["category_values"] = pin(stats.category_values(df, categories))
        facts += _category_insights(out["categories"], out["category_values"])

    if roles.time and metrics:
        out["trends"] = materialize(trends.trends(df, roles.time.name, roles.metrics[:TREND_METRICS]))
        facts.append(_trend_insight(out["trends"], roles.time.name))

    if lead and metrics:
        few = stats.category_stats(df, [lead]).first()
        if few is not None and few["lowCardinality"]:
            groups = trends.comparisons(df, lead, roles.metrics[:COMPARED_METRICS])
            out["comparisons"] = pin(trends.top_groups(groups))
            facts.append(_gap_insight(out["comparisons"], lead))

    for s in roles.statuses:
        first = metrics[0] if metrics else None
        summary = pin(trends.status_summary(df, s.name, first, warning_words))
        out[f"status:{s.name}"] = summary
        facts += _status_insights(summary, s.name, first)

    facts += _table_insights(df, [s.name for s in specs], original_rows)
    out["insights"] = reduce(DataFrame.unionByName, facts)
    return out


def insights(df: DataFrame, specs: Sequence[FieldSpec], **options) -> DataFrame:
    return report(df, specs, **options)["insights"]


def _metric_insights(numeric: DataFrame, outliers: DataFrame) -> list[DataFrame]:
    return [
        _insight(
            numeric, "statistics", INFO, [FIELD],
            count="count", value="avg", other="median", rate="nullRate",
        ),
        _insight(
            stats.missingness(numeric, MISSING_OVER), "missing", WARNING, [FIELD],
            count="nullCount", rate="nullRate",
        ),
        _insight(
            outliers.filter("detected AND outlierCount > 0"), "outliers", WARNING, [FIELD],
            count="outlierCount", value="lowerBound", other="upperBound",
        ),
    ]


def _category_insights(categories: DataFrame, values: DataFrame) -> list[DataFrame]:
    long_tail = f"longTailRate > {LONG_TAIL_OVER}D AND distinctCount > {LONG_TAIL_VALUES}"
    return [
        _insight(
            categories.filter(long_tail), "long_tail", INFO, [FIELD],
            count="distinctCount", rate="longTailRate",
        ),
        _insight(
            values.filter("side = 'top' AND rank = 1"), "top_value", INFO, [FIELD],
            label="value", count="count", rate="rate",
        ),
    ]


def _trend_insight(points: DataFrame, time: str) -> DataFrame:
    change = trends.trend_changes(points).filter("changeRate IS NOT NULL")
    return _insight(
        change, "trend", _warn_if(f"abs(changeRate) > {TREND_WARNING}D"), [FIELD, time],
        label="CASE WHEN absoluteChange > 0 THEN 'up' ELSE 'down' END",
        count="periods", value="first", other="last", rate="changeRate",
    )


def _gap_insight(top: DataFrame, dimension: str) -> DataFrame:
    gap = trends.group_gaps(top).filter("ratio IS NOT NULL")
    return _insight(
        gap, "group_gap", _warn_if(f"abs(ratio) > {GAP_WARNING}"), [FIELD, dimension],
        label="concat(topLabel, ' / ', bottomLabel)",
        value="topValue", other="bottomValue", rate="ratio",
    )


def _status_insights(summary: DataFrame, status: str, metric: str | None) -> list[DataFrame]:
    share = _insight(
        summary.filter("warnCount > 0"), "warning_share",
        _warn_if(f"warnRate > {WARN_SHARE_WARNING}D"), [status],
        count="warnCount", rate="warnRate",
    )
    if not metric:
        return [share]
    gap = _insight(
        summary.filter("diff IS NOT NULL"), "warning_gap", INFO, [status, metric],
        value="warnAvg", other="normalAvg", rate="diff",
    )
    return [share, gap]


def _table_insights(
    df: DataFrame, fields: list[str], original_rows: int | None
) -> list[DataFrame]:
    repeats = duplicate_rows(df, fields).filter("duplicateRowCount > 0")
    found = [_insight(repeats, "duplicate_rows", WARNING, [], count="duplicateRowCount")]
    if original_rows is not None:
        stored = df.agg(F.expr("count(*) AS rows")).filter(f"rows < {original_rows}")
        found.append(
            _insight(stored, "truncated", WARNING, [], count="rows", value=str(original_rows))
        )
    return found
