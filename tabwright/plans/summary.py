"""What a task's result leaves out, and what there is to know about it.

Results are short by nature: a top-k, the first outliers, the commonest values. The
summary is one row from the same input that says how much there was in full.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright import operators as ops
from tabwright.columns import col, key_sql, kind, missing_sql, number_sql
from tabwright.fields import FieldSpec
from tabwright.functions.formula import compile_formula
from tabwright.functions.predicates import apply_filters
from tabwright.operators.anomaly import MIN_SAMPLES
from tabwright.operators.anomaly import ROW_LIMIT as OUTLIER_ROWS
from tabwright.operators.correlation import MIN_PAIRS
from tabwright.operators.distribution import MAX_CLASSES
from tabwright.operators.pivot import MANY_COLUMNS
from tabwright.operators.ratio import ROW_LIMIT as FORMULA_ROWS
from tabwright.plans.tasks import run_task

FEW_SLICES = 8  # fixed value: more classes than that don't make a pie


def _row(counts: DataFrame, rows: str, full: str = "full", nulls: str = "0L", codes: Mapping[str, str] | None = None) -> DataFrame:
    """``rowCount, fullCount, nullCount, truncated, warnings`` from one row of counts."""
    listed = ", ".join(f"CASE WHEN {when} THEN '{code}' END" for code, when in (codes or {}).items())
    return counts.selectExpr(
        f"bigint({rows}) AS rowCount",
        f"bigint({full}) AS fullCount",
        f"bigint({nulls}) AS nullCount",
        f"{rows} < {full} AS truncated",
        f"array_compact(cast(array({listed}) AS array<string>)) AS warnings",
    )


def _counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("full"))


def summary(
    df: DataFrame,
    task: Mapping[str, Any],
    specs: Sequence[FieldSpec] = (),
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """One row about the result of ``run_task`` for the same arguments.

    ``rowCount`` rows come out of ``fullCount`` there are. ``nullCount`` counts cells or
    rows without a value where that is possible. ``warnings`` are codes: ``CUT``,
    ``MANY_CLASSES``, ``MANY_COLUMNS``, ``FEW_VALUES``, ``NO_OUTLIER``, ``FEW_PAIRS``,
    ``CONSTANT``, ``ZERO_BASE``, ``NO_VALUE`` and ``NO_BUCKET``.
    """
    name, kept = task["operator"], apply_filters(df, task.get("filters"))
    metrics, dims = list(task.get("metrics") or []), list(task.get("dimensions") or [])
    limit = task.get("limit")
    if name == "distribution":
        return _of_distribution(kept, dims[0], limit)
    if name == "anomaly":
        return _of_anomaly(kept, metrics[0], task.get("anomalyMethod") or "iqr", limit or OUTLIER_ROWS)
    if name == "correlation":
        found = ops.correlation(kept, metrics[0], metrics[1]).withColumn("full", F.lit(1))
        few = f"sampleSize < {MIN_PAIRS}"
        return _row(found, "full", codes={"FEW_PAIRS": few, "CONSTANT": f"NOT {few} AND pearson IS NULL"})
    if name == "ratio":
        return _of_ratio(kept, task, dims, limit or FORMULA_ROWS)
    everything = {**task, "limit": None} if name != "ranking" else {**task, "operator": "aggregate", "limit": None}
    if name == "ranking":
        everything["aggregation"] = task.get("aggregation") or "sum"
    full = run_task(df, everything, specs, order_by)
    if name == "growth":
        zero = "count_if(growthRate IS NULL AND change IS NOT NULL) AS zero"
        counts = full.agg(F.count("*").alias("full"), F.expr(zero))
        rate = (task.get("compareMode") or "rate") == "rate"
        return _row(counts, "full", nulls="zero" if rate else "0L", codes={"ZERO_BASE": "zero > 0" if rate else "false"})
    if name == "pivot":
        across = kept.selectExpr(f"{key_sql(kept, dims[-1])} AS v").distinct()
        counts = _counted(full).withColumn("across", across.agg(F.count("*")).scalar())
        return _row(counts, "full", codes={"MANY_COLUMNS": f"across > {MANY_COLUMNS}"})
    if name == "timeseries":
        return _row(_counted(full), "full", codes={"NO_BUCKET": "full = 0"})
    cut = limit or (10 if name == "ranking" else None)
    rows = f"least(full, {cut})" if cut else "full"
    return _row(_counted(full), rows, codes={"CUT": f"full > {rows}"})


def _of_distribution(kept: DataFrame, field: str, limit: int | None) -> DataFrame:
    absent = f"count_if({missing_sql(kept, field)}) AS absent"
    if kind(kept, field) == "number":
        bins = _counted(ops.distribution(kept, field, limit=limit))
        unread = f"count_if(({number_sql(kept, field)}) IS NULL)"
        return _row(bins.withColumn("absent", kept.agg(F.expr(unread)).scalar()), "full", nulls="absent")
    classes = kept.filter(f"NOT {missing_sql(kept, field)}").selectExpr(f"{key_sql(kept, field)} AS v").distinct()
    counts = _counted(classes).withColumn("absent", kept.agg(F.expr(absent)).scalar())
    rows = f"least(full, {min(limit or MAX_CLASSES, MAX_CLASSES)})"
    return _row(counts, rows, nulls="absent", codes={"MANY_CLASSES": f"full > {FEW_SLICES}", "CUT": f"full > {rows}"})


def _of_anomaly(kept: DataFrame, metric: str, method: str, limit: int) -> DataFrame:
    counts = _counted(ops.anomaly(kept, metric, method, limit=None))
    values = kept.agg(F.expr(f"count({number_sql(kept, metric)})")).scalar()
    few = f"n < {MIN_SAMPLES}"
    rows = f"least(full, {limit})"
    codes = {"FEW_VALUES": few, "NO_OUTLIER": f"NOT {few} AND full = 0", "CUT": f"full > {rows}"}
    return _row(counts.withColumn("n", values), rows, codes=codes)


def _of_ratio(kept: DataFrame, task: Mapping[str, Any], dims: list[str], limit: int) -> DataFrame:
    formula = task["formula"]
    output = formula["outputField"]
    valued = kept.withColumn(output, compile_formula(kept, formula["expression"]))
    nulls = valued.agg(F.count_if(col(output).isNull())).scalar()
    if dims:
        groups = ops.ratio(kept, formula["expression"], output, dims)
        return _row(_counted(groups).withColumn("nulls", nulls), "full", nulls="nulls", codes={"NO_VALUE": "nulls > 0"})
    counts = _counted(valued.filter(col(output).isNotNull())).withColumn("nulls", nulls)
    rows = f"least(full, {limit})"
    return _row(counts, rows, nulls="nulls", codes={"NO_VALUE": "nulls > 0", "CUT": f"full > {rows}"})
