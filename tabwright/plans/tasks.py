"""Running described tasks, one by one or as a list, with provenance.

A task is a dictionary with ``id``, ``operator`` and the operator's arguments in
the shape ``dimensions``, ``metrics``, ``filters``, ``aggregation``, ``time``,
``formula``, ``compareMode``, ``anomalyMethod``, ``sort``, ``limit``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright import operators as ops
from tabwright.columns import col, missing_sql, number_sql
from tabwright.fields import FieldSpec, check_aggregation
from tabwright.functions.formula import compile_formula
from tabwright.functions.predicates import apply_filters
from tabwright.plans.shared import groups_of, shared_groups
from tabwright.scale import materialize

HEAD_ROWS = 10
MOST_ROWS = 100  # fixed value: the most rows that a task may ask for
# The evidence method that goes with each operator.
METHODS = {
    "profile": "summary",
    "aggregate": "aggregate",
    "timeseries": "trend",
    "compare": "group_compare",
    "distribution": "distribution",
    "ranking": "ranking",
    "ratio": "ratio",
    "growth": "growth",
    "correlation": "correlation",
    "anomaly": "outlier",
    "pivot": "pivot",
}
OVER_TIME = ("timeseries", "growth")
ADDITIVE = ("aggregate", "timeseries", "compare", "ranking", "growth", "pivot")


def run_task(
    df: DataFrame,
    task: Mapping[str, Any],
    specs: Sequence[FieldSpec] = (),
    order_by: Sequence[str] | None = None,
    quantile_method: str = "auto",
    groups: DataFrame | None = None,
) -> DataFrame:
    """The rows of one task, as a lazy DataFrame; bad arguments raise at once.

    ``groups`` are the task's grouped rows where they are computed already.
    """
    name = task["operator"]
    dims, metrics = list(task.get("dimensions") or []), list(task.get("metrics") or [])
    filters, sort, limit = task.get("filters"), task.get("sort"), task.get("limit")
    how, time = task.get("aggregation"), task.get("time") or {}
    by_name = {s.name: s for s in specs}
    if how and name in ADDITIVE:
        for m in metrics:
            if m in by_name:
                check_aggregation(by_name[m], how)
                if name in OVER_TIME and how == "sum" and by_name[m].behavior == "stock":
                    raise ValueError(f"{m} is a stock: it does not add up over time, use last")
    if limit is not None and not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be between 1 and {MOST_ROWS}")
    exact = {"quantile_method": quantile_method}
    ordered = {"order_by": order_by}
    given = {"groups": groups}
    if name == "profile":
        return ops.profile(df, metrics or dims or None, filters, **exact)
    if name == "aggregate":
        return ops.aggregate(df, dims, metrics, how or "sum", filters, sort, limit, **ordered, **exact, **given)
    if name == "compare":
        mode = task.get("compareMode")
        return ops.compare(df, dims, metrics, how or "sum", mode, filters, sort, limit, **ordered, **exact, **given)
    if name == "ranking":
        return ops.ranking(df, dims, metrics, how, sort, limit or 10, filters, **ordered, **exact, **given)
    if name == "pivot":
        return ops.pivot(df, dims, metrics, how or "sum", filters, **ordered, **exact, **given)
    if name in ("timeseries", "growth"):
        if not time.get("field"):
            raise ValueError(f"{name} needs time.field")
        if not metrics:
            raise ValueError(f"{name} needs at least 1 metric(s)")
        grain = time.get("grain", "month")
        if name == "growth":
            mode = task.get("compareMode") or "rate"
            return ops.growth(df, time["field"], metrics[0], grain, how or "sum", mode, filters, **ordered, **exact, **given)
        if dims or sort or limit:
            raise ValueError("timeseries takes no dimensions, sort or limit")
        return ops.timeseries(df, time["field"], metrics, grain, how, specs, filters, **ordered, **exact, **given)
    if name == "distribution":
        if not dims:
            raise ValueError("distribution needs a dimension")
        return ops.distribution(df, dims[0], filters, limit)
    if name == "correlation":
        if len(metrics) < 2:
            raise ValueError("correlation needs two metrics")
        return ops.correlation(df, metrics[0], metrics[1], filters)
    if name == "anomaly":
        if not metrics:
            raise ValueError("anomaly needs at least 1 metric(s)")
        method = task.get("anomalyMethod") or "iqr"
        return ops.anomaly(df, metrics[0], method, filters, limit or 50, **ordered, **exact)
    if name == "ratio":
        formula = task.get("formula")
        if not formula:
            raise ValueError("ratio needs a formula")
        return ops.ratio(df, formula["expression"], formula["outputField"], dims, filters, limit, **ordered, **given)
    raise ValueError(f"unknown operator {name!r}")


def task_scalar(df: DataFrame, task: Mapping[str, Any]) -> DataFrame | None:
    """One row ``scalar`` for the operators that have one."""
    if task["operator"] == "ratio":
        formula = task["formula"]
        return ops.ratio_scalar(
            df, formula["expression"], formula["outputField"],
            list(task.get("dimensions") or []), task.get("filters"),
        ).select("scalar")
    if task["operator"] == "correlation":
        return run_task(df, task).select(col("pearson").alias("scalar"))
    return None


def sample_size(df: DataFrame, task: Mapping[str, Any]) -> DataFrame:
    """One row ``sampleSize``: rows after the filter, or the values that counted."""
    kept = apply_filters(df, task.get("filters"))
    name, metrics = task["operator"], list(task.get("metrics") or [])
    counted = "count(*)"
    if name == "correlation":
        pair = [f"({number_sql(kept, m)}) IS NOT NULL" for m in metrics[:2]]
        counted = f"count_if({' AND '.join(pair)})"
    elif name == "anomaly":
        counted = f"count({number_sql(kept, metrics[0])})"
    elif name == "distribution":
        counted = f"count_if(NOT {missing_sql(kept, task['dimensions'][0])})"
    return kept.agg(F.expr(f"{counted} AS sampleSize"))


def null_count(df: DataFrame, task: Mapping[str, Any]) -> DataFrame:
    """One row ``nullCount``: rows for which a formula had no value."""
    kept = apply_filters(df, task.get("filters"))
    if task["operator"] == "ratio":
        value = compile_formula(kept, task["formula"]["expression"])
        return kept.agg(F.count_if(value.isNull()).alias("nullCount"))
    return kept.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("nullCount"))


def result_hash(rows: DataFrame, scalar: DataFrame | None = None) -> DataFrame:
    """One row ``resultHash``: SHA-256 of the scalar, or of all rows in any order.

    Each row gives an MD5; the first and last sixteen digits are added up as numbers,
    which needs no order and combines before the shuffle.
    """
    if scalar is not None:
        return scalar.select(
            F.sha2(F.coalesce(col(scalar.columns[0]).cast("string"), F.lit("null")), 256).alias("resultHash")
        )
    packed = F.to_json(F.struct(*[col(c) for c in rows.columns]))
    halves = rows.select(F.md5(packed.cast("binary")).alias("h"))
    sums = [
        f"coalesce(sum(cast(conv(substring(h, {at}, 16), 16, 10) AS DECIMAL(38, 0))), 0)" for at in (1, 17)
    ]
    return halves.agg(F.expr(f"sha2(concat_ws(':', count(*), {', '.join(sums)}), 256) AS resultHash"))


def evidence(
    df: DataFrame,
    task: Mapping[str, Any],
    specs: Sequence[FieldSpec] = (),
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """One row that says how a result came about and what it starts with."""
    # The result is read four times below, so it is computed once.
    rows = materialize(run_task(df, task, specs, order_by))
    scalar = task_scalar(df, task)
    fields = [*(task.get("dimensions") or []), *(task.get("metrics") or [])]
    if task.get("time"):
        fields.insert(0, task["time"]["field"])
    parameters = {
        k: v for k, v in task.items() if k not in ("id", "operator", "title", "purpose") and v
    }
    packed = F.to_json(F.struct(*[col(c) for c in rows.columns]))
    head = rows.limit(HEAD_ROWS).agg(F.collect_list(packed))
    no_scalar = F.lit(None).cast("string")
    return sample_size(df, task).select(
        F.lit(task["id"]).alias("taskId"),
        F.lit(task["operator"]).alias("operator"),
        F.lit(METHODS[task["operator"]]).alias("method"),
        F.array(*[F.lit(f) for f in dict.fromkeys(fields)]).cast("array<string>").alias("fields"),
        F.lit(json.dumps(parameters, ensure_ascii=False, sort_keys=True)).alias("parameters"),
        "sampleSize",
        rows.agg(F.count("*")).scalar().alias("rowCount"),
        null_count(df, task).scalar().alias("nullCount"),
        (scalar.select(col("scalar").cast("string")).scalar() if scalar is not None else no_scalar).alias("scalar"),
        head.scalar().alias("head"),
        result_hash(rows, scalar).scalar().alias("resultHash"),
    )


@dataclass(frozen=True)
class Outcome:
    """``status`` is ``ready``, ``failed`` or ``skipped``; ``rows`` of a ready task are computed."""

    status: str
    rows: DataFrame | None = None
    reason: str | None = None


def _shared(df: DataFrame, tasks: Sequence[Mapping[str, Any]], specs: Sequence[FieldSpec]) -> dict[str, DataFrame]:
    wanted = {}
    for t in tasks:
        try:
            groups = groups_of(df, t, specs)
        except Exception:
            continue  # the task meets the same error by itself, and that is its outcome
        if groups is not None:
            wanted[t["id"]] = groups
    if len(wanted) < 2:
        return {}
    try:
        return shared_groups(df, wanted)
    except Exception:
        return {}  # one of them fails on its rows: which, is seen when each runs by itself


def run_tasks(
    df: DataFrame,
    tasks: Sequence[Mapping[str, Any]],
    specs: Sequence[FieldSpec] = (),
    order_by: Sequence[str] | None = None,
) -> dict[str, Outcome]:
    """All tasks over one table. A bad task does not stop the others.

    Tasks that group the table share one scan, see :mod:`tabwright.plans.shared`; the others are
    computed in turn. Results are checkpoints, so an error that only shows in the rows is an
    outcome too; should the shared scan meet one, its tasks are computed by themselves.

    A dependency carries no data, only the wish not to run after a failure: a
    task whose dependency failed, is unknown or leads back to it is skipped.
    """
    by_id = {t["id"]: t for t in tasks}
    shared = _shared(df, tasks, specs)
    outcomes: dict[str, Outcome] = {}

    def settle(task_id: str, waiting: tuple[str, ...] = ()) -> bool:
        if task_id in waiting or task_id not in by_id:
            return False
        if task_id not in outcomes:
            needed = by_id[task_id].get("dependsOn") or []
            blocked = [d for d in needed if not settle(d, (*waiting, task_id))]
            if blocked:
                outcomes[task_id] = Outcome("skipped", reason=f"depends on {', '.join(blocked)}")
            else:
                try:
                    rows = materialize(run_task(df, by_id[task_id], specs, order_by, groups=shared.get(task_id)))
                    outcomes[task_id] = Outcome("ready", rows)
                except Exception as error:  # whatever a task meets is its outcome
                    outcomes[task_id] = Outcome("failed", reason=str(error))
        return outcomes[task_id].status == "ready"

    for t in tasks:
        settle(t["id"])
    return {t["id"]: outcomes[t["id"]] for t in tasks}
