"""Groups of many tasks from one scan.

Tasks that group one table and add numbers up differ in their filter, keys and metrics only.
A row is turned into one narrow row per task that it counts for, and a single aggregate
over (task, keys) serves them all: what grouping sets do, with a filter for each set.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import col, inline_sql, number_sql, quoted, require, struct_sql
from tabwright.fields import FieldSpec, behavior_aggregation
from tabwright.functions.aggregates import aggregate_sql, check, or_zero
from tabwright.functions.dates import bucket_sql, date_sql, label_sql
from tabwright.functions.formula import formula_sql
from tabwright.functions.predicates import filters_sql
from tabwright.operators.grouping import keys_of
from tabwright.scale import materialize

# These keep a few numbers per group; medians and the last value in order are computed by themselves.
MERGED = ("sum", "avg", "count", "min", "max")


@dataclass(frozen=True)
class Groups:
    """What a task groups: a condition, texts of keys on rows and on groups, numbers and their aggregates."""

    condition: str
    keys: dict[str, tuple[str, Callable[[str], str]]]
    values: dict[str, tuple[str, str]]
    zero: bool = True


def groups_of(df: DataFrame, task: Mapping[str, Any], specs: Sequence[FieldSpec] = ()) -> Groups | None:
    """The groups of a task, or None where it has none that can be shared; bad arguments raise."""
    name, dims, metrics = task["operator"], list(task.get("dimensions") or []), list(task.get("metrics") or [])
    require(df, [*dims, *metrics])
    tests = [t] if (t := filters_sql(df, task.get("filters"))) else []
    keys = {k.name: (k.text(k.group), lambda text: text) for k in keys_of(df, dims)}
    how = task.get("aggregation") or "sum"
    if name in ("aggregate", "compare", "ranking", "pivot"):
        values = {m: (number_sql(df, m), how) for m in metrics}
    elif name in ("timeseries", "growth") and metrics and (task.get("time") or {}).get("field"):
        field, grain = task["time"]["field"], task["time"].get("grain", "month")
        day = date_sql(df, field)
        tests.append(f"({day}) IS NOT NULL")
        keys = {field: (f"string({bucket_sql(f'({day})', grain)})", lambda text: label_sql(f"date({text})", grain))}
        by_name = {s.name: s for s in specs}
        if name == "growth":
            values = {metrics[0]: (number_sql(df, metrics[0]), how)}
            tests.append(f"({number_sql(df, metrics[0])}) IS NOT NULL")
        else:
            default = {m: task.get("aggregation") or behavior_aggregation(by_name.get(m)) for m in metrics}
            values = {m: (number_sql(df, m), default[m]) for m in metrics}
    elif name == "ratio" and dims and task.get("formula"):
        x = formula_sql(df, task["formula"]["expression"])
        tests.append(f"({x}) IS NOT NULL")
        values = {task["formula"]["outputField"]: (x, "avg")}
    else:
        return None
    for _, function in values.values():
        check(function)
    if not values or any(function not in MERGED for _, function in values.values()):
        return None
    return Groups(" AND ".join(tests) or "true", keys, values, name != "pivot")


def shared_groups(df: DataFrame, wanted: Mapping[str, Groups]) -> dict[str, DataFrame]:
    """The grouped rows of every task, from one scan and one shuffle; computed now, text keys first.

    Equal rows of a task meet on the map side, so a hot key is one row per task of Spark.
    """
    n_keys = max((len(g.keys) for g in wanted.values()), default=0)
    n_values = max((len(g.values) for g in wanted.values()), default=0)
    structs, needed = [], {}
    for i, g in enumerate(wanted.values()):
        cells = {"task": str(i)}
        keys, values = list(g.keys.values()), list(g.values.values())
        cells |= {f"k{j}": keys[j][0] if j < len(keys) else "cast(NULL AS STRING)" for j in range(n_keys)}
        cells |= {f"v{j}": values[j][0] if j < len(values) else "cast(NULL AS DOUBLE)" for j in range(n_values)}
        structs.append(f"CASE WHEN {g.condition} THEN {struct_sql(**cells)} END")
        for j, (_, how) in enumerate(values):
            needed.setdefault((how, j), []).append(str(i))
    aggs = [
        f"{aggregate_sql(f'CASE WHEN task IN ({chr(44).join(tasks)}) THEN v{j} END', how)} AS {how}_{j}"
        for (how, j), tasks in needed.items()
    ]
    rows = df.selectExpr(inline_sql(structs).replace("inline(array(", "inline(array_compact(array(", 1) + ")")
    grouped = materialize(rows.groupBy("task", *[f"k{j}" for j in range(n_keys)]).agg(*[F.expr(a) for a in aggs]))
    out = {}
    for i, (name, g) in enumerate(wanted.items()):
        keys = [f"{text(f'k{j}')} AS {quoted(k)}" for j, (k, (_, text)) in enumerate(g.keys.items())]
        values = []
        for j, (m, (_, how)) in enumerate(g.values.items()):
            value = or_zero(f"{how}_{j}", how) if g.zero else f"{how}_{j}"
            values.append(f"{value} AS {quoted(m)}")
        out[name] = grouped.filter(col("task") == i).selectExpr(*keys, *values)
    return out
