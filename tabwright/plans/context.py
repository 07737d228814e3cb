"""A small, stable and masked picture of a table: what may be shown outside it."""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.columns import (
    NESTED, col, inline_sql, key_sql, kind, list_sql, literal_rows, missing_sql, number_sql, quoted, struct_sql, text_sql,
)
from tabwright.fields import FieldSpec, mentions
from tabwright.functions.dates import date_sql
from tabwright.functions.masking import SENSITIVE_WORDS, looks_sensitive_sql, mask_columns
from tabwright.functions.quantiles import quantiles
from tabwright.operators.anomaly import anomaly
from tabwright.plans import stats
from tabwright.plans.infer import data_columns, every_field, grouped
from tabwright.scale import materialize
from tabwright.sources.tables import ROW_ID, ids_at

SAMPLE_ROWS = 40
HEAD, MIDDLE, TAIL, RANDOM = 8, 6, 6, 12
ANOMALY_ROWS = 10
REPRESENTATIVE_VALUES = 10
CANDIDATES = 1000  # rows that one round of the coverage brings to the driver
SENSITIVE_SHARE = 0.5


def fingerprint(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row: a digest that any changed cell alters and row order does not."""
    return digest(fingerprint_state(df, fields))


def _row_md5(df: DataFrame, fields: Sequence[str]) -> str:
    """MD5 of a row; each cell tells its length, so neighbours can't be mistaken, or that it is NULL."""
    cells = []
    for f in fields:
        c, t = quoted(f), df.schema[f].dataType
        text = f"to_json({c})" if isinstance(t, NESTED) else f"hex({c})" if isinstance(t, T.BinaryType) else f"string({c})"
        cells.append(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(char_length({text}), ':', {text}) END")
    return f"md5(encode(concat({', '.join(cells)}), 'UTF-8'))"


def fingerprint_state(df: DataFrame, fields: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``rows, high, low`` (per ``keys``): the row count and the sums of both halves of the rows' MD5.

    States of parts of a table add up to the state of the whole, in any order; all combining
    is done on the map side.
    """
    fields = list(fields or data_columns(df))
    rows = df.selectExpr(*[quoted(k) for k in keys], f"{_row_md5(df, fields)} AS h")
    sums = [
        f"coalesce(sum(cast(conv(substring(h, {at}, 16), 16, 10) AS DECIMAL(38, 0))), 0) AS {name}"
        for at, name in ((1, "high"), (17, "low"))
    ]
    return rows.groupBy(*[col(k) for k in keys]).agg(F.expr("count(*) AS rows"), *[F.expr(x) for x in sums])


def digest(states: DataFrame) -> DataFrame:
    """One row ``fingerprint`` from the states of all parts."""
    total = [f"coalesce(sum({c}), 0)" for c in ("rows", "high", "low")]
    return states.agg(F.expr(f"sha2(concat_ws(':', {', '.join(f'string({x})' for x in total)}), 256) AS fingerprint"))


def growing_fingerprint(spark: SparkSession, path: str, states: str, fields: Sequence[str] | None = None) -> DataFrame:
    """The fingerprint of a folder of Parquet files that grows; only files not met before are read.

    ``states`` is a table with a row per file: its path, length and time of change, and its
    state. Files that are gone or were written anew don't count any more, because a file counts by
    all three. The state table is only ever appended to, so a job that was lost is run again.
    """
    # the listing reads no content
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0")
    listed = listed.filter("path LIKE '%.parquet'").select("path", "length", "modificationTime")
    known = listed.sparkSession.createDataFrame([], f"path string, length bigint, modificationTime timestamp, {STATE}")
    if _exists(spark, states):
        known = spark.read.parquet(states)
    file = ["path", "length", "modificationTime"]
    new = [r["path"] for r in listed.join(known, file, "left_anti").select("path").collect()]
    if new:
        df = spark.read.parquet(*new)
        with_file = df.withColumn("_path", F.expr("_metadata.file_path"))
        found = fingerprint_state(with_file, list(fields or data_columns(df)), ["_path"])
        # a file without rows has a state too, or it would be read each time
        fresh = listed.filter(F.col("path").isin(new)).join(found, F.expr(f"{_plain('path')} = {_plain('_path')}"), "left")
        fresh.select(*file, F.expr("coalesce(rows, 0L) AS rows"), *[F.expr(f"coalesce({c}, 0) AS {c}") for c in ("high", "low")]).write.mode("append").parquet(states)
        known = spark.read.parquet(states)
    return digest(known.join(listed, file, "left_semi").dropDuplicates(file))


STATE = "rows bigint, high decimal(38,0), low decimal(38,0)"


def _plain(c: str) -> str:
    """A file path without the difference between file:/ and file:///."""
    return f"regexp_replace({c}, '^([a-z0-9]+):/+', '$1:/')"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def sensitive_columns(df: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """One row per field: is it sensitive by name, by role or by its values?

    By values means that over half of all the present values look like a phone
    number, an e-mail address, an identity card or a bank card.
    """
    cells = [
        struct_sql(
            field=text_sql(s.name),
            text=f"CASE WHEN NOT {missing_sql(df, s.name)} THEN {key_sql(df, s.name)} END",
        )
        for s in specs
    ]
    shares = grouped(
        df.selectExpr(inline_sql(cells)), ["field"], [f"avg(int({looks_sensitive_sql('text')})) AS rate"]
    )
    named = [(s.name, mentions(s.name, SENSITIVE_WORDS), s.role == "identifier") for s in specs]
    rows = [(f, str(n).lower(), str(r).lower()) for f, n, r in named]
    fields = literal_rows(df.sparkSession, rows, {"field": "string", "byName": "boolean", "byRole": "boolean"})
    # Both sides have one row per field; the table may have no rows at all.
    found = fields.join(F.broadcast(shares), "field", "left")
    return found.selectExpr("field", "byName", "byRole", "coalesce(rate, 0D) AS matchRate").selectExpr(
        "*", f"byName OR byRole OR matchRate > {SENSITIVE_SHARE}D AS sensitive"
    )


def sensitive_names(df: DataFrame, specs: Sequence[FieldSpec]) -> list[str]:
    found = sensitive_columns(df, specs).filter("sensitive").collect()
    return sorted(r["field"] for r in found)


def sample_positions(total: int, seed: int = 0) -> list[int]:
    """Head, middle, tail and seeded random positions, without repeats."""
    if total <= SAMPLE_ROWS:
        return list(range(total))
    middle = (total - MIDDLE) // 2
    chosen = {*range(HEAD), *range(middle, middle + MIDDLE), *range(total - TAIL, total)}
    draw = random.Random(seed)
    chosen.update(int(total * draw.random()) for _ in range(RANDOM))
    return sorted(chosen)


def category_ids(
    df: DataFrame,
    fields: Sequence[str],
    row_id: str = ROW_ID,
    most: int = SAMPLE_ROWS,
    shown: Sequence[int] = (),
) -> list[int]:
    """Rows that show the most values which the rows ``shown`` and earlier picks don't show, at most ``most``.

    Greedy maximum coverage; of rows with equal gain the first is taken. Rows with the same values
    are one candidate. A round fetches the candidates of highest gain; since gains only fall,
    picks among these hold as long as none that was left behind can gain more.
    :func:`sample_coverage` tells what found no room.
    """
    if not fields or most <= 0:
        return []
    keys = [f"k{i}" for i in range(len(fields))]
    cells = df.selectExpr(f"{quoted(row_id)} AS id", *[f"{key_sql(df, f)} AS {k}" for f, k in zip(fields, keys)])
    kinds = materialize(cells.groupBy(*keys).agg(F.min("id").alias("id")))
    seen: list[set[str]] = [{""} for _ in fields]

    def gain_of(row) -> int:
        return sum(row[k] not in s for k, s in zip(keys, seen))

    def show(row) -> None:
        for k, s in zip(keys, seen):
            s.add(row[k])

    if shown:
        for row in cells.filter(F.col("id").isin(list(shown))).collect():
            show(row)
    chosen: list[int] = []
    while len(chosen) < most:
        # what is seen has at most a value per field and chosen row
        gain = " + ".join(f"CASE WHEN {k} IN ({list_sql(sorted(s))}) THEN 0 ELSE 1 END" for k, s in zip(keys, seen))
        fetched = (
            kinds.withColumn("gain", F.expr(gain)).filter("gain > 0")
            .orderBy(col("gain").desc(), col("id")).limit(CANDIDATES).collect()
        )
        left_behind = (fetched[-1]["gain"], -fetched[-1]["id"]) if len(fetched) == CANDIDATES else (0, 0)
        picked = False
        while fetched and len(chosen) < most:
            best = max(fetched, key=lambda r: (gain_of(r), -r["id"]))
            if gain_of(best) == 0 or (gain_of(best), -best["id"]) < left_behind:
                break
            chosen.append(best["id"])
            show(best)
            picked = True
        if not picked or len(fetched) < CANDIDATES:
            break
    return chosen


def sample_coverage(df: DataFrame, sample: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, values, shown``: how many values a field has and how many the sample shows."""

    def counts(part: DataFrame, name: str) -> DataFrame:
        cells = [struct_sql(field=text_sql(f), value=key_sql(part, f)) for f in fields]
        values = part.selectExpr(inline_sql(cells)).filter("value <> ''").distinct()
        return grouped(values, ["field"], [f"count(*) AS {name}"])

    both = every_field(counts(df, "values"), fields).join(F.broadcast(counts(sample, "shown")), "field", "left")
    return both.na.fill(0)


def stable_sample(
    df: DataFrame,
    category_fields: Sequence[str] = (),
    seed: int = 0,
    row_id: str = ROW_ID,
) -> DataFrame:
    """At most forty rows, the same ones on every call; a small table whole.

    Head, middle and tail come first, then rows that together show as many values of the
    low-cardinality fields as possible, then the seeded random rows as far as there is room.
    """
    total = df.count()
    if total <= SAMPLE_ROWS:
        return df
    positions = sample_positions(total, seed)
    middle = (total - MIDDLE) // 2
    fixed = [
        p
        for p in positions
        if p < HEAD or middle <= p < middle + MIDDLE or p >= total - TAIL
    ]
    ids = ids_at(df, fixed, row_id)
    more = category_ids(df, category_fields, row_id, SAMPLE_ROWS - len(ids), ids)
    more += ids_at(df, [p for p in positions if p not in fixed], row_id)
    for i in more:
        if len(ids) < SAMPLE_ROWS and i not in ids:
            ids.append(i)
    return df.filter(col(row_id).isin(ids))


def boundary_rows(
    df: DataFrame,
    metrics: Sequence[str],
    row_id: str = ROW_ID,
    quantile_method: str = "auto",
) -> DataFrame:
    """``field, edge, row id, value`` of the rows at or nearest to each edge.

    Edges are the minimum, the maximum and the quartiles; ties go to the first row.
    """
    base = df.selectExpr(
        f"{quoted(row_id)} AS at", *[f"{number_sql(df, m)} AS v{i}" for i, m in enumerate(metrics)]
    )
    inputs = {f"x{i}": f"v{i}" for i in range(len(metrics))}
    quartiles = quantiles(base, [], inputs, [0.25, 0.75], quantile_method)
    edges = quartiles.selectExpr(f"struct({', '.join(inputs)}) AS e").scalar()
    aggs = []
    for i, m in enumerate(metrics):
        distances = {
            "min": f"v{i}",
            "max": f"-v{i}",
            "p25": f"abs(v{i} - e.x{i}.q[0])",
            "p75": f"abs(v{i} - e.x{i}.q[1])",
        }
        for edge, distance in distances.items():
            row = f"named_struct('at', at, 'value', v{i})"
            nearest = f"min_by({row}, struct({distance}, at)) FILTER (WHERE v{i} IS NOT NULL)"
            aggs.append(struct_sql(field=text_sql(m), edge=f"'{edge}'", row=nearest))
    wide = base.withColumn("e", edges).agg(*[F.expr(f"{a} AS r{i}") for i, a in enumerate(aggs)])
    return (
        wide.selectExpr(inline_sql([f"r{i}" for i in range(len(aggs))]))
        .filter("row IS NOT NULL")
        .selectExpr("field", "edge", f"row.at AS {quoted(row_id)}", "row.value AS value")
    )


def anomaly_rows(
    df: DataFrame, metrics: Sequence[str], row_id: str = ROW_ID, limit: int = ANOMALY_ROWS
) -> DataFrame:
    """The first outlier rows by the interquartile rule over the number fields."""
    found = [
        anomaly(df, m, order_by=[row_id], limit=limit).selectExpr(
            f"{text_sql(m)} AS field", quoted(row_id), "_direction AS direction", f"{quoted(m)} AS value"
        )
        for m in metrics
    ]
    everything = reduce(DataFrame.unionByName, found)
    return everything.orderBy(col(row_id), col("field")).limit(limit)


def column_context(
    df: DataFrame, specs: Sequence[FieldSpec], masked: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Number, date and value summaries of the columns, with masked texts.

    Of masked numbers and dates no cell appears, so their least and greatest don't
    either: ``hidden`` only counts them.
    """
    texts_masked = [m for m in masked if kind(df, m) == "string"]
    shown = mask_columns(df, texts_masked) if texts_masked else df
    numbers = [s.name for s in specs if kind(df, s.name) == "number"]
    dates = {s.name: date_sql(df, s.name) for s in specs if s.type == "date"}
    texts = [s.name for s in specs if s.name not in numbers and s.name not in dates]
    hidden = [n for n in (*numbers, *dates) if n in masked]
    numbers = [n for n in numbers if n not in hidden]
    dates = {n: d for n, d in dates.items() if n not in hidden}
    out = {}
    if numbers:
        out["numbers"] = stats.numeric_stats(df, numbers)
    if dates:
        out["dates"] = stats.date_stats(df, dates)
    if texts:
        out["values"] = stats.category_values(shown, texts, REPRESENTATIVE_VALUES, 0)
    if hidden:
        cells = [struct_sql(field=text_sql(n), absent=missing_sql(df, n)) for n in hidden]
        counts = ["count_if(NOT absent) AS count", "count_if(absent) AS nullCount"]
        out["hidden"] = every_field(grouped(df.selectExpr(inline_sql(cells)), ["field"], counts), hidden)
    return out


def table_context(
    df: DataFrame,
    specs: Sequence[FieldSpec],
    seed: int = 0,
    row_id: str = ROW_ID,
    row_samples: bool = True,
) -> dict[str, DataFrame]:
    """Everything above for one table, masked before anything is picked.

    Cells of sensitive fields appear nowhere, whatever their type. ``row_samples=False`` leaves the rows out.
    """
    hidden = sensitive_names(df, specs)
    out = {"fingerprint": fingerprint(df, [s.name for s in specs])}
    out |= column_context(df, specs, hidden)
    if row_samples:
        numbers = [s.name for s in specs if kind(df, s.name) == "number" and s.name not in hidden]
        categories = [s.name for s in specs if s.role in ("dimension", "status")]
        sample = stable_sample(df, categories, seed, row_id)
        out["sample"] = mask_columns(sample, hidden)
        if categories:
            out["coverage"] = sample_coverage(df, sample, categories)
        if numbers:
            out["boundary"] = boundary_rows(df, numbers, row_id)
            out["anomalies"] = anomaly_rows(df, numbers, row_id)
    return out
