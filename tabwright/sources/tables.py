"""Row order, caps, previews and stored tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.columns import NESTED, col, quoted, require
from tabwright.fields import FieldSpec

ROW_ID = "_row_id"
PREVIEW_ROWS = 20
SPEC = "field_spec"
# Rows that share the higher bits of their ids are a stretch of at most this many rows. Ids of
# ``monotonically_increasing_id`` count in 33 bits inside a split, so a stretch never leaves one.
STRETCH_BITS = 20
RANGE_SAMPLE = 2_000  # rows sampled per range when a table is laid out


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Attach increasing ids right after a scan: file order, without a shuffle.

    The ids have gaps between input splits. Save the table with its ids before
    relying on them across several queries.
    """
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def cap_rows(df: DataFrame, max_rows: int | None, order_by: Sequence[str]) -> DataFrame:
    """The first ``max_rows`` rows in order; no cap unless one is asked for."""
    require(df, list(order_by))
    if max_rows is None:
        return df
    return df.orderBy(*[col(c) for c in order_by]).limit(max_rows)


def row_counts(original: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: how many rows there were, how many were kept, and if any is gone."""
    kept = stored.agg(F.count("*")).scalar()
    return original.agg(F.count("*").alias("originalRowCount")).select(
        "originalRowCount",
        kept.alias("storedRowCount"),
        (col("originalRowCount") > kept).alias("truncated"),
    )


def preview(
    df: DataFrame, rows: int = PREVIEW_ROWS, order_by: Sequence[str] = (ROW_ID,)
) -> DataFrame:
    """The first rows in order: a distributed top-k, not a sort of the table."""
    return cap_rows(df, rows, order_by)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_table(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    specs: Sequence[FieldSpec] = (),
    cluster_by: Sequence[str] = (),
    lookup: Sequence[str] = (),
) -> None:
    """Keep a confirmed table for later analyses, its field specs in the columns' metadata.

    ``cluster_by`` lays the rows out by ranges of these columns, so that a filter on the first
    ones meets few files and row groups; rows of a frequent value are dealt over several
    ranges by a hash of the row. ``lookup`` columns get Bloom filters, for equality on values of any order.
    """
    require(df, [s.name for s in specs])
    for s in specs:
        df = df.withMetadata(s.name, {**df.schema[s.name].metadata, SPEC: json.dumps(asdict(s))})
    writer = df
    if cluster_by:
        require(df, list(cluster_by))
        columns = [col(c) for c in cluster_by]
        hashed = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, NESTED)]
        writer = df.repartitionByRange(*columns, F.xxhash64(*hashed)).sortWithinPartitions(*columns)
    require(df, list(lookup))
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in lookup}
    # with Spark's 100 sampled rows a range may be a tenth larger than another; it samples a million at most
    conf, name = df.sparkSession.conf, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = conf.get(name)
    conf.set(name, str(max(int(before), RANGE_SAMPLE)))
    try:
        writer.write.mode(mode).options(**options).parquet(path)
    finally:
        conf.set(name, before)


def stored_specs(df: DataFrame) -> list[FieldSpec]:
    """The specs that were saved with a table, for the columns that have one."""
    kept = [f.metadata[SPEC] for f in df.schema.fields if SPEC in f.metadata]
    return [FieldSpec(**json.loads(text)) for text in kept]


def ids_at(df: DataFrame, positions: Sequence[int], row_id: str = ROW_ID) -> list[int]:
    """Row ids at the given positions in row order, counted from 0.

    Ids are consecutive inside a stretch of them, so the stretches' sizes are enough:
    one narrow aggregate instead of ranking the table. Where rows were filtered out
    since they got their ids, the stretches with gaps at wanted positions are ranked.
    """
    wanted = sorted({int(p) for p in positions})
    if not wanted:
        return []
    c = quoted(row_id)
    splits = df.groupBy(F.expr(f"shiftright({c}, {STRETCH_BITS})").alias("split")).agg(
        F.expr(f"min({c}) AS first_id"), F.expr(f"max({c}) AS last_id"), F.expr("count(*) AS size")
    )
    # One row per stretch; the window only sees these.
    positions_sql = f"array({', '.join(f'{p}L' for p in wanted)})"
    placed = splits.selectExpr("*", "sum(size) OVER (ORDER BY split) - size AS before").selectExpr(
        "*", f"explode(filter({positions_sql}, p -> p >= before AND p < before + size)) AS position"
    )
    found = placed.selectExpr(
        "split", "position - before AS place",
        "CASE WHEN last_id - first_id + 1 = size THEN first_id + position - before END AS id",
    ).collect()
    ids = [r["id"] for r in found if r["id"] is not None]
    places: dict[int, list[int]] = {}
    for r in found:
        if r["id"] is None:
            places.setdefault(r["split"], []).append(r["place"])
    if places:
        touched = df.filter(F.expr(f"shiftright({c}, {STRETCH_BITS})").isin(list(places)))
        ranked = touched.selectExpr(
            f"{c} AS id", f"shiftright({c}, {STRETCH_BITS}) AS split",
            f"row_number() OVER (PARTITION BY shiftright({c}, {STRETCH_BITS}) ORDER BY {c}) - 1 AS place",
        )
        at = " OR ".join(f"(split = {s} AND place IN ({', '.join(map(str, ps))}))" for s, ps in places.items())
        ids += [r["id"] for r in ranked.filter(at).collect()]
    return sorted(ids)


def rows_at(df: DataFrame, positions: Sequence[int], row_id: str = ROW_ID) -> DataFrame:
    """The rows at these positions; the id list reaches the parquet scan."""
    return df.filter(col(row_id).isin(ids_at(df, positions, row_id)))
