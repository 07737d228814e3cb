"""Choices that depend on how big the data is.

The distributed way is the default and the short cuts need proof: counted rows, not
plan statistics, which see compressed bytes or default widths.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.columns import literal_rows

# All distinct values of so many rows fit one task, in memory and time.
SMALL_INPUT_ROWS = 1_000_000
# A side with at most this many narrow rows is broadcast: a few tens of MB.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def few_rows(df: DataFrame, most: int = SMALL_INPUT_ROWS) -> bool:
    """Whether there are at most ``most`` rows; no partition is read beyond that many."""
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def is_light(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether counted rows and counted bytes of texts fit every task beside its own work."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    length = " + ".join(["0L", *(f"coalesce(octet_length(`{c}`), 0)" for c in texts)])
    n, held = df.agg(F.count("*"), F.sum(F.expr(length))).first()
    return n <= rows and (held or 0) <= size


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one serves local sessions only."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tabwright-"))
    return shared or sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in storage that outlives executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pin(df: DataFrame) -> DataFrame:
    """Compute now and keep as constants.

    Only for results with a row per column of a table or less: what follows then
    plans with known numbers instead of computing them again.
    """
    schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return literal_rows(df.sparkSession, [tuple(r) for r in df.collect()], schema)
