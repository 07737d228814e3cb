"""Sharding by a two-pass external shuffle.

Pass one scatters the records over buckets that fit a task's memory: the bucket is a
seeded hash of the whole record. Pass two reads one bucket at a time, puts it into an
order that depends on its records only, shuffles it with a seeded Fisher-Yates shuffle
and writes it. The buckets one after another are a random order of the whole table, and
the shards are its equal cuts, so the counts of two shards differ by one row at most.

The scatter is the only exchange that carries texts. Its hash reads the record and not
the input's partitions, so a lost task and another cluster give the same shards. Rows that
are equal in every column have one hash; where such copies would fill a good part of a
bucket they are counted first, one row a task, and dealt out again by their copy number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import fresh, written

SHARDS = 40
SEED = 42
BUCKET_BYTES = 32 << 20
ROW_BYTES = 16  # what a row weighs beside its texts
HOT_SHARE = 4  # equal rows beyond a quarter of a bucket are dealt out one by one
COPIES_AT_ONCE = 4096
CHECK = 0x9E3779B9  # tells the two hashes of a record apart


def record_hash(df: DataFrame, columns: list[str], seed: int) -> Column:
    """A hash of all columns; a null differs from a missing neighbour."""
    cells = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed).cast("bigint"), *[c.isNull() for c in cells], *cells)


def row_bytes(df: DataFrame, columns: list[str]) -> Column:
    """UTF-8 bytes of the texts of a row, and a fixed weight for the rest."""
    size = F.lit(ROW_BYTES).cast("bigint")
    for c in columns:
        if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType)):
            size += F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    return size


def dealt(hot: DataFrame, n: str, copy: str) -> DataFrame:
    """A row per copy: ``n`` rows numbered in ``copy``, made by many tasks however large ``n`` is."""
    part = fresh(hot, "_part")
    parts = hot.withColumn(part, F.explode(F.expr(f"sequence(0L, ({n} - 1) div {COPIES_AT_ONCE}L)")))
    inside = f"sequence({part} * {COPIES_AT_ONCE}L, least({n}, ({part} + 1) * {COPIES_AT_ONCE}L) - 1)"
    return parts.repartition(F.col(part)).withColumn(copy, F.explode(F.expr(inside))).drop(part)


def fisher_yates(marks: np.ndarray, checks: np.ndarray, seed: int, bucket: int) -> np.ndarray:
    """Places of a bucket's rows in shuffled order; the order that they arrived in plays no part."""
    random = np.random.Generator(np.random.PCG64([seed & (2**64 - 1), bucket]))
    return np.lexsort((checks, marks))[random.permutation(len(marks))]


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
             shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in it).

    Columns of these two names are replaced. Nulls and empty texts are values like others;
    equal rows all stay, each with a place of its own. An empty table gives no rows, and of
    fewer rows than shards each has a shard to itself. A text longer than a bucket makes one
    bucket that much larger.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    columns = [c for c in docs.columns if c.lower() not in (shard.lower(), slot.lower())]
    docs = docs.select(*[f"`{c}`" for c in columns])
    mark, check, copy, bucket, start, n, size = (fresh(docs, f"_{x}") for x in "mark check copy bucket start n size".split())
    marked = docs.withColumns({mark: record_hash(docs, columns, seed), check: record_hash(docs, columns, seed ^ CHECK)})
    groups = written(
        marked.withColumn(size, row_bytes(docs, columns)).groupBy(mark, check).agg(F.count("*").alias(n), F.max(size).alias(size)),
        "records",
    )
    total, weight = groups.agg(F.sum(n), F.sum(F.expr(f"decimal({n}) * {size}"))).first()
    buckets = max(1, -(-int(weight or 0) // bucket_bytes))
    hot = written(groups.filter(f"{n} > 1 AND {n} * {size} > {bucket_bytes // HOT_SHARE}").select(mark, check, n), "hot-records")
    into = F.pmod(F.xxhash64(F.lit(seed).cast("bigint"), mark, check, copy), F.lit(buckets)).cast("bigint")
    rows, counted = marked, groups.select(mark, check, n)
    if not hot.isEmpty():
        # equal rows meet in partial aggregates, so a task sends one of them
        copies = (
            marked.join(hot.select(mark, check), [mark, check], "left_semi").groupBy(mark, check)
            .agg(F.count("*").alias(n), F.any_value(F.struct(*[f"`{c}`" for c in columns])).alias("_row"))
        )
        copies = dealt(copies, n, copy).select("_row.*", mark, check, copy)
        rows = rows.join(hot, [mark, check], "left_anti").select(*[f"`{c}`" for c in columns], mark, check)
        rows = rows.withColumn(copy, F.lit(0).cast("bigint")).unionByName(copies)
        counted = counted.join(hot.select(mark, check), [mark, check], "left_anti").withColumn(copy, F.lit(0).cast("bigint"))
        counted = counted.unionByName(dealt(hot, n, copy).withColumn(n, F.lit(1).cast("bigint")))
    else:
        rows, counted = (x.withColumn(copy, F.lit(0).cast("bigint")) for x in (rows, counted))
    sums = counted.groupBy(into.alias(bucket)).agg(F.sum(n).alias(n))
    # the only window without a key sees a row per bucket
    starts = written(sums.selectExpr(bucket, f"sum({n}) OVER (ORDER BY {bucket}) - {n} AS {start}"), "buckets")
    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())])

    def shuffle(key: tuple, records: pa.Table) -> pa.Table:
        order = fisher_yates(records[mark].to_numpy(), records[check].to_numpy(), seed, key[0].as_py())
        at = records[start][0].as_py() + np.arange(len(order))
        cut = at * shards // total
        out = records.select(columns).take(pa.array(order))
        out = out.append_column(shard, pa.array(cut.astype(np.int32)))
        return out.append_column(slot, pa.array(at + (-cut * total // shards)))

    spread = rows.withColumn(bucket, into).join(starts, bucket)
    return spread.groupBy(bucket).applyInArrow(shuffle, schema)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED,
                 bucket_bytes: int = BUCKET_BYTES, shard: str = "shard", slot: str = "slot") -> None:
    """The shards as Parquet folders ``shard=0`` and on; files hold their rows in order of ``slot``."""
    found = shuffled(docs, shards, seed, bucket_bytes, shard, slot)
    found.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, docs: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The written rows in the columns that :func:`shuffled` gives for ``docs``."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in (shard.lower(), slot.lower())]
    schema = T.StructType([*kept, T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
