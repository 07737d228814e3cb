"""Delimited files that Spark derives from the tables: several files, messy headers, quoted line breaks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import Tables, query
from tabwright.fields import FieldSpec
from tabwright.plans.quality import quality_report
from tabwright.scale import checkpoint_dir
from tabwright.sources import RawTable, read_delimited
from tabwright.sources.tables import cap_rows

FILES = 8


def new_folder(t: Tables, name: str) -> str:
    """A folder of its own where the cluster keeps intermediate files."""
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """
    SELECT c_custkey::VARCHAR AS c_custkey, 'about "' || c_name || '",|' || repeat('and|', (c_custkey % 4)::INT) || 'end' AS note,
           round(c_acctbal, 2) AS c_acctbal
    FROM customer
    """,
    2,
)
def delimited_quoted_lines(t):
    """Cells with line breaks, doubled quotes and delimiters come back whole from split files."""
    folder = new_folder(t, "quoted")
    note = F.concat(F.lit('about "'), "c_name", F.lit('",\n'), F.expr("repeat('and\n', cast(c_custkey % 4 AS int))"), F.lit("end"))
    df = t.customer.select("c_custkey", note.alias("note"), "c_acctbal")
    df.repartitionByRange(FILES, "c_custkey").write.option("header", True).option("escape", '"').csv(folder)
    found = read_delimited(t.spark, folder).df
    return found.select("c_custkey", F.replace("note", F.lit("\n"), F.lit("|")).alias("note"), F.col("c_acctbal").cast("double"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id FROM orders")
def rows_of_many_files(t):
    """Row ids go on from file to file without a gap."""
    folder = new_folder(t, "files")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows.repartitionByRange(FILES, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).csv(folder)
    return read_delimited(t.spark, folder).df.select(F.col("o_orderkey").cast("bigint"), "_row_id")


# A header with a byte order mark, blanks, a repeat, an empty name and placeholders.
HEADER = "﻿key, name ,name,,__EMPTY,__EMPTY_1"


def messy_files(t: Tables) -> RawTable:
    """Customers in files of their own header each; every third row is cut short."""
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat_ws(",", "c_custkey", "c_name")).otherwise(
        F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.lit("drop"), F.lit("drop"))
    )
    part = (F.col("c_custkey") % FILES).alias("part")
    lines = t.customer.select(part, F.col("c_custkey").alias("k"), line.alias("value"))
    heads = lines.select("part").distinct().select("part", F.lit(-1).cast("bigint").alias("k"), F.lit(HEADER).alias("value"))
    folder = new_folder(t, "messy")
    both = lines.unionByName(heads).repartition(FILES, "part").sortWithinPartitions("part", "k")
    both.drop("k").write.partitionBy("part").text(folder)
    return read_delimited(t.spark, f"{folder}/*")


@query(
    """
    SELECT c_custkey::VARCHAR AS key, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS name_2,
           CASE WHEN c_custkey % 3 > 0 THEN c_nationkey::VARCHAR END AS "列4"
    FROM customer
    """
)
def messy_headers(t):
    """Names are cleaned, placeholder columns go, and short rows are filled with nulls."""
    return messy_files(t).df.drop("_row_id")


@query(
    """
    SELECT 'DUPLICATE_COLUMN_NAME' AS code, 'warning' AS level, NULL::VARCHAR AS field, NULL::BIGINT AS count, NULL::DOUBLE AS rate
    UNION ALL SELECT 'TRUNCATED', 'warning', NULL, count(*) - 100, NULL FROM customer HAVING count(*) > 100
    UNION ALL SELECT 'HIGH_NULL_RATE', 'warning', f, count_if(c_custkey % 3 = 0),
                     round(count_if(c_custkey % 3 = 0) / 100, 4)
    FROM (SELECT * FROM customer ORDER BY c_custkey % 8, c_custkey LIMIT 100), (VALUES ('name_2'), ('列4')) v(f)
    GROUP BY f HAVING count_if(c_custkey % 3 = 0) > 30
    """
)
def quality_of_cut_files(t):
    """A cap and a repeated name, both found in the files, are findings."""
    raw = messy_files(t)
    kept = cap_rows(raw.df, 100, ["_row_id"])
    specs = [FieldSpec(n, "string", "dimension") for n in raw.names]
    report = quality_report(kept, specs, raw.df.count(), kept.count(), raw.duplicate_names)
    return report.filter("code IN ('DUPLICATE_COLUMN_NAME', 'TRUNCATED', 'HIGH_NULL_RATE')")
