"""Delimited text, read as an all-text table with clean column names."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.columns import col, text_sql
from tabwright.scale import is_light, materialize
from tabwright.sources.headers import clean_names, drop_placeholders
from tabwright.sources.records import AT, BLOCK, FILE, PLACE, data_records, scan_files
from tabwright.sources.tables import ROW_ID

# The delimiters that are tried.
DELIMITERS = [",", "\t", "|", ";"]
LINES_TO_GUESS = 20
FEW_RANGES = 64  # a lookup compares the keys one after another


@dataclass(frozen=True)
class RawTable:
    """Text cells under clean names, with what the header clean-up found."""

    df: DataFrame
    names: list[str]
    original_names: list[str]
    duplicate_names: bool


def guess_delimiter(lines: list[str]) -> str:
    """The delimiter that cuts the first lines into the steadiest number of cells."""
    best, best_score = ",", (0.0, 0)
    for delimiter in DELIMITERS:
        widths = [len(cells) for cells in csv.reader(lines, delimiter=delimiter) if cells]
        if not widths or max(widths) < 2:
            continue
        common = max(set(widths), key=widths.count)
        score = (widths.count(common) / len(widths), common)
        if common > 1 and score > best_score:
            best, best_score = delimiter, score
    return best


def has_quoted_newlines(spark: SparkSession, path: str, delimiter: str = ",") -> bool:
    """Whether a quoted cell of some file runs on to the next line."""
    return any(scan_files(spark, path, delimiter).values())


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    multi_line: bool | None = None,
    row_id: bool = True,
    lines_to_guess: int = LINES_TO_GUESS,
) -> RawTable:
    """Read UTF-8 delimited text; the first row of every file is the header.

    Every cell is text and an empty cell is NULL; short rows are padded. All files are
    split across tasks: those in which a quoted cell contains a line break are put together
    from their lines, the others are read as they are. ``multi_line`` True or False says that
    all or none of them have such cells; otherwise one pass over the text finds out.
    ``lines_to_guess`` lines decide the delimiter where none is given. ``_row_id`` counts the
    rows from 0 in order of file path and place in the file, however the files are split.
    """
    if delimiter is None:
        head = spark.read.text(path).filter(F.trim("value") != "").limit(lines_to_guess)
        delimiter = guess_delimiter([r["value"] for r in head.collect()])
    files = scan_files(spark, path, delimiter)
    running = [f for f, runs in files.items() if (runs if multi_line is None else multi_line)]
    whole = [f for f in files if f not in set(running)]
    options = {
        "sep": delimiter, "quote": '"', "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1",
    }
    reader = spark.read.options(**options)
    top = next(iter(files), None)
    first = reader.option("multiLine", top in running).csv(top).limit(1).collect() if top else []
    if not first:
        empty = spark.createDataFrame([], T.StructType([]))
        return RawTable(empty, [], [], False)
    raw = [cell or "" for cell in first[0]]
    columns = [f"_c{i}" for i in range(len(raw))]
    schema = ", ".join(f"{c} string" for c in columns)
    parts, sizes = [], []
    if whole:
        cells = reader.option("header", True).schema(schema).csv(whole if running else path)
        if row_id:
            cells = cells.selectExpr(*columns, *PLACE, f"monotonically_increasing_id() AS {AT}")
            sizes.append(cells.groupBy(FILE, BLOCK).agg(F.min(AT).alias("first"), F.count("*").alias("size")))
            cells = cells.withColumnRenamed(AT, "place")
        parts.append(cells)
    if running:
        records = data_records(spark, running, delimiter)
        cells = records.select(F.from_csv("record", schema, options).alias("cells"), FILE, BLOCK, "place")
        parts.append(cells.select("cells.*", *([FILE, BLOCK, F.col("place").cast("bigint").alias("place")] if row_id else [])))
        sizes.append(records.groupBy(FILE, BLOCK).agg(F.lit(0).cast("bigint").alias("first"), F.count("*").alias("size")))
    cells = reduce(DataFrame.unionByName, parts)
    if row_id:
        cells = with_dense_ids(cells, reduce(DataFrame.unionByName, sizes))
    keep = drop_placeholders(raw)
    names, renamed = clean_names([raw[i] for i in keep])
    df = cells.select(*[F.nullif(col(f"_c{i}"), F.lit("")).alias(n) for i, n in zip(keep, names)], *([ROW_ID] if row_id else []))
    return RawTable(df, names, [raw[i] for i in keep], renamed)


def with_dense_ids(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``_row_id`` from the place in a byte range and the number of rows before that range.

    ``sizes`` has a row per byte range with its ``size`` and the ``first`` place in it. Should
    Spark cut the files in another way later, places don't fit any more, which is an error.
    """
    offsets = sizes.selectExpr(FILE, BLOCK, "first", "size", f"sum(size) OVER (ORDER BY {FILE}, {BLOCK}) - size AS rows_before")
    few = offsets.limit(FEW_RANGES + 1).collect()
    if len(few) <= FEW_RANGES:
        # constants spare every later query a join, and go where nobody asks for the ids
        entry = "{}, named_struct('first', {}L, 'size', {}L, 'rows_before', {}L)"
        pairs = [entry.format(text_sql(f"{r[BLOCK]} {r[FILE]}"), r["first"], r["size"], r["rows_before"]) for r in few]
        kind = "map<string, struct<first: bigint, size: bigint, rows_before: bigint>>"
        found = rows.withColumn("_range", F.expr(f"cast(map({', '.join(pairs)}) AS {kind})[concat({BLOCK}, ' ', {FILE})]"))
        found = found.withColumns({c: F.col(f"_range.{c}") for c in ("first", "size", "rows_before")})
    else:
        offsets = materialize(offsets)
        found = rows.join(F.broadcast(offsets) if is_light(offsets) else offsets, [FILE, BLOCK], "left")
    inside = "place >= first AND place - first < size"
    changed = "raise_error('the files are split in another way than when they were opened: open them again')"
    return found.withColumn(ROW_ID, F.expr(f"CASE WHEN {inside} THEN rows_before + place - first ELSE cast({changed} AS BIGINT) END"))
