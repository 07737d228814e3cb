"""Records of delimited text whose quoted cells may run over several lines.

A file is cut by Spark at byte ranges, so a task doesn't know whether its first line begins
inside a quoted cell. A line is therefore read both ways: ``e0`` and ``e1`` tell whether a
cell is open at its end when none, or one, was open at its start. Such pairs of states can be
put together in any grouping like sums, so prefix windows, over the lines of a byte
range and then over the ranges of a file, give the state at every line. Only files in which a
cell runs on are read this way; no record is held beyond its own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.columns import text_sql
from tabwright.scale import materialize

FILE, BLOCK, AT = "_file", "_block", "_at"
PLACE = (f"_metadata.file_path AS {FILE}", f"_metadata.file_block_start AS {BLOCK}")


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` and where it stands: its file, the start of its byte range, a number rising in the range."""
    return spark.read.text(path).selectExpr("value", *PLACE, f"monotonically_increasing_id() AS {AT}")


def end_state_sql(line: str, delimiter: str, open_: int) -> str:
    """1 where a quoted cell is open at the end of a line, by its cells from left to right.

    A quote opens a cell at its first character only. In an open cell two quotes are one
    character, and any other quote closes it, also where text follows up to the delimiter.
    """
    closes = "CASE WHEN instr(replace({}, '\"\"', ''), '\"') > 0 THEN 0 ELSE 1 END"
    step = (
        f"CASE WHEN s = 1 THEN {closes.format('f')} "
        f"WHEN startswith(f, '\"') THEN {closes.format('substring(f, 2)')} ELSE 0 END"
    )
    cells = f"split({line}, {text_sql(chr(92) + 'Q' + delimiter + chr(92) + 'E')}, -1)"
    return f"CASE WHEN instr({line}, '\"') = 0 THEN {open_} ELSE aggregate({cells}, {open_}, (s, f) -> {step}) END"


def scan_files(spark: SparkSession, path: str, delimiter: str) -> dict[str, bool]:
    """Each file that has a line, in order of paths: does a cell of it run on to the next line?

    Up to the first such line a file is outside of quotes, so every line is read from there.
    """
    lines = spark.read.text(path).selectExpr("value", PLACE[0])
    found = lines.groupBy(FILE).agg(F.expr(f"max({end_state_sql('value', delimiter, 0)}) = 1 AS running"))
    return {r[FILE]: r["running"] for r in found.orderBy(FILE).collect()}


def before(df: DataFrame, within: str, order: str, start: str) -> DataFrame:
    """Add ``s0`` and ``s1``: the state before a row, by the states ``start`` of the window's first row.

    A row with ``e0 = e1`` sets the state, one with ``e0 > e1`` turns it over, others leave it.
    """
    over = f"OVER (PARTITION BY {within} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    turned = df.selectExpr("*", f"coalesce(count_if(e0 = 1 AND e1 = 0) {over}, 0L) AS _turns")
    last = f"last(CASE WHEN e0 = e1 THEN struct(e0 AS state, _turns AS turns) END, true) {over} AS _set"
    known = turned.selectExpr("*", last)
    state = "int(pmod(CASE WHEN _set IS NULL THEN {} + _turns ELSE _set.state + _turns - _set.turns END, 2))"
    names = ("s0", "s1") if start == "both" else ("s0",)
    found = known.selectExpr("*", *[f"{state.format(i)} AS {n}" for i, n in enumerate(names)])
    return found.drop("_turns", "_set")


def stitched_records(spark: SparkSession, files: list[str], delimiter: str) -> DataFrame:
    """``_file, _block, _at, record``: whole records, placed where their first line stands.

    Blank lines between records are left out. A quote that nothing closes up to the end of the
    file opens no cell: its line and those after it are records of their own.
    """
    lines = text_lines(spark, files).selectExpr(
        "*", f"{end_state_sql('value', delimiter, 0)} AS e0", f"{end_state_sql('value', delimiter, 1)} AS e1"
    )
    # written, because the lines are read for the states of the ranges and again with them
    lines = materialize(before(lines, f"{FILE}, {BLOCK}", AT, "both"))
    after = {i: f"CASE WHEN s{i} = 1 THEN e1 ELSE e0 END" for i in (0, 1)}
    ranges = lines.groupBy(FILE, BLOCK).agg(
        *[F.expr(f"max_by({x}, {AT}) AS e{i}") for i, x in after.items()],
        *[F.expr(f"max(CASE WHEN s{i} = 0 THEN {AT} END) AS open{i}") for i in (0, 1)],
    )
    # a row per byte range: the state at its start, and the last line before it that begins a record
    ranges = before(ranges, FILE, BLOCK, "closed").selectExpr(
        FILE, BLOCK, "s0 AS state", "CASE WHEN s0 = 1 THEN e1 ELSE e0 END AS end",
        "CASE WHEN s0 = 1 THEN open1 ELSE open0 END AS opener",
    )
    over = f"OVER (PARTITION BY {FILE} ORDER BY {BLOCK}"
    earlier = f"{over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"{over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    place = f"CASE WHEN opener IS NOT NULL THEN struct({BLOCK} AS block, opener AS at) END"
    ranges = ranges.selectExpr(
        FILE, BLOCK, "state", f"last({place}, true) {earlier} AS carried",
        f"CASE WHEN last(end) {whole} = 1 THEN last({place}, true) {whole} END AS unclosed",
    )
    here = f"last(CASE WHEN NOT inside THEN {AT} END, true) OVER (PARTITION BY {FILE}, {BLOCK} ORDER BY {AT})"
    owned = (
        lines.join(ranges, [FILE, BLOCK])
        .selectExpr("*", "CASE WHEN state = 1 THEN s1 ELSE s0 END = 1 AS inside")
        .selectExpr("*", "inside OR e0 = 1 AS several", f"{here} AS first")
        .selectExpr("*", f"CASE WHEN first IS NULL THEN carried ELSE struct({BLOCK} AS block, first AS at) END AS owner")
        .withColumn("several", F.expr("several AND NOT coalesce(owner = unclosed, false)"))
    )
    single = owned.filter("NOT several AND trim(value) <> ''").selectExpr(FILE, BLOCK, AT, "value AS record")
    text = f"array_join(transform(array_sort(collect_list(struct({BLOCK}, {AT}, value))), x -> x.value), '\\n')"
    joined = owned.filter("several").groupBy(FILE, "owner").agg(F.expr(f"{text} AS record"))
    return single.unionByName(joined.selectExpr(FILE, f"owner.block AS {BLOCK}", f"owner.at AS {AT}", "record"))


def data_records(spark: SparkSession, files: list[str], delimiter: str) -> DataFrame:
    """``_file, _block, place, record``: records without the header of each file, numbered from 0 in a byte range."""
    records = stitched_records(spark, files, delimiter)
    ranked = materialize(records.selectExpr("*", f"row_number() OVER (PARTITION BY {FILE}, {BLOCK} ORDER BY {AT}) AS rank"))
    first = ranked.groupBy(FILE).agg(F.min(BLOCK).alias("top"))
    headed = ranked.join(first, FILE).filter(f"{BLOCK} > top OR rank > 1")
    return headed.selectExpr(FILE, BLOCK, f"int(rank - CASE WHEN {BLOCK} = top THEN 2 ELSE 1 END) AS place", "record")
