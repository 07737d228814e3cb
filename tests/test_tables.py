"""Sources, inference, normalization and quality on small files."""

import pytest
from pyspark.sql import functions as F

from tabwright.fields import FieldSpec
from tabwright.plans.infer import column_counts, infer, infer_columns, sampled_rows, type_votes
from tabwright.plans.normalize import normalization_counts, normalize
from tabwright.plans.quality import duplicate_rows, quality_report
from tabwright.sources import (
    cap_rows, clean_names, drop_placeholders, preview, read_delimited, read_table, save_table, with_row_id,
)
from tabwright.sources.delimited import guess_delimiter, has_quoted_newlines
from tabwright.sources.tables import row_counts, rows_at, stored_specs
from tests.conftest import rows_of

BASIC = """date,客户,托管群数,活跃率,运营状态,金额
2026-07-01,客户A,10,65%,正常,"￥1,200"
2026-07-01,客户B,8,72%,正常,¥800
2026-07-02,客户A,12,68%,预警,"$1,500"
2026-07-02,客户C,5,45%,正常,"1,234.56"
2026-07-03,客户B,9,80%,正常,"2,000"
2026-07-03,客户C,6,52%,预警,￥999
"""
MIXED = """id,数值,文本,日期,状态
1,100,apple,2026-07-01,正常
2,abc,banana,2026-07-02,预警
3,200,apple,2026/7/3,正常
4,,cherry,,正常
5,300,2026-07-04,2026年7月5日,预警
"""


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def types_of(inferred):
    return {s.name: (s.type, s.format, s.role, s.aggregation) for s in inferred.specs}


def test_basic_sheet(spark, tmp_path):
    raw = read_delimited(spark, write(tmp_path, BASIC))
    inferred = infer(raw.df)
    assert types_of(inferred) == {
        "date": ("date", "date", "time", "count"),
        "客户": ("string", "plain", "dimension", "count"),
        "托管群数": ("number", "integer", "metric", "sum"),
        "活跃率": ("number", "percentage", "metric", "avg"),
        "运营状态": ("string", "plain", "status", "count"),
        "金额": ("number", "currency", "metric", "sum"),
    }
    assert inferred.columns["活跃率"]["sampleValues"] == ["65%", "72%", "68%", "45%", "80%"]
    final = normalize(raw.df, inferred.specs)
    assert [r["金额"] for r in final.orderBy("_row_id").collect()] == [1200, 800, 1500, 1234.56, 2000, 999]
    assert dict(final.dtypes)["date"] == "date"
    changed = {r["field"]: r["changed"] for r in rows_of(normalization_counts(raw.df, inferred.specs))}
    assert changed["活跃率"] == 6 and changed["金额"] == 6 and changed["托管群数"] == 0


def test_mixed_sheet(spark, tmp_path):
    raw = read_delimited(spark, write(tmp_path, MIXED))
    found = types_of(infer(raw.df))
    assert found["数值"][0] == "string" and found["日期"][0] == "date"
    assert found["id"][2] == "identifier" and found["日期"][2] == "time"
    # A correction is applied to the raw text, and what it cannot read is counted.
    fixed = infer(raw.df, {"数值": {"type": "number", "role": "metric"}}).specs
    assert [r["数值"] for r in normalize(raw.df, fixed).orderBy("_row_id").collect()] == [100, None, 200, None, 300]
    report = {(r["code"], r["field"]): r["count"] for r in rows_of(quality_report(raw.df, fixed))}
    assert report[("INVALID_NUMBER", "数值")] == 1
    assert report[("MIXED_TYPE", "文本")] == 1


def test_duplicate_header_short_rows_and_placeholders(spark, tmp_path):
    text = "﻿客户,客户,,__EMPTY,__EMPTY_1\na,1,x,drop,drop\n\nb,2\n"
    raw = read_delimited(spark, write(tmp_path, text))
    assert raw.names == ["客户", "客户_2", "列3"] and raw.duplicate_names
    assert [tuple(r)[:3] for r in raw.df.orderBy("_row_id").collect()] == [("a", "1", "x"), ("b", "2", None)]
    codes = [r["code"] for r in rows_of(quality_report(raw.df, infer(raw.df).specs, 10, 2, raw.duplicate_names))]
    assert "DUPLICATE_COLUMN_NAME" in codes and "TRUNCATED" in codes


def test_names():
    assert clean_names(["a", " a ", "", "a_2", None]) == (["a", "a_2", "列3", "a_2_2", "列5"], True)
    assert clean_names(["a", "b"]) == (["a", "b"], False)
    assert drop_placeholders(["a", "__EMPTY", "__EMPTY_12", "__EMPTY_x"]) == [0, 3]


@pytest.mark.parametrize("sep", [",", "\t", "|", ";"])
def test_delimiters(spark, tmp_path, sep):
    text = sep.join(["k", "v"]) + "\n" + sep.join(["a", '"1,5;2|x"']) + "\n"
    raw = read_delimited(spark, write(tmp_path, text))
    assert [tuple(r)[:2] for r in raw.df.collect()] == [("a", "1,5;2|x")]
    assert guess_delimiter(["only one column", "here"]) == ","


def test_quotes_and_line_breaks_in_cells(spark, tmp_path):
    path = write(tmp_path, 'k,v\n"a ""b""","two\nlines"\nc,d\n')
    assert has_quoted_newlines(spark, path)
    raw = read_delimited(spark, path)
    assert [tuple(r)[:2] for r in raw.df.orderBy("_row_id").collect()] == [('a "b"', "two\nlines"), ("c", "d")]
    assert not has_quoted_newlines(spark, write(tmp_path, 'k\n"a ""b"""\n', "u.csv"))


def test_empty_file(spark, tmp_path):
    assert read_delimited(spark, write(tmp_path, "")).names == []


def test_votes_and_thresholds(spark):
    def decided(values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return infer_columns(df).first()

    assert decided(["1"] * 800 + ["x"] * 200)["type"] == "number"
    half = decided(["2026-01-01"] * 500 + ["x"] * 500)
    assert half["type"] == "string" and half["confidence"] == 0.5
    assert decided([""] * 500 + ["1"] * 100)["type"] == "number"
    assert decided(["true"] * 9 + ["x"])["type"] == "boolean"
    assert decided(["true"] * 8 + ["x"] * 2)["type"] == "string"
    nothing = decided(["", None])
    assert nothing["type"] == "string" and nothing["confidence"] == 0 and nothing["nullCount"] == 2


def test_votes_of_typed_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, 2.5, True, "2026-01-01"), (2, None, None, None)], "i int, d double, b boolean, t string")
    df = df.withColumn("t", F.col("t").cast("date"))
    votes = {r["field"]: r for r in rows_of(type_votes(df))}
    assert votes["i"]["number"] == 2 and votes["d"]["fractions"] == 1
    assert votes["b"]["boolean"] == 1 and votes["t"]["date"] == 1
    none = rows_of(infer_columns(df.filter("i > 9")))
    assert len(none) == 4 and all(r["rows"] == 0 for r in none)


def test_approximate_and_sampled_inference(spark):
    df = with_row_id(spark.range(2000).selectExpr("string(id) AS k", "'x' AS s"))
    exact, rough = infer(df), infer(df, sample_rows=100, approx_distinct=True)
    assert types_of(exact)["k"][:2] == types_of(rough)["k"][:2] == ("number", "integer")
    assert abs(rough.columns["k"]["distinctCount"] - 2000) < 200
    positions = [r["k"] for r in sampled_rows(df, 5).orderBy("_row_id").collect()]
    assert positions == ["0", "499", "999", "1499", "1999"]


def test_sample_values_of_sparse_columns(spark):
    df = spark.range(5000).selectExpr("id AS _row_id", "CASE WHEN id >= 4000 THEN string(id) END AS late", "'a' AS s")
    found = {r["field"]: r["sampleValues"] for r in rows_of(column_counts(df, ["late", "s"], "_row_id"))}
    assert found == {"late": ["4000", "4001", "4002", "4003", "4004"], "s": ["a"] * 5}


def test_long_texts_count_as_whole_texts(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",), ("1" * 70,)], "v string")
    found = infer_columns(df).first()
    assert found["distinctCount"] == 3 and found["string"] == 3 and found["number"] == 1


def test_row_positions_across_splits(spark):
    df = with_row_id(spark.range(0, 1000, 1, 7).selectExpr("id AS v"))
    found = sorted(r["v"] for r in rows_at(df, [0, 142, 143, 500, 999, 5000]).collect())
    assert found == [0, 142, 143, 500, 999]


def test_row_positions_after_a_filter(spark):
    df = with_row_id(spark.range(0, 1000, 1, 7).selectExpr("id AS v")).filter("v % 2 = 0 OR v < 10")
    want = [v for v in range(1000) if v % 2 == 0 or v < 10]
    at = [0, 3, 9, 77, 250, len(want) - 1]
    assert sorted(r["v"] for r in rows_at(df, [*at, 5000]).collect()) == [want[p] for p in at]


def test_specs_are_stored_with_the_table(spark, tmp_path):
    specs = [FieldSpec("v", "number", "metric", "percentage", "rate", "avg"), FieldSpec("k", include=False)]
    save_table(spark.createDataFrame([(1.0, "a", 2)], "v double, k string, other int"), str(tmp_path / "t"), specs=specs)
    assert stored_specs(read_table(spark, str(tmp_path / "t"))) == specs
    with pytest.raises(ValueError):
        save_table(spark.range(1), str(tmp_path / "u"), specs=specs)


def test_caps_and_storage(spark, tmp_path):
    df = with_row_id(spark.range(100).selectExpr("id AS v"))
    capped = cap_rows(df, 30, ["_row_id"])
    assert rows_of(row_counts(df, capped)) == [{"originalRowCount": 100, "storedRowCount": 30, "truncated": True}]
    assert cap_rows(df, None, ["_row_id"]) is df and preview(df).count() == 20
    save_table(capped, str(tmp_path / "kept"))
    assert read_table(spark, str(tmp_path / "kept")).count() == 30


def test_duplicates(spark):
    rows = [("a", "b"), ("a", "b"), ("ab", ""), ("a", "b"), (None, ""), (None, None), ("", None), (None, "x")]
    df = spark.createDataFrame(rows, "p string, q string")
    assert rows_of(duplicate_rows(df)) == [{"duplicateRowCount": 2, "emptyRowCount": 3}]
    numbers = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0)], "i int, d double")
    assert rows_of(duplicate_rows(numbers)) == [{"duplicateRowCount": 1, "emptyRowCount": 0}]


def test_duplicates_keep_cells_apart(spark):
    df = spark.createDataFrame([("a:1:b", "c"), ("a", "b:1:c"), (None, "-"), ("-", None)], "p string, q string")
    assert rows_of(duplicate_rows(df))[0]["duplicateRowCount"] == 0


def test_quality_rules(spark):
    rows = [(str(i), f"n{i % 60}", None if i % 2 else "x", "") for i in range(120)]
    df = spark.createDataFrame(rows, "id string, name string, half string, none string")
    specs = [FieldSpec("id", "number", "metric"), FieldSpec("name"), FieldSpec("half"), FieldSpec("none")]
    found = {(r["code"], r["level"], r["field"]) for r in rows_of(quality_report(df, specs))}
    assert found == {
        ("POSSIBLE_IDENTIFIER", "info", "id"), ("HIGH_CARDINALITY", "info", "name"),
        ("HIGH_NULL_RATE", "warning", "half"), ("EMPTY_COLUMN", "error", "none"),
    }


def by_csv_module(folder):
    """Records of the files in order, as Python's own reader sees them."""
    import csv

    out = []
    for path in sorted(folder.iterdir()):
        with open(path, newline="", encoding="utf-8") as f:
            out += [tuple(c.replace("\r\n", "\n") or None for c in r) for r in list(r for r in csv.reader(f) if r)[1:]]
    return out


def read_in_order(spark, folder, names=("k", "v")):
    raw = read_delimited(spark, str(folder))
    assert raw.names == list(names)
    rows = raw.df.orderBy("_row_id").collect()
    assert [r["_row_id"] for r in rows] == list(range(len(rows)))
    return raw.df, [tuple(r)[:-1] for r in rows]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("few", [0, 1000])
def test_records_over_many_byte_ranges(spark, tmp_path, small_splits, monkeypatch, few):
    """Cells that run over lines and whole byte ranges, among plain files; ids are dense in file
    order, whether the places of ranges are constants or a table."""
    monkeypatch.setattr("tabwright.sources.delimited.FEW_RANGES", few)
    lines = ['"k","v"']
    for i in range(60):
        cell = "\n".join(f"line {j} of , {i}" for j in range(i % 7)) + ('""q""\n' if i % 5 == 0 else "")
        lines += [f'{i},"{cell}"'] if i % 3 else [f"{i},plain"]
        lines += [""] if i % 10 == 0 else []
    (tmp_path / "b.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f"a{i},x\n" for i in range(80)), encoding="utf-8")
    (tmp_path / "c.csv").write_text('k,v\n' + "".join(f'c{i},"x, ""y"""\n' for i in range(80)), encoding="utf-8")
    (tmp_path / "d.csv").write_text('k,v\r\n"long\r\n' + "z" * 400 + '\r\nend",1\r\nlast,2', encoding="utf-8")
    df, rows = read_in_order(spark, tmp_path)
    assert rows == by_csv_module(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert read_in_order(spark, tmp_path)[1] == rows
    # the files were opened with other splits, so old places don't fit
    with pytest.raises(Exception, match="open them again"):
        df.collect()


def test_a_stray_quote_stays_in_its_line(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i:02}.csv").write_text("k,v\n" + "".join(f"{i}-{j},x\n" for j in range(40)), encoding="utf-8")
    (tmp_path / "g.csv").write_text('k,v\n1,"open\n2,"two ""words"""\n3,6" pipe\n4,"a\nb"\n5,"open for good\n6,7\n', encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    df, rows = read_in_order(spark, tmp_path)
    assert df.rdd.getNumPartitions() >= 25
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 1200 + 5
    # the first quote is closed by the next line's, the last one by nothing
    assert [r[0] for r in rows[1200:]] == ["1", "3", "4", "5", "6"]
    assert "\n2," in rows[1200][1] and rows[1201] == ("3", '6" pipe')
    assert rows[-3:] == [("4", "a\nb"), ("5", "open for good"), ("6", "7")]


def test_files_without_rows_have_no_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n", encoding="utf-8")
    assert read_delimited(spark, str(tmp_path / "a.csv")).df.collect() == []


def test_unused_row_ids_cost_no_join(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n", encoding="utf-8")
    raw = read_delimited(spark, str(tmp_path / "a.csv"))
    plan = raw.df.select("k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "rows_before" not in plan


def test_positions_after_a_filter_of_dense_ids(spark):
    df = spark.range(3_000_000).selectExpr("id AS _row_id", "id AS v").filter("v % 3 = 0")
    found = sorted(r["v"] for r in rows_at(df, [0, 400_000, 999_999]).collect())
    assert found == [0, 1_200_000, 2_999_997]
