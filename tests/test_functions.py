import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabwright.fields import (
    FieldSpec, allows, behavior_aggregation, check_aggregation, infer_role, resolve_aggregation,
)
from tabwright.functions import cells
from tabwright.functions.formula import compile_formula, with_derived
from tabwright.functions.masking import mask, mask_columns
from tabwright.functions.predicates import apply_filters


@pytest.mark.parametrize(
    "text, value, tag",
    [
        ("65%", 0.65, "percentage"), ("65.5％", 0.655, "percentage"), ("1,234.56%", 12.3456, "percentage"),
        ("￥1,200", 1200, "currency"), ("$1,500.50", 1500.5, "currency"), ("€ 100", 100, "currency"),
        ("1,234", 1234, "decimal"), ("-1,234.5", -1234.5, "decimal"), ("1，234", 1234, "decimal"),
        ("100", 100, "integer"), ("-3.14", -3.14, "decimal"), (" 7 ", 7, "integer"),
        ("　42　", 42, "integer"), ("12,34", None, "plain"), ("1e5", None, "plain"), ("abc", None, "plain"),
        ("", None, "plain"), (None, None, "plain"), ("%", 0, "percentage"), ("$", 0, "currency"),
        ("$abc", None, "plain"), ("$5%", None, "plain"), ("9" * 400, None, "plain"), ("NaN", None, "plain"),
    ],
)
def test_parse_number(spark, text, value, tag):
    df = spark.createDataFrame([(text,)], "v string")
    row = df.select(cells.parse_number("v").alias("n"), cells.number_format("v").alias("f")).first()
    assert row["n"] == (None if value is None else pytest.approx(value))
    assert row["f"] == tag


@pytest.mark.parametrize(
    "text, day",
    [
        ("2026-07-01", "2026-07-01"), ("2026/7/3", "2026-07-03"), ("2026.7.5 08:30", "2026-07-05"),
        ("2026-07-05T08:30:59", "2026-07-05"), ("2026-7/3", "2026-07-03"), ("2026年7月5日", "2026-07-05"),
        ("2026年07月05", "2026-07-05"), ("7/3/2026", "2026-07-03"), ("12-31-2099", "2099-12-31"),
        ("2026-02-31", None), ("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("1899-12-31", None),
        ("2100-12-31", "2100-12-31"), ("2101-01-01", None), ("13/40/2026", None), ("2026-07", None),
        ("2026-007-01", None), ("2026-07-01x", None), ("", None), (None, None),
    ],
)
def test_parse_date(spark, text, day):
    found = spark.createDataFrame([(text,)], "v string").select(cells.parse_date("v")).first()[0]
    assert found == (dt.date.fromisoformat(day) if day else None)


def test_parse_boolean(spark):
    words = ["Yes", "是", "1", " t ", "NO", "否", "0", "f", "maybe", "", None]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    found = [r[0] for r in df.select(cells.parse_boolean("v")).collect()]
    assert found == [True] * 4 + [False] * 4 + [None] * 3


FILTER_ROWS = [(1, "a", 1.0), (2, "", 2.0), (3, None, None), (4, "ab", 10.0), (5, "b", float("nan"))]


@pytest.mark.parametrize(
    "field, operator, value, kept",
    [
        ("k", "eq", "a", [1]), ("k", "eq", "", [2, 3]), ("k", "neq", "a", [2, 3, 4, 5]),
        ("k", "in", ["a", "b"], [1, 5]), ("k", "in", ["", "a"], [1, 2, 3]), ("k", "in", "a", []),
        ("k", "not_in", ["a", "b"], [2, 3, 4]), ("k", "not_in", "a", []), ("k", "contains", "a", [1, 4]),
        ("k", "contains", "", [1, 2, 3, 4, 5]), ("v", "gt", 1, [2, 4]), ("v", "gte", "1", [1, 2, 4]),
        ("v", "lt", 10, [1, 2]), ("v", "lte", 10.0, [1, 2, 4]), ("v", "gt", "x", []), ("v", "gt", None, []),
        ("v", "between", [1, 2], [1, 2]), ("v", "between", [1], []), ("v", "eq", 10, [4]),
        ("v", "eq", "10.0", []), ("v", "neq", 10, [1, 2, 3, 5]), ("id", "eq", "3", [3]), ("id", "eq", "03", []),
        ("id", "in", [1, 5], [1, 5]), ("k", "gt", 0, []), ("id", "lte", 2.5, [1, 2]),
    ],
)
def test_filters(spark, field, operator, value, kept):
    df = spark.createDataFrame(FILTER_ROWS, "id int, k string, v double")
    out = apply_filters(df, [{"field": field, "operator": operator, "value": value}])
    assert sorted(r["id"] for r in out.collect()) == kept


def test_filters_on_dates_and_numbers_in_text(spark):
    df = spark.createDataFrame([(1, "2026-07-01 10:00:00", "5"), (2, "2026-07-02 00:00:00", "x")], "id int, t string, n string")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    day = [{"field": "t", "operator": "eq", "value": "2026-07-01"}]
    assert [r["id"] for r in apply_filters(df, day).collect()] == [1]
    later = [{"field": "t", "operator": "gt", "value": "2026-07-01"}]
    assert [r["id"] for r in apply_filters(df, later).collect()] == [2]
    assert apply_filters(df, [{"field": "n", "operator": "gt", "value": 4}]).count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(FILTER_ROWS, "id int, k string, v double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    expected = {
        ("k", "neq", "a"): "Not(EqualTo(k,a))",
        ("v", "gt", 1): "GreaterThan(v,1.0)",
        ("id", "in", (1, 2)): "In(id, [1,2])",
        ("k", "in", ("a", "b")): "In(k, [a,b])",
    }
    for (name, operator, value), pushed in expected.items():
        flt = {"field": name, "operator": operator, "value": value}
        plan = apply_filters(df, [flt])._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan[plan.index("PushedFilters") :]


def test_unknown_filter(spark):
    df = spark.createDataFrame(FILTER_ROWS, "id int, k string, v double")
    with pytest.raises(ValueError):
        apply_filters(df, [{"field": "k", "operator": "like", "value": "a"}])
    with pytest.raises(ValueError):
        apply_filters(df, [{"field": "nope", "operator": "eq", "value": "a"}])


def field(name):
    return {"op": "field", "field": name}


@pytest.mark.parametrize(
    "node, expected",
    [
        ({"op": "add", "left": field("a"), "right": field("b")}, 12.0),
        ({"op": "subtract", "left": field("a"), "right": {"op": "const", "value": 1}}, 9.0),
        ({"op": "multiply", "left": field("a"), "right": field("b")}, 20.0),
        ({"op": "divide", "left": field("a"), "right": field("b")}, 5.0),
        ({"op": "divide", "left": field("a"), "right": field("z")}, None),
        ({"op": "add", "left": field("a"), "right": field("n")}, None),
        ({"op": "safe_divide", "numerator": field("a"), "denominator": field("z"), "whenZero": "zero"}, 0.0),
        ({"op": "safe_divide", "numerator": field("a"), "denominator": field("z"), "whenZero": "null"}, None),
        ({"op": "safe_divide", "numerator": field("n"), "denominator": field("z"), "whenZero": "zero"}, None),
        ({"op": "abs", "value": {"op": "const", "value": -3}}, 3.0),
        ({"op": "round", "value": {"op": "const", "value": -2.5}}, -2.0),
        ({"op": "round", "value": {"op": "const", "value": 2.345}, "digits": 1}, 2.3),
        ({"op": "field", "field": "t"}, 7.0),
    ],
)
def test_formula(spark, node, expected):
    df = spark.createDataFrame([(10.0, 2.0, 0.0, None, "7")], "a double, b double, z double, n double, t string")
    assert df.select(compile_formula(df, node)).first()[0] == expected


def test_formula_checks(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    deep = field("a")
    for _ in range(8):
        deep = {"op": "abs", "value": deep}
    wide = field("a")
    for _ in range(5):
        wide = {"op": "add", "left": wide, "right": wide}
    for bad in (deep, wide, field("b"), {"op": "power"}, {"op": "abs"}):
        with pytest.raises(ValueError):
            compile_formula(df, bad)
    assert with_derived(df, "d", field("a")).columns == ["a", "d"]


def test_mask(spark):
    values = ["13812345678", "欧阳娜娜", "张三", "x", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    found = [r[0] for r in df.select(mask("v")).collect()]
    assert found == ["1*********8", "欧**娜", "张*", "*", "", None]
    tokens = mask_columns(df, ["v"], "s").collect()
    assert len({r["v_token"] for r in tokens}) == 6 and tokens[-1]["v_token"] is None


def test_roles():
    assert infer_role("日期", "date", "date", 3, 3) == "time"
    assert infer_role("月份", "string", "plain", 3, 9) == "time"
    assert infer_role("运营状态", "string", "plain", 2, 9) == "status"
    assert infer_role("客户", "string", "plain", 2, 9) == "dimension"
    assert infer_role("客户编号", "string", "plain", 2, 9) == "dimension"
    assert infer_role("手机号", "string", "plain", 2, 9) == "identifier"
    assert infer_role("金额", "number", "currency", 20, 20) == "identifier"
    assert infer_role("转化率", "number", "decimal", 20, 20) == "metric"
    assert infer_role("金额", "number", "currency", 10, 10) == "metric"


def test_aggregation_rules():
    rate = FieldSpec("r", "number", "metric", "percentage")
    key = FieldSpec("k", "number", "identifier")
    assert resolve_aggregation(rate) == "avg" and resolve_aggregation(key) == "count"
    assert resolve_aggregation(FieldSpec("r", "number", "metric", "percentage", aggregation="max")) == "max"
    assert resolve_aggregation(FieldSpec("r", "number", "metric", "percentage", aggregation="sum")) == "avg"
    assert resolve_aggregation(FieldSpec("d", "number", "metric", "duration")) == "avg"
    assert not allows(rate, "sum") and not allows(key, "avg") and allows(key, "max")
    assert behavior_aggregation(FieldSpec("s", behavior="stock")) == "last"
    with pytest.raises(ValueError):
        check_aggregation(FieldSpec("t"), "avg")
    with pytest.raises(ValueError):
        FieldSpec("t", type="decimal")
