"""Rules that golden numbers don't reach: decimals, open ends, failures, privacy, empty tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabwright import operators as ops
from tabwright.columns import double_text_sql
from tabwright.fields import FieldSpec, specs_of
from tabwright.functions.cells import parse_number
from tabwright.functions.predicates import apply_filters, number_text, value_text
from tabwright.plans import context, infer, summary, tasks, views

PRICES = ["12345678.5", "0.10", "-3.25", "100", None]


@pytest.fixture(scope="module")
def prices(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prices") / "t")
    rows = [(i, p and Decimal(p)) for i, p in enumerate(PRICES)]
    spark.createDataFrame(rows, "id int, p decimal(12, 2)").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def kept(df, operator, value, field="p"):
    return sorted(r["id"] for r in apply_filters(df, [{"field": field, "operator": operator, "value": value}]).collect())


@pytest.mark.parametrize(
    "operator, value, ids",
    [
        ("eq", 12345678.5, [0]), ("eq", "12345678.5", [0]), ("eq", "12345678.50", []), ("eq", 0.1, [1]), ("eq", Decimal("-3.250"), [2]),
        ("eq", 100, [3]), ("eq", "", [4]), ("eq", "1e2", []), ("eq", 0.123, []), ("eq", "99999999999999", []),
        ("neq", 12345678.5, [1, 2, 3, 4]), ("in", ["0.1", 100, "x"], [1, 3]), ("in", ["", -3.25], [2, 4]), ("not_in", [100, ""], [0, 1, 2]),
        ("gt", 0.1, [0, 3]), ("gt", 0.099, [0, 1, 3]), ("gte", 0.1, [0, 1, 3]), ("lt", 0.101, [1, 2]), ("lte", 0.1, [1, 2]), ("lte", 0.0999, [2]),
        ("gt", 1e30, []), ("lt", 1e30, [0, 1, 2, 3]), ("gte", "-1e30", [0, 1, 2, 3]), ("lt", -1e30, []), ("between", [0.1, "100"], [1, 3]),
        ("contains", "5678", [0]), ("gt", "x", []), ("gt", True, []),
    ],
)
def test_decimals_compare_in_their_own_type(prices, operator, value, ids):
    assert kept(prices, operator, value) == ids


def test_decimal_filters_reach_the_scan(prices):
    for operator, value, pushed in (("eq", 100, "EqualTo(p,100.00)"), ("in", [100, 0.1], "In(p, [0.10,100.00])"), ("gt", 5, "GreaterThan(p,5.00)")):
        flt = {"field": "p", "operator": operator, "value": value}
        plan = apply_filters(prices, [flt])._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan[plan.index("PushedFilters") :]


def test_long_integers_keep_all_digits(spark):
    df = spark.createDataFrame([(1, 9007199254740993), (2, 9007199254740992)], "id int, n long")
    assert kept(df, "eq", 9007199254740993, "n") == [1] and kept(df, "in", ["9007199254740992"], "n") == [2]
    assert kept(df, "eq", 10**30, "n") == [] and kept(df, "eq", "05", "n") == []


def test_number_texts(spark):
    texts = {
        12345678.5: "12345678.5", 1e-7: "1e-7", 1.5e-6: "0.0000015", 0.00012: "0.00012", 1e15: "1000000000000000", 123456789012345680.0: "123456789012345680",
        1e21: "1e+21", 1.5e22: "1.5e+22", -0.0: "0", -2.5e-9: "-2.5e-9", 100.0: "100", 0.1: "0.1", -12345678.25: "-12345678.25", 1e20: "100000000000000000000",
    }
    df = spark.createDataFrame([(x,) for x in texts], "x double").selectExpr("x", f"{double_text_sql('x')} AS t")
    assert {r.x: r.t for r in df.collect()} == texts
    assert {x: number_text(x) for x in texts} == texts
    assert value_text(Decimal("10.50")) == "10.5"


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_the_last_day(spark, kind):
    days = [dt.date(9999, 12, 31), dt.date(2024, 2, 29), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, d date").selectExpr("id", f"cast(d AS {kind}) AS d")
    want = {"eq": [0], "neq": [1, 2], "gt": [], "gte": [0], "lt": [1], "lte": [0, 1]}
    assert {op: kept(df, op, "9999-12-31", "d") for op in want} == want
    assert kept(df, "between", ["2024-02-29", "9999-12-31"], "d") == [0, 1]
    assert kept(df, "in", ["9999-12-31", ""], "d") == [0, 2]


def test_blanks_inside_numbers(spark):
    df = spark.createDataFrame([("1 000%",), ("$1 000",), (" 12 % ",), ("1,000%",), ("%",)], "c string")
    assert [r.n for r in df.select(parse_number("c").alias("n")).collect()] == [None, 1000.0, 0.12, 10.0, 0.0]


def test_padded_cells(spark):
    rows = [(" " * 70 + "2026/07/05",), (" " * 70 + "12.5",), ("x" * 200,), (" " * 100,)]
    r = infer.type_votes(spark.createDataFrame(rows, "c string"), ["c"]).first()
    assert (r["date"], r["number"], r["string"]) == (1, 1, 2)


def test_failures_are_outcomes(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "x")], "k string, v string")
    broken = df.withColumn("v", F.expr("assert_true(v = '1', 'bad row')").cast("string"))
    good = {"operator": "aggregate", "dimensions": ["k"], "metrics": ["v"], "aggregation": "count"}
    out = tasks.run_tasks(
        broken,
        [
            {"id": "late", **good}, {"id": "after", "dependsOn": ["late"], **good},
            {"id": "limit", "limit": 101, **good}, {"id": "unknown", **good, "metrics": ["nope"]},
            {"id": "profile", "operator": "aggregate", "dimensions": ["k"], "metrics": ["k"], "aggregation": "count"},
        ],
    )
    assert {k: o.status for k, o in out.items()} == {
        "late": "failed", "after": "skipped", "limit": "failed", "unknown": "failed", "profile": "ready",
    }
    assert "bad row" in out["late"].reason and out["profile"].rows.count() == 2


def test_behavior_rules(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0)], "d string, v double")
    task = {"operator": "timeseries", "metrics": ["v"], "time": {"field": "d"}, "aggregation": "sum"}
    for behavior, fine in (("flow", True), ("stock", False), ("rate", False)):
        specs = [FieldSpec("v", "number", "metric", behavior=behavior)]
        if fine:
            assert tasks.run_task(df, task, specs).count() == 1
        else:
            with pytest.raises(ValueError):
                tasks.run_task(df, task, specs)
    stock = [FieldSpec("v", "number", "metric", behavior="stock")]
    assert tasks.run_task(df, {**task, "operator": "aggregate"}, stock).count() == 1


def test_summaries(spark):
    df = spark.createDataFrame([(f"k{i % 30}", float(i % 7), i) for i in range(90)], "k string, v double, i int")

    def of(**task):
        return tuple(summary.summary(df, task).first())

    assert of(operator="aggregate", dimensions=["k"], metrics=["v"], limit=4) == (4, 30, 0, True, ["CUT"])
    assert of(operator="aggregate", dimensions=["k"], metrics=["v"]) == (30, 30, 0, False, [])
    assert of(operator="ranking", dimensions=["k"], metrics=["v"], aggregation="sum", sort={"field": "v", "direction": "desc"}) == (10, 30, 0, True, ["CUT"])
    assert of(operator="distribution", dimensions=["k"]) == (30, 30, 0, False, ["MANY_CLASSES"])
    assert of(operator="anomaly", metrics=["v"]) == (0, 0, 0, False, ["NO_OUTLIER"])
    assert of(operator="anomaly", metrics=["v"], filters=[{"field": "i", "operator": "lt", "value": 5}]) == (0, 0, 0, False, ["FEW_VALUES"])
    assert of(operator="correlation", metrics=["v", "i"], filters=[{"field": "v", "operator": "eq", "value": 1}])[4] == ["CONSTANT"]
    assert of(operator="pivot", dimensions=["v", "k"], metrics=["i"])[4] == ["MANY_COLUMNS"]


def test_no_cell_of_a_sensitive_number(spark):
    df = spark.createDataFrame([(13900000000 + i, dt.date(2000, 1, 1 + i), float(i)) for i in range(9)], "phone long, birthday date, v double")
    specs = specs_of(df, {"phone": {"role": "metric"}})
    out = context.column_context(df, specs, ["phone", "birthday"])
    assert [r.field for r in out["numbers"].collect()] == ["v"] and "dates" not in out
    assert sorted(tuple(r) for r in out["hidden"].collect()) == [("birthday", 9, 0), ("phone", 9, 0)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "email string, v double, g string")
    found = {r.field: r.sensitive for r in context.sensitive_columns(df, specs_of(df)).collect()}
    assert found == {"email": True, "v": False, "g": False}
    for kind in ("bar", "line"):
        assert views.series_matrix(df, views.View(kind, "email", "v", group="g")).count() == 0


def test_last_by_one_key(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", None, 9.0), ("b", None, 3.0), ("b", None, None)], "k string, i int, v double")
    out = ops.aggregate(df, ["k"], ["v"], "last", order_by=["i"])
    assert {r.k: r.v for r in out.collect()} == {"a": 5.0, "b": 3.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
