"""Statistics, trends, status, insights, views, samples and tasks."""

import math

import pytest
from pyspark.sql import functions as F

from tabwright.columns import number, text_sql
from tabwright.fields import FieldSpec, specs_of, split_roles
from tabwright.plans import context, insights, shared, stats, tasks, trends, views
from tabwright.plans.views import View
from tabwright.sources import with_row_id
from tests.conftest import mapped, rows_of

SALES_SPECS = [
    FieldSpec("日期", "date", "time", "date"),
    FieldSpec("客户", "string", "dimension"),
    FieldSpec("金额", "number", "metric", "currency"),
    FieldSpec("转化率", "number", "metric", "percentage"),
    FieldSpec("运营状态", "string", "status"),
]


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        (f"2026-07-{i:02d}", "ABC"[i % 3], 100.0 * i, i / 10, "预警" if i in (3, 6, 9) else "正常")
        for i in range(1, 11)
    ]
    df = spark.createDataFrame(rows, "`日期` string, `客户` string, `金额` double, `转化率` double, `运营状态` string")
    return df.withColumn("日期", F.col("日期").cast("date")).cache()


def test_numeric_stats(sales):
    s = rows_of(stats.numeric_stats(sales, ["金额"]))[0]
    assert (s["count"], s["sum"], s["avg"], s["median"], s["p25"], s["p75"]) == (10, 5500, 550, 550, 325, 775)
    assert math.isclose(s["std"], 302.7650354097492)


def test_stats_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(None, 5.0), ("x", None)], "a string, b double")
    s = {r["field"]: r for r in rows_of(stats.numeric_stats(df, ["a", "b"]))}
    assert s["a"]["count"] == 0 and s["a"]["nullCount"] == 2 and s["a"]["median"] == 0 and s["a"]["nullRate"] == 1
    assert s["b"]["count"] == 1 and s["b"]["std"] == 0
    assert rows_of(stats.missingness(stats.numeric_stats(df, ["a", "b"])))[0]["field"] == "a"
    empty = rows_of(stats.numeric_stats(df.filter("b > 9"), ["b"]))[0]
    assert empty["count"] == 0 and empty["nullRate"] == 0


def test_categories(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2 + [("d",), (None,), ("",)], "k string")
    c = rows_of(stats.category_stats(df, ["k"]))[0]
    assert (c["distinctCount"], c["nullCount"], c["total"]) == (4, 2, 13)
    assert math.isclose(c["longTailRate"], 1 / 11) and c["lowCardinality"]
    top = rows_of(stats.category_values(df, ["k"], top=2, bottom=1).orderBy("side", "rank"))
    assert [(r["side"], r["value"], r["count"]) for r in top] == [("bottom", "d", 1), ("top", "a", 5), ("top", "b", 3)]
    nothing = rows_of(stats.category_stats(df.filter("k IS NULL"), ["k"]))[0]
    assert nothing["distinctCount"] == 0 and nothing["longTailRate"] == 1


def test_top_values_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("string(id) AS k")
    plan = stats.category_values(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_outliers(spark):
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 100, -90])], "v double, at int")
    assert rows_of(stats.outliers(df, ["v"]))[0]["outlierCount"] == 2
    assert [r["direction"] for r in rows_of(stats.outlier_samples(df, ["v"], ["at"]))] == ["upper", "lower"]
    few = rows_of(stats.outliers(df.filter("at < 5"), ["v"]))[0]
    assert not few["detected"] and few["lowerBound"] == 0 and few["outlierCount"] == 0


def test_trends(sales):
    out = rows_of(trends.trends(sales, "日期", SALES_SPECS[2:4]))
    assert len(out) == 20 and {r["grain"] for r in out} == {"day"}
    change = {r["field"]: r for r in rows_of(trends.trend_changes(trends.trends(sales, "日期", SALES_SPECS[2:4])))}
    assert change["金额"]["absoluteChange"] == 900 and change["金额"]["changeRate"] == 9


@pytest.mark.parametrize("last, grain", [("2026-02-01", "day"), ("2026-02-02", "week"), ("2027-01-01", "week"), ("2027-01-02", "month")])
def test_grain_follows_the_span(spark, last, grain):
    df = spark.createDataFrame([("2026-01-01", 1.0), (last, 2.0), ("2030-01-01", None)], "d string, v double")
    assert {r["grain"] for r in rows_of(trends.trends(df, "d", [FieldSpec("v", "number", "metric")]))} == {grain}


def test_one_period_and_zero_start(spark):
    spec = [FieldSpec("v", "number", "metric")]
    one = spark.createDataFrame([("2026-01-01", 5.0)], "d string, v double")
    change = rows_of(trends.trend_changes(trends.trends(one, "d", spec)))[0]
    assert change["first"] == 5 and change["absoluteChange"] is None and change["changeRate"] is None
    zero = spark.createDataFrame([("2026-01-01", 0.0), ("2026-01-02", 5.0)], "d string, v double")
    change = rows_of(trends.trend_changes(trends.trends(zero, "d", spec)))[0]
    assert change["absoluteChange"] == 5 and change["changeRate"] is None


def test_comparisons(sales):
    top = trends.top_groups(trends.comparisons(sales, "客户", SALES_SPECS[2:4]))
    values = {(r["field"], r["label"]): r["value"] for r in rows_of(top)}
    assert values[("金额", "B")] == 2200 and math.isclose(values[("转化率", "A")], 0.6)
    gap = {r["field"]: r for r in rows_of(trends.group_gaps(top))}
    assert gap["金额"]["topLabel"] == "B" and math.isclose(gap["金额"]["ratio"], 2200 / 1500)


def test_status(sales):
    s = rows_of(trends.status_summary(sales, "运营状态", "金额"))[0]
    assert (s["total"], s["warnCount"], s["warnRate"]) == (10, 3, 0.3)
    assert s["warnAvg"] == 600 and math.isclose(s["diff"], 600 - 3700 / 7)
    none = rows_of(trends.status_summary(sales.filter("`金额` > 950"), "运营状态", "金额"))[0]
    assert none["warnCount"] == 0 and none["warnAvg"] == 0


def test_report(sales):
    parts = insights.report(sales, SALES_SPECS, original_rows=20)
    assert {"stats", "outliers", "categories", "category_values", "trends", "comparisons", "status:运营状态", "insights"} == set(parts)
    found = {(r["kind"], ",".join(r["fields"])): r for r in rows_of(parts["insights"])}
    assert found[("trend", "金额,日期")]["level"] == "warning"
    assert found[("group_gap", "金额,客户")]["level"] == "info"
    assert found[("warning_share", "运营状态")]["level"] == "warning"
    assert found[("top_value", "运营状态")]["label"] == "正常"
    assert found[("truncated", "")]["count"] == 10
    assert ("duplicate_rows", "") not in found and ("long_tail", "运营状态") not in found


def test_report_of_a_table_without_roles(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    found = rows_of(insights.insights(df, [FieldSpec("k", role="ignored")]))
    assert [r["kind"] for r in found] == ["duplicate_rows"]


def test_roles_split():
    split = split_roles([*SALES_SPECS, FieldSpec("x", role="ignored"), FieldSpec("y", "number", "metric", include=False)])
    assert split.time.name == "日期" and split.dimension.name == "客户" and len(split.metrics) == 2
    assert [s.name for s in split.ignored] == ["x"]


def test_series_matrix(spark):
    df = spark.createDataFrame([("b", "s", 1.0), ("a", "t", 5.0), ("a", None, 2.0), (None, "s", 9.0), ("b", "s", None)], "x string, g string, v double")
    grid = {(r["x"], r["series"]): r["value"] for r in rows_of(views.series_matrix(df, View("line", "x", "v", group="g")))}
    assert grid == {("a", "s"): 0, ("a", "t"): 5, ("a", "其他"): 2, ("b", "s"): 1, ("b", "t"): 0, ("b", "其他"): 0}
    bars = rows_of(views.series_matrix(df, View("bar", "x", "v", limit=1)))
    assert [(r["x"], r["value"]) for r in bars] == [("a", 7.0)]
    counts = rows_of(views.series_matrix(df, View("line", "x", views.COUNT, "count")))
    assert [(r["x"], r["value"]) for r in counts] == [("a", 2.0), ("b", 2.0)]


def test_recommended_views(sales):
    chosen = views.recommend(sales, SALES_SPECS)
    assert [v.type for v in chosen] == ["line", "line", "bar", "bar", "pie", "table"]
    assert chosen[1].aggregation == "avg" and len(views.recommend(sales, SALES_SPECS, most=3)) == 3
    assert views.view_data(sales, chosen[-1]).count() == 10


def test_view_guards(spark):
    df = spark.range(12).selectExpr("string(id) AS k", "double(id) AS v", "double(id) AS r", "id")
    specs = [FieldSpec("k"), FieldSpec("v", "number", "metric"), FieldSpec("r", "number", "metric", "percentage"), FieldSpec("id", "number", "identifier")]
    asked = [
        View("table", "k", views.ROWS), View("pie", "k", views.COUNT, "count"), View("line", "k", "k"),
        View("bar", "k", "r", "sum"), View("bar", "k", "id"), View("bar", "nope", "v"), View("bar", "k", "v"),
    ]
    good, problems = views.usable_views(df, asked, specs)
    assert [(v.type, v.limit) for v in good] == [("bar", 10), ("bar", 10), ("table", None)] and len(problems) == 5


def test_kpi_scatter_heatmap(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2), ("b", "y", None, 3)], "p string, q string, v double, n int")
    assert rows_of(views.kpi(df.orderBy("p"), "v")) == [{"value": 1.0}]
    scalar = df.agg(F.max("n").alias("m"))
    assert rows_of(views.kpi(df, "v", scalar)) == [{"value": 3.0}]
    assert rows_of(views.scatter(df)) == [{"x": 1.0, "y": 2.0}]
    cells = views.heatmap(df, "p", "q", "v")
    assert mapped(cells, "x", "value") == {"a": 1.0, "b": 0.0} and rows_of(views.heatmap_max(cells)) == [{"max": 1.0}]
    with pytest.raises(ValueError):
        views.scatter(df.select("p"))


def context_table(spark, n):
    cities, names = ["南宁", "柳州", "桂林", "玉林"], ["张三", "李四", "王五", "赵六", "钱七"]
    rows = [(cities[i % 4], 1000.0 + (i % 7) * 200, names[i % 5], i + 1) for i in range(n)]
    return with_row_id(spark.createDataFrame(rows, "`地市` string, `业务收入` double, `客户姓名` string, seq int").coalesce(1))


def test_samples(spark):
    big, small = context_table(spark, 300), context_table(spark, 10)
    sample = rows_of(context.stable_sample(big, ["地市"]))
    seqs = {r["seq"] for r in sample}
    assert len(sample) <= 40 and {1, 300, 150} <= seqs and sample == rows_of(context.stable_sample(big, ["地市"]))
    assert context.stable_sample(small).count() == 10
    rare = big.withColumn("类别", F.concat(F.lit("c"), F.floor(F.col("seq") / 51).cast("string")))
    assert {r["类别"] for r in rows_of(context.stable_sample(rare, ["类别"]))} == {f"c{i}" for i in range(6)}


def test_fingerprint(spark):
    df = context_table(spark, 200)
    same = context.fingerprint(df.orderBy(F.desc("seq"))).first()[0]
    changed = df.withColumn("业务收入", F.when(F.col("seq") == 138, 999999.0).otherwise(F.col("业务收入")))
    assert context.fingerprint(df).first()[0] == same != context.fingerprint(changed).first()[0]
    a = spark.createDataFrame([("x", None)], "p string, q string")
    b = spark.createDataFrame([(None, "x")], "p string, q string")
    assert context.fingerprint(a).first()[0] != context.fingerprint(b).first()[0]


def test_sensitive_columns(spark):
    rows = [("13812345678", "a@b.com", "13812345678", "x")] * 2 + [("13900001111", "c@d.com", "no", "y")]
    rows += [(None, "", "no", "z")]
    df = spark.createDataFrame(rows, "p string, m string, half string, `客户姓名` string")
    assert context.sensitive_names(df, specs_of(df)) == ["m", "p", "客户姓名"]
    by_role = context.sensitive_names(df, specs_of(df, {"half": {"role": "identifier"}}))
    assert "half" in by_role


def test_context_leaks_nothing(spark):
    df = context_table(spark, 60)
    parts = context.table_context(df, specs_of(df.drop("_row_id")))
    shown = " ".join(str(r) for p in parts.values() for r in p.collect())
    assert "南宁" in shown and not any(n in shown for n in ("张三", "李四", "王五"))
    assert {"sample", "boundary", "values", "numbers", "fingerprint"} <= set(parts)
    assert "sample" not in context.table_context(df, specs_of(df.drop("_row_id")), row_samples=False)


def test_boundary_rows(spark):
    df = context_table(spark, 14)
    edges = {r["edge"]: r["value"] for r in rows_of(context.boundary_rows(df, ["业务收入"]))}
    assert edges == {"min": 1000, "max": 2200, "p25": 1200, "p75": 2000}


TASK = {"id": "a", "operator": "aggregate", "dimensions": ["地市"], "metrics": ["业务收入"]}


def test_tasks(kpi):
    more = [
        TASK,
        {"id": "b", "operator": "timeseries", "metrics": ["业务收入"], "time": {"field": "月份", "grain": "month"}, "dependsOn": ["a"]},
        {"id": "c", "operator": "nope"},
        {"id": "d", "operator": "profile", "dependsOn": ["c"]},
        {"id": "e", "operator": "profile", "dependsOn": ["f"]},
        {"id": "f", "operator": "profile", "dependsOn": ["e"]},
        {"id": "g", "operator": "profile", "dependsOn": ["missing"]},
        {"id": "h", "operator": "timeseries", "metrics": ["业务收入"], "time": {"field": "月份"}, "limit": 3},
    ]
    out = tasks.run_tasks(kpi, more)
    assert {k: o.status for k, o in out.items()} == {
        "a": "ready", "b": "ready", "c": "failed", "d": "skipped", "e": "skipped", "f": "skipped",
        "g": "skipped", "h": "failed",
    }
    assert out["b"].rows.count() == 4 and "nope" in out["c"].reason


@pytest.mark.parametrize(
    "task",
    [
        {"operator": "profile", "metrics": ["业务收入"]},
        {"operator": "compare", "dimensions": ["地市"], "metrics": ["业务收入", "目标收入"], "compareMode": "rate"},
        {"operator": "distribution", "dimensions": ["地市"]},
        {"operator": "ranking", "dimensions": ["地市"], "metrics": ["业务收入"], "aggregation": "sum", "sort": {"field": "业务收入", "direction": "desc"}},
        {"operator": "growth", "metrics": ["业务收入"], "time": {"field": "月份", "grain": "month"}},
        {"operator": "correlation", "metrics": ["业务收入", "用户数"]},
        {"operator": "anomaly", "metrics": ["业务收入"], "anomalyMethod": "zscore"},
        {"operator": "pivot", "dimensions": ["地市", "月份"], "metrics": ["业务收入"]},
        {"operator": "ratio", "formula": {"outputField": "x", "expression": {"op": "field", "field": "业务收入"}}},
    ],
)
def test_every_operator_runs_as_a_task_with_evidence(kpi, task):
    task = {"id": "t", **task}
    assert tasks.run_task(kpi, task, order_by=["seq"]).columns
    e = rows_of(tasks.evidence(kpi, task, order_by=["seq"]))[0]
    assert e["operator"] == task["operator"] and e["sampleSize"] == 8 and len(e["resultHash"]) == 64


def test_task_checks_the_field_rules(kpi):
    specs = [FieldSpec("满意度", "number", "metric", "percentage")]
    bad = {"id": "t", "operator": "aggregate", "metrics": ["满意度"], "aggregation": "sum"}
    with pytest.raises(ValueError, match="满意度"):
        tasks.run_task(kpi, bad, specs)


def test_result_hash_ignores_order_but_not_values(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "i int, s string")
    h = [tasks.result_hash(d).first()[0] for d in (a, b, c)]
    assert h[0] == h[1] != h[2]


def test_number_read_of_texts(spark):
    df = spark.createDataFrame([(" 12 ",), ("1e3",), ("12d",), ("NaN",), ("",), ("0x1",)], "v string")
    assert [r[0] for r in df.select(number(df, "v")).collect()] == [12.0, 1000.0, None, None, None, None]
    assert text_sql("a'b\\c") == "'a\\'b\\\\c'"


def test_task_lists_share_a_scan(spark, kpi, tmp_path):
    """Rows equal single runs, and the table's files are read once for all grouped tasks."""
    path = str(tmp_path / "kpi")
    kpi.write.parquet(path)
    df = spark.read.parquet(path)
    rev, tgt, month, city = "业务收入", "目标收入", "月份", "地市"
    half = {"op": "divide", "left": {"op": "field", "field": rev}, "right": {"op": "field", "field": tgt}}
    over = [{"field": rev, "operator": "gt", "value": 900}]
    wanted = [
        {"id": "a", "operator": "aggregate", "dimensions": [city], "metrics": [rev, tgt], "aggregation": "avg"},
        {"id": "b", "operator": "aggregate", "metrics": [rev], "filters": over},
        {"id": "c", "operator": "compare", "dimensions": [month, city], "metrics": [rev, tgt], "compareMode": "rate"},
        {"id": "d", "operator": "ranking", "dimensions": [month], "metrics": [tgt], "aggregation": "max",
         "sort": {"field": tgt, "direction": "desc"}, "limit": 2, "filters": over},
        {"id": "e", "operator": "timeseries", "metrics": [rev, tgt], "time": {"field": month, "grain": "quarter"}},
        {"id": "f", "operator": "growth", "metrics": [rev], "time": {"field": month}},
        {"id": "g", "operator": "ratio", "dimensions": [city], "formula": {"outputField": "x", "expression": half}},
        {"id": "h", "operator": "pivot", "dimensions": [city, month], "metrics": [rev], "filters": over},
        {"id": "i", "operator": "aggregate", "dimensions": [city], "metrics": [rev], "aggregation": "count",
         "filters": [{"field": rev, "operator": "gt", "value": 10**9}]},
        {"id": "bad", "operator": "aggregate", "metrics": ["nope"]},
    ]
    groups = {t["id"]: shared.groups_of(df, t) for t in wanted[:-1]}
    assert None not in groups.values()
    found = shared.shared_groups(df, groups)
    assert found["i"].collect() == []
    out = tasks.run_tasks(df, wanted)
    for t in wanted[:-1]:
        assert sorted(map(str, rows_of(out[t["id"]].rows))) == sorted(map(str, rows_of(tasks.run_task(df, t)))), t["id"]
    assert out["bad"].status == "failed"
    assert shared.groups_of(df, {**wanted[0], "aggregation": "median"}) is None
    # nothing that is left to do reads the table's files
    assert not any(path in f for o in out.values() if o.rows is not None for f in o.rows.inputFiles())


def test_the_sample_covers_values_with_few_rows(spark):
    """Six fields of eight values: a value of each field is shown by each of eight rows somewhere in the middle."""
    fields = [f"f{i}" for i in range(6)]
    cells = [f"CASE WHEN id BETWEEN 700 AND 707 THEN string((id + {i}) % 8) WHEN id = {100 + i} THEN string(id % 8) ELSE '0' END AS f{i}" for i in range(6)]
    df = spark.range(2000).selectExpr("id AS _row_id", *cells)
    sample = context.stable_sample(df, fields)
    assert sample.count() <= 40
    assert all(r["shown"] == r["values"] == 8 for r in rows_of(context.sample_coverage(df, sample, fields)))


def test_greedy_coverage_equals_a_plain_program(spark, monkeypatch):
    import random

    random.seed(4)
    rows = [(i, str(random.randrange(9)), str(random.randrange(30)), random.choice(["", "a", "b"])) for i in range(400)]
    df = spark.createDataFrame(rows, "_row_id long, a string, b string, c string")
    seen, want = {("c", ""), ("a", rows[5][1]), ("b", rows[5][2]), ("c", rows[5][3])}, []
    while len(want) < 25:
        best = max(rows, key=lambda r: (len({("a", r[1]), ("b", r[2]), ("c", r[3])} - seen), -r[0]))
        new = {("a", best[1]), ("b", best[2]), ("c", best[3])} - seen
        if not new:
            break
        want.append(best[0])
        seen |= new
    for fetched in (3, 1000):
        monkeypatch.setattr(context, "CANDIDATES", fetched)
        assert context.category_ids(df, ["a", "b", "c"], most=25, shown=[5]) == want


def test_many_series_fill_a_grid(spark):
    """Over eleven thousand series, more than a pivot takes."""
    df = spark.range(11_500).selectExpr("string(id) AS g", "string(id % 2) AS x", "double(id) AS v")
    grid = views.series_matrix(df, View("bar", "x", "v", group="g"))
    assert grid.count() == 23_000 and grid.filter("value <> 0").count() == 11_499
    few = rows_of(views.series_matrix(df, View("bar", "x", "v", "avg", group="g", max_series=2)))
    others = {r["x"]: r["value"] for r in few if r["series"] == views.OTHER}
    assert others == {"0": (2 * sum(range(0, 5749))) / 5749, "1": sum(range(1, 11_498, 2)) / 5749}
    assert {r["series"] for r in few} == {"11499", "11498", views.OTHER}


def test_fingerprints_of_growing_files(spark, tmp_path):
    path, states = str(tmp_path / "t"), str(tmp_path / "states")
    first = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "i int, s string, d double")
    first.write.parquet(path)
    one = context.growing_fingerprint(spark, path, states).first()
    assert one == context.fingerprint(first).first()
    known = spark.read.parquet(states).count()
    assert context.growing_fingerprint(spark, path, states).first() == one and spark.read.parquet(states).count() == known
    more = spark.createDataFrame([(2, None, None)], first.schema)
    more.coalesce(1).write.mode("append").parquet(path)
    two = context.growing_fingerprint(spark, path, states).first()
    assert two == context.fingerprint(first.union(more)).first() != one
    assert spark.read.parquet(states).count() == known + 1
    spark.read.parquet(path).limit(0).coalesce(1).write.mode("overwrite").parquet(path)
    assert context.growing_fingerprint(spark, path, states).first() == context.fingerprint(first.limit(0)).first()
    shifted = spark.createDataFrame([("a", "b1:c"), ("ab", "1:c")], "p string, q string")
    assert context.fingerprint(shifted.limit(1)).first() != context.fingerprint(shifted.filter("p = 'ab'")).first()


def scanned_rows(df):
    """Rows that the scan of an executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_laid_out_table_is_read_in_part(spark, tmp_path):
    from tabwright.functions.predicates import apply_filters
    from tabwright.sources import read_table, save_table

    df = spark.range(40_000).selectExpr("id * 7919 % 40000 AS v", "hash(id) AS h", "'x' AS same")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is too small for several files
    save_table(df, str(tmp_path / "t"), cluster_by=["v"], lookup=["h"])
    kept = read_table(spark, str(tmp_path / "t"))
    between = apply_filters(kept, [{"field": "v", "operator": "between", "value": [100, 900]}])
    assert between.count() == 801
    assert scanned_rows(between) <= 10_500
    # an equal value of the column without an order is in one file, and the others' Bloom filters say so
    one = apply_filters(kept, [{"field": "h", "operator": "eq", "value": kept.first()["h"]}])
    assert one.count() == 1
    assert scanned_rows(one) <= 20_500
    # a single value is dealt over several ranges
    save_table(df, str(tmp_path / "u"), cluster_by=["same"])
    assert len(read_table(spark, str(tmp_path / "u")).inputFiles()) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
