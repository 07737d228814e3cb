"""Golden numbers of the KPI table, and the rules around them."""

import math

import pytest
from pyspark.sql import functions as F

from tabwright import operators as ops
from tabwright.fields import FieldSpec
from tests.conftest import KPI_SCHEMA, mapped, rows_of

REVENUE, TARGET, USERS, RATE, CITY, MONTH = (
    "业务收入", "目标收入", "用户数", "满意度", "地市", "月份",
)
DIVIDE = {
    "op": "divide",
    "left": {"op": "field", "field": REVENUE},
    "right": {"op": "field", "field": TARGET},
}


def agg(df, how, **more):
    return mapped(ops.aggregate(df, [CITY], [REVENUE], how, **more), CITY, REVENUE)


class TestAggregate:
    def test_sum(self, kpi):
        assert agg(kpi, "sum") == {"南宁": 4600, "柳州": 3630}

    @pytest.mark.parametrize("method", ["one_pass", "narrow"])
    def test_avg_and_median(self, kpi, method):
        assert agg(kpi, "avg")["南宁"] == 1150
        assert agg(kpi, "median", quantile_method=method) == {"南宁": 1150, "柳州": 925}

    def test_last_follows_the_given_order(self, kpi):
        assert agg(kpi, "last", order_by=["seq"])["南宁"] == 1300
        with pytest.raises(ValueError, match="order_by"):
            agg(kpi, "last")

    def test_count_counts_numbers(self, kpi):
        out = ops.aggregate(kpi, [], [CITY, REVENUE], "count")
        assert rows_of(out) == [{CITY: 0, REVENUE: 8}]

    def test_missing_values_are_skipped(self, spark):
        df = spark.createDataFrame([("x", "100"), ("x", None), ("x", ""), ("x", "300")], "k string, v string")
        assert rows_of(ops.aggregate(df, ["k"], ["v"])) == [{"k": "x", "v": 400.0}]

    def test_last_skips_a_missing_last_row(self, spark):
        df = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 2), ("x", None, 3)], "k string, v double, at int")
        assert rows_of(ops.aggregate(df, ["k"], ["v"], "last", order_by=["at"]))[0]["v"] == 2.0

    @pytest.mark.parametrize("how", ["sum", "avg", "min", "max", "median", "count"])
    def test_an_aggregate_of_nothing_is_zero(self, spark, how):
        df = spark.createDataFrame([("x", None)], "k string, v double")
        assert rows_of(ops.aggregate(df, ["k"], ["v"], how)) == [{"k": "x", "v": 0}]

    def test_no_rows_give_no_groups(self, kpi):
        none = [{"field": REVENUE, "operator": "gt", "value": 1e9}]
        assert ops.aggregate(kpi, [], [REVENUE], filters=none).count() == 0
        assert ops.aggregate(kpi, [CITY], [REVENUE], filters=none).count() == 0

    def test_null_and_empty_share_a_group(self, spark):
        df = spark.createDataFrame([(None, 1.0), ("", 2.0), ("a", 4.0)], "k string, v double")
        assert mapped(ops.aggregate(df, ["k"], ["v"]), "k", "v") == {"": 3.0, "a": 4.0}

    def test_number_keys_become_plain_text(self, spark):
        df = spark.createDataFrame([(1.0, 1.0), (2.5, 1.0), (None, 1.0), (1e7, 1.0)], "k double, v double")
        assert set(mapped(ops.aggregate(df, ["k"], ["v"]), "k", "v")) == {"1", "2.5", "", "10000000"}

    def test_sort_puts_missing_last_both_ways(self, spark):
        df = spark.createDataFrame([("b", 1.0), ("", 9.0), ("a", 2.0)], "k string, v double")
        for direction, first in (("asc", "a"), ("desc", "b")):
            out = rows_of(ops.aggregate(df, ["k"], ["v"], sort={"field": "k", "direction": direction}))
            assert out[0]["k"] == first and out[-1]["k"] == ""

    @pytest.mark.parametrize(
        "args",
        [
            ([CITY, MONTH, REVENUE, TARGET], [USERS]),
            ([CITY], []),
            ([CITY], [REVENUE] * 6),
            (["nope"], [REVENUE]),
            ([CITY], ["nope"]),
        ],
    )
    def test_bad_arguments(self, kpi, args):
        with pytest.raises(ValueError):
            ops.aggregate(kpi, *args)
        with pytest.raises(ValueError):
            ops.aggregate(kpi, [CITY], [REVENUE], "mode")


class TestTime:
    def test_month_and_year(self, kpi):
        assert mapped(ops.timeseries(kpi, MONTH, [REVENUE]), MONTH, REVENUE)["2025-01"] == 1800
        assert rows_of(ops.timeseries(kpi, MONTH, [REVENUE], "year")) == [{MONTH: "2025", REVENUE: 8230}]

    def test_behavior_decides_the_aggregate(self, kpi):
        specs = [
            FieldSpec(USERS, "number", "metric", behavior="stock"),
            FieldSpec(RATE, "number", "metric", behavior="rate"),
        ]
        out = rows_of(ops.timeseries(kpi, MONTH, [USERS, RATE], specs=specs, order_by=["seq"]))
        assert out[0][USERS] == 80
        assert math.isclose(out[0][RATE], 0.875)

    def test_unreadable_dates_go_and_empty_buckets_stay(self, spark):
        df = spark.createDataFrame(
            [("2026-07-01", 1.0), ("soon", 5.0), (None, 5.0), ("2026/8/3", None)], "d string, v double"
        )
        assert rows_of(ops.timeseries(df, "d", ["v"])) == [
            {"d": "2026-07", "v": 1.0}, {"d": "2026-08", "v": 0.0},
        ]

    def test_iso_week(self, spark):
        df = spark.createDataFrame([("2027-01-01", 1.0), ("2024-12-30", 1.0)], "d string, v double")
        assert set(mapped(ops.timeseries(df, "d", ["v"], "week"), "d", "v")) == {"2026-W53", "2025-W01"}

    def test_growth(self, kpi):
        out = rows_of(ops.growth(kpi, MONTH, REVENUE))
        assert out[0]["change"] is None and out[0]["growthRate"] is None
        assert out[1]["change"] == 200 and math.isclose(out[1]["growthRate"], 200 / 1800)

    def test_growth_after_zero_and_over_a_gap(self, spark):
        df = spark.createDataFrame([("2026-01", 0.0), ("2026-02", None), ("2026-05", 500.0)], "d string, v double")
        out = rows_of(ops.growth(df, "d", "v"))
        assert [r["d"] for r in out] == ["2026-01", "2026-05"]
        assert out[1]["change"] == 500 and out[1]["growthRate"] is None

    def test_growth_from_a_negative_value(self, spark):
        df = spark.createDataFrame([("2026-01", -100.0), ("2026-02", -50.0)], "d string, v double")
        assert rows_of(ops.growth(df, "d", "v"))[1]["growthRate"] == 0.5

    def test_bad_grain_and_mode(self, kpi):
        with pytest.raises(ValueError):
            ops.timeseries(kpi, MONTH, [REVENUE], "hour")
        with pytest.raises(ValueError):
            ops.growth(kpi, MONTH, REVENUE, mode="ratio")


class TestCompareAndRanking:
    def test_rate_is_a_ratio_of_sums(self, kpi):
        out = mapped(ops.compare(kpi, [CITY], [REVENUE, TARGET], mode="rate"), CITY, f"{REVENUE}_比_{TARGET}")
        assert math.isclose(out["南宁"], 4600 / 4800)

    def test_difference_and_absolute(self, kpi):
        out = mapped(ops.compare(kpi, [CITY], [REVENUE, TARGET], mode="difference"), CITY, f"{REVENUE}_减_{TARGET}")
        assert out["南宁"] == -200
        assert ops.compare(kpi, [CITY], [REVENUE, TARGET], mode="absolute").columns == [CITY, REVENUE, TARGET]

    def test_rate_of_a_zero_target(self, spark):
        df = spark.createDataFrame([("x", 1.0, 0.0)], "k string, a double, t double")
        assert rows_of(ops.compare(df, ["k"], ["a", "t"], mode="rate"))[0]["a_比_t"] is None

    def test_ranking(self, kpi):
        out = rows_of(ops.ranking(kpi, [CITY], [REVENUE], "sum", {"field": REVENUE, "direction": "asc"}, 1))
        assert out == [{"rank": 1, CITY: "柳州", REVENUE: 3630.0}]

    def test_ties_get_different_ranks(self, spark):
        df = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "k string, v double")
        out = rows_of(ops.ranking(df, ["k"], ["v"], "sum", {"field": "v", "direction": "desc"}))
        assert [(r["rank"], r["k"]) for r in out] == [(1, "a"), (2, "b")]

    def test_ranking_needs_a_metric_sort(self, kpi):
        with pytest.raises(ValueError):
            ops.ranking(kpi, [CITY], [REVENUE], "sum", {"field": CITY, "direction": "asc"})


class TestDistribution:
    def test_classes(self, kpi):
        assert rows_of(ops.distribution(kpi, CITY)) == [
            {CITY: "南宁", "count": 4, "rate": 0.5}, {CITY: "柳州", "count": 4, "rate": 0.5},
        ]

    def test_missing_is_no_class(self, spark):
        df = spark.createDataFrame([("a",), ("",), (None,), ("a",), ("b",)], "k string")
        out = rows_of(ops.distribution(df, "k"))
        assert [(r["k"], r["count"]) for r in out] == [("a", 2), ("b", 1)]
        assert math.isclose(out[0]["rate"], 2 / 3)

    def test_bins(self, kpi):
        out = rows_of(ops.distribution(kpi, REVENUE, limit=4))
        assert len(out) == 4 and sum(r["count"] for r in out) == 8
        assert out[0]["lower"] == 800 and out[-1]["upper"] == 1300
        assert out[0][REVENUE] == "800.000 ≤ x < 925.000" and "≤ x ≤" in out[-1][REVENUE]

    def test_empty_bins_and_missing_values(self, spark):
        df = spark.createDataFrame([(0.0,), (None,), (10.0,), (0.5,)], "v double")
        out = rows_of(ops.distribution(df, "v"))
        assert [r["count"] for r in out] == [2, 0, 1]

    def test_one_value_is_one_bin(self, spark):
        df = spark.createDataFrame([(7.0,), (7.0,)], "v double")
        assert rows_of(ops.distribution(df, "v")) == [
            {"v": "7", "lower": 7.0, "upper": 7.0, "count": 2, "rate": 1.0}
        ]


class TestRatio:
    def test_mean_of_row_values(self, kpi):
        out = mapped(ops.ratio(kpi, DIVIDE, "x", [CITY]), CITY, "x")
        assert math.isclose(out["南宁"], 4600 / 4800)

    def test_zero_denominator(self, spark, kpi):
        zero = spark.createDataFrame([("2025-05", "南宁", 100.0, 0.0, 1.0, 0.5, 8)], KPI_SCHEMA)
        df = kpi.unionByName(zero)
        rows = rows_of(ops.ratio(df, DIVIDE, "x", order_by=["seq"]))
        assert len(rows) == 8 and all(r["x"] is not None for r in rows)
        assert rows_of(ops.ratio_scalar(df, DIVIDE, "x"))[0]["null_count"] == 1

    def test_scalar_is_the_mean_of_group_means(self, spark):
        df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 1.0), ("b", 8.0, 1.0)], "k string, n double, d double")
        f = {"op": "divide", "left": {"op": "field", "field": "n"}, "right": {"op": "field", "field": "d"}}
        assert rows_of(ops.ratio_scalar(df, f, "x", ["k"]))[0]["scalar"] == 5.0
        assert rows_of(ops.ratio_scalar(df, f, "x"))[0]["scalar"] == 4.0


class TestCorrelationAndAnomaly:
    def test_correlation(self, kpi):
        out = rows_of(ops.correlation(kpi, REVENUE, USERS))[0]
        assert out["sampleSize"] == 8 and 0.8 < out["pearson"] < 1

    def test_too_few_pairs_and_constant(self, kpi):
        few = rows_of(ops.correlation(kpi.filter("seq < 5"), REVENUE, USERS))[0]
        assert few["pearson"] is None and few["sampleSize"] == 5
        constant = kpi.withColumn(TARGET, F.lit(1000.0))
        assert rows_of(ops.correlation(constant, REVENUE, TARGET))[0]["pearson"] is None

    @pytest.mark.parametrize("method", ["one_pass", "narrow"])
    def test_iqr(self, spark, kpi, method):
        odd = spark.createDataFrame([("2025-05", "南宁", 50000.0, 1.0, 1.0, 0.5, 8)], KPI_SCHEMA)
        out = rows_of(ops.anomaly(kpi.unionByName(odd), REVENUE, quantile_method=method))
        assert [(r[REVENUE], r["_direction"]) for r in out] == [(50000.0, "upper")]

    def test_zscore(self, spark):
        values = [(100.0 + 5 * i,) for i in range(20)] + [(100000.0,)]
        df = spark.createDataFrame(values, "v double")
        assert [r["v"] for r in rows_of(ops.anomaly(df, "v", "zscore"))] == [100000.0]

    def test_limit_keeps_the_first_rows(self, spark):
        values = [(100.0 + 5 * i, i) for i in range(16)] + [(9000.0 + i, 16 + i) for i in range(4)]
        df = spark.createDataFrame(values, "v double, at int")
        assert [r["at"] for r in rows_of(ops.anomaly(df, "v", limit=3, order_by=["at"]))] == [16, 17, 18]
        assert ops.anomaly(df, "v", limit=None).count() == 4

    def test_too_few_values_or_no_spread(self, spark, kpi):
        assert ops.anomaly(kpi.filter("seq < 5"), REVENUE).count() == 0
        flat = spark.createDataFrame([(1.0,)] * 9, "v double")
        assert ops.anomaly(flat, "v", "zscore").count() == 0


class TestPivotAndProfile:
    def test_pivot(self, kpi):
        out = mapped(ops.pivot(kpi, [CITY, MONTH], [REVENUE]), CITY, f"{REVENUE}[2025-01]")
        assert out == {"南宁": 1000.0, "柳州": 800.0}

    def test_absent_cell_is_null(self, spark):
        df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", None)], "k string, c string, v double")
        assert rows_of(ops.pivot(df, ["k", "c"], ["v"])) == [
            {"k": "a", "v[x]": 1.0, "v[y]": None}, {"k": "b", "v[x]": None, "v[y]": None},
        ]

    def test_pivot_names_with_dots_and_several_metrics(self, spark):
        df = spark.createDataFrame([("a", "1.5", 1.0, 2.0)], "k string, c string, v double, w double")
        assert rows_of(ops.pivot(df, ["k", "c"], ["v", "w"])) == [{"k": "a", "v[1.5]": 1.0, "w[1.5]": 2.0}]

    def test_pivot_dimensions(self, kpi):
        with pytest.raises(ValueError):
            ops.pivot(kpi, [CITY], [REVENUE])

    @pytest.mark.parametrize("method", ["one_pass", "narrow"])
    def test_profile(self, kpi, method):
        out = {r["field"]: r for r in rows_of(ops.profile(kpi, [REVENUE, CITY], quantile_method=method))}
        assert out[REVENUE]["min"] == 800 and out[REVENUE]["max"] == 1300 and out[REVENUE]["median"] == 990
        assert out[REVENUE]["distinctCount"] == 8
        assert out[CITY]["distinctCount"] == 2 and out[CITY]["mean"] is None
