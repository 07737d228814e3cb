"""The narrowing quantiles against numpy, with brackets forced to be small."""

import numpy as np
import pytest

from tabwright.functions import quantiles as q
from tabwright.plans import stats
from tabwright.scale import few_rows
from tests.conftest import mapped

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def narrow(df, keys, accuracy):
    return q.quantiles(df, keys, {"x": "v", "y": "w"}, PROBS, "narrow", ["count(*) AS rows"], accuracy)


def check(found, values):
    assert found["n"] == len(values)
    if values:
        assert np.allclose(found["q"], np.quantile(values, PROBS), rtol=1e-12, atol=1e-12)
    else:
        assert found["q"] is None


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
@pytest.mark.parametrize("shape", ["uniform", "heavy", "ties", "constant", "signed_powers"])
def test_whole_table(spark, accuracy, shape):
    rng = np.random.default_rng(7)
    n = 3001
    values = {
        "uniform": rng.random(n),
        "heavy": rng.pareto(0.5, n),
        "ties": rng.integers(0, 5, n).astype(float),
        "constant": np.full(n, 3.5),
        "signed_powers": rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n),
    }[shape]
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(values)], "v double, w double").repartition(5)
    row = narrow(df, [], accuracy).first()
    assert row["rows"] == n
    check(row["x"], list(values))
    check(row["y"], [float(i) for i in range(n)])


def test_a_hot_group_and_many_small_ones(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v), None) for v in rng.normal(size=4000)]
    rows += [(f"k{i % 300}", float(v), 1.0) for i, v in enumerate(rng.normal(size=2000))]
    rows += [("empty", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    found = {r["k"]: r for r in narrow(df, ["k"], 50).collect()}
    groups = {}
    for k, v, _ in rows:
        groups.setdefault(k, []).extend([] if v is None else [v])
    assert set(found) == set(groups)
    for k, values in groups.items():
        check(found[k]["x"], values)


def test_wide_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(q, "is_light", lambda df: False)
    df = spark.range(5000).selectExpr("string(id % 3) AS k", "double(id) AS v", "double(id % 7) AS w")
    found = mapped(narrow(df, ["k"], 50), "k", "x")
    for k in range(3):
        check(found[str(k)], [float(i) for i in range(5000) if i % 3 == k])


def test_the_sketch_drops_nearly_all_rows(spark):
    """Rows far from the wanted quantile never leave their task as values."""
    df = spark.range(200_000).selectExpr("double(id) AS v")
    sketches = q._sketches(df, [], {"x": "v"}, [0.5], [], 10_000)
    b = q._brackets(sketches, [], ["x"], [0.5], 10_000).first()
    assert b["_hi"] - b["_lo"] < 200_000 * 12 / 10_000


def test_methods(spark):
    df = spark.range(101).selectExpr("double(id) AS v", "double(id) AS w")
    assert q.quantiles(df, [], {"x": "v"}, [0.5], "one_pass").first()["x"]["q"] == [50.0]
    assert abs(q.quantiles(df, [], {"x": "v"}, [0.5], "approx").first()["x"]["q"][0] - 50) <= 1
    assert q.resolve_method(spark.range(10).selectExpr("double(id) AS v"), "auto") == "one_pass"
    with pytest.raises(ValueError):
        q.quantiles(df, [], {"x": "v"}, [0.5], "guess")


def test_counted_rows_decide(spark):
    df = spark.range(10).selectExpr("explode(sequence(0, 9)) AS v").selectExpr("double(v) AS v")
    assert q.resolve_method(df, "auto") == "one_pass"
    assert few_rows(df, 100) and not few_rows(df, 99)


def test_a_small_file_of_many_rows_is_narrowed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1_000_001).selectExpr("double(id) AS v").write.parquet(path)
    assert q.resolve_method(spark.read.parquet(path), "auto") == "narrow"


def counted_selection(monkeypatch):
    """Count the rounds of the selection by the eager steps it takes."""
    steps = []
    real = q._meet
    monkeypatch.setattr(q, "_meet", lambda *a: steps.append(1) or real(*a))
    return steps


@pytest.mark.parametrize("shape", ["steps", "cluster", "signs", "tiny"])
def test_uneven_density_is_narrowed_in_few_rounds(spark, monkeypatch, shape):
    """A bracket whose values lie a million times denser in places: no task ranks more than a few."""
    monkeypatch.setattr(q, "BIN_VALUES", 20)
    steps = counted_selection(monkeypatch)
    rng = np.random.default_rng(11)
    values = {
        "steps": np.concatenate([10.0**6 * k + rng.random(400) * 10.0**-k for k in range(8)]),
        "cluster": np.concatenate([[-1e18, 1e18], 5 + rng.random(3000) * 1e-9, rng.random(300) * 1e12]),
        "signs": np.concatenate([-(10.0 ** rng.uniform(-12, 12, 1500)), [0.0] * 50, 10.0 ** rng.uniform(-12, 12, 1500)]),
        "tiny": np.concatenate([np.arange(2000) * 5e-324, 10.0 ** rng.uniform(-300, 300, 1000)]),
    }[shape]
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "v double, w double")
    row = narrow(df, [], 20).first()
    check(row["x"], list(values))
    check(row["y"], list(-values))
    assert len(steps) <= 12


def test_a_bracket_that_misses_is_opened(spark, monkeypatch):
    """With no margin the sketch of a coarse accuracy misses ranks; the result is exact all the same."""
    monkeypatch.setattr(q, "MARGIN", 0.0)
    rng = np.random.default_rng(5)
    values = rng.normal(size=4000)
    df = spark.createDataFrame([(f"k{i % 2}", float(v), 1.0) for i, v in enumerate(values)], "k string, v double, w double").repartition(7)
    for keys in ([], ["k"]):
        found = narrow(df, keys, 10).collect()
        for r in found:
            check(r["x"], [v for i, v in enumerate(values) if not keys or f"k{i % 2}" == r["k"]])


def test_both_ways_agree_on_the_same_rows(spark):
    df = spark.range(60_000).selectExpr("string(id % 2 * id % 5) AS k", "double(id * 7919 % 60007) AS v", "double(id % 11) AS w")
    one = {r["k"]: r for r in q.quantiles(df, ["k"], {"x": "v", "y": "w"}, PROBS, "one_pass").collect()}
    two = {r["k"]: r for r in q.quantiles(df, ["k"], {"x": "v", "y": "w"}, PROBS, "narrow", accuracy=100).collect()}
    assert one == two
