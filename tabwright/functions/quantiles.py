"""Exact quantiles, linear-interpolated, also where one group is huge.

Spark's ``percentile`` holds every distinct value of a group in one task. That
is fine while the whole input is small, and :func:`quantiles` uses it then, and
for groups that turn out to have few values. A bigger group is narrowed:

1. one aggregate with a bounded sketch (``percentile_approx``, combined on the
   map side) brackets each wanted quantile between two values;
2. one pass counts the rows below each bracket and collects (value, count)
   inside it. All rows below collapse into a single count before the shuffle,
   and equal values collapse too, so a hot group sends almost nothing;
3. the values of a bracket are cut into bins, and the bin that holds the wanted rank is
   found from the counts and cut again, until it has few values; only those are ranked.
   Bins are equal on a logarithmic scale first and on a linear one then, so a few
   rounds serve any density.

No task holds a big group, and the result is exact: the sketch only decides which
rows can be ignored, and a bracket that misses its rank is opened on both sides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.columns import INFINITY, inline_sql, quoted, struct_sql, text_sql
from tabwright.scale import few_rows, is_light, materialize

ACCURACY = 10_000
MARGIN = 4.0  # the bracket's half width in units of the sketch's error
BINS = 1024
BIN_VALUES = 50_000  # so many distinct values are ranked by one task
WIDE_RATIO = 65536.0  # beyond it bins are equal on a logarithmic scale
SALTS = 64
METHODS = ("auto", "one_pass", "narrow", "approx")


def resolve_method(df: DataFrame, method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown quantile method {method!r}")
    if method == "auto":
        return "one_pass" if few_rows(df) else "narrow"
    return method


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Mapping[str, str],
    probs: Sequence[float],
    method: str = "auto",
    extra: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: the keys, ``extra`` aggregates and one struct per metric.

    The struct is ``n`` (how many numbers) and ``q`` (one value per prob, or NULL
    when there is no number). ``keys`` are columns of ``df``, never NULL in the
    ``narrow`` method; ``metrics`` are SQL texts of doubles that may be NULL;
    ``extra`` aggregates ride along in the same pass. ``method`` is ``auto``,
    ``one_pass`` (Spark's ``percentile``), ``narrow`` or ``approx``.
    """
    method = resolve_method(df, method)
    if method == "narrow":
        return _by_group_size(df, list(keys), dict(metrics), list(probs), list(extra), accuracy)
    return _one_pass(df, keys, metrics, probs, extra, method)


def _one_pass(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Mapping[str, str],
    probs: Sequence[float],
    extra: Sequence[str],
    method: str,
) -> DataFrame:
    function = "percentile_approx" if method == "approx" else "percentile"
    at = _array([f"{float(p)!r}D" for p in probs])
    aggs = [
        struct_sql(n=f"count({x})", q=f"cast({function}({x}, {at}) AS ARRAY<DOUBLE>)")
        + f" AS {quoted(m)}"
        for m, x in metrics.items()
    ]
    return _aggregated(df, keys, [*extra, *aggs])


def _array(items: Sequence[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def _aggregated(df: DataFrame, keys: Sequence[str], aggs: Sequence[str]) -> DataFrame:
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*[F.expr(a) for a in aggs])


def _by_group_size(
    df: DataFrame,
    keys: list[str],
    metrics: dict[str, str],
    probs: list[float],
    extra: list[str],
    accuracy: int,
) -> DataFrame:
    """Narrow the big groups only.

    A group with few values fits a task by count, so ``percentile`` serves it;
    there can only be few big groups, and these are narrowed.
    """
    if not keys:
        return _narrowed(df, keys, metrics, probs, extra, accuracy)
    counts = [f"count({x}) AS _count_{i}" for i, x in enumerate(metrics.values())]
    is_big = " OR ".join(f"_count_{i} > {_few(accuracy)}" for i in range(len(metrics)))
    big = materialize(_aggregated(df, keys, counts).filter(is_big).select(*keys))
    if big.isEmpty():
        return _one_pass(df, keys, metrics, probs, extra, "one_pass")
    side = F.broadcast(big) if is_light(big) else big
    small = _one_pass(df.join(side, keys, "left_anti"), keys, metrics, probs, extra, "one_pass")
    narrowed = _narrowed(df.join(side, keys, "left_semi"), keys, metrics, probs, extra, accuracy)
    return small.unionByName(narrowed)


def _few(accuracy: int) -> int:
    """Up to this many values a group is taken whole: a sketch's error is given in rows."""
    return 4 * accuracy


def _sketches(
    df: DataFrame,
    keys: list[str],
    metrics: dict[str, str],
    probs: list[float],
    extra: list[str],
    accuracy: int,
) -> DataFrame:
    """Per group and metric the count and a few values around each quantile."""
    margin = MARGIN / accuracy
    ends = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    at = _array([f"{e!r}D" for e in ends])
    aggs = [
        struct_sql(n=f"count({x})", ends=f"percentile_approx({x}, {at}, {accuracy})")
        + f" AS _sketch_{i}"
        for i, x in enumerate(metrics.values())
    ]
    return _aggregated(df, keys, [*extra, *aggs])


def _brackets(
    sketches: DataFrame, keys: list[str], metrics: list[str], probs: list[float], accuracy: int
) -> DataFrame:
    """Per group, metric and prob: the bracket [lo, hi] and the two ranks wanted."""
    margin = MARGIN / accuracy
    rows = []
    for i, m in enumerate(metrics):
        n, ends = f"_sketch_{i}.n", f"_sketch_{i}.ends"
        few = f"{n} <= {_few(accuracy)}"
        for j, p in enumerate(probs):
            position = f"(({n} - 1) * {float(p)!r}D)"
            open_below, open_above = str(p <= margin).lower(), str(p >= 1 - margin).lower()
            rows.append(
                struct_sql(
                    _metric=text_sql(m),
                    _prob=str(j),
                    _n=n,
                    _lo=f"CASE WHEN {few} OR {open_below} THEN -{INFINITY} ELSE {ends}[{2 * j}] END",
                    _hi=f"CASE WHEN {few} OR {open_above} THEN {INFINITY} ELSE {ends}[{2 * j + 1}] END",
                    _rank_lo=f"floor({position})",
                    _rank_hi=f"ceil({position})",
                    _fraction=f"{position} - floor({position})",
                )
            )
    return sketches.selectExpr(*[quoted(k) for k in keys], inline_sql(rows)).filter("_n > 0")


def _near_values(df: DataFrame, metrics: dict[str, str], brackets: DataFrame) -> DataFrame:
    """Without keys the brackets are a few constants: one row per metric and prob.

    Rows below are only counted, in one aggregate; rows inside some bracket, a small
    part, are the only ones that are spread to a row per bracket.
    """
    cuts = [
        (m, r["_prob"], f"double('{r['_lo']}')", f"double('{r['_hi']}')")
        for m in metrics
        for r in brackets.filter(F.col("_metric") == m).collect()
    ]
    if not cuts:
        return df.filter("false").selectExpr("_all", "'' AS _metric", "0 AS _prob", "0D AS _v", "0L AS _rows")
    inside = [f"({metrics[m]} >= {lo} AND {metrics[m]} <= {hi})" for m, _, lo, hi in cuts]
    spread = [
        struct_sql(_metric=text_sql(m), _prob=str(p), _v=f"CASE WHEN {c} THEN double({metrics[m]}) END")
        for (m, p, _, _), c in zip(cuts, inside)
    ]
    near = (
        df.filter(" OR ".join(inside))
        .selectExpr("_all", inline_sql(spread))
        .filter("_v IS NOT NULL")
        .groupBy("_all", "_metric", "_prob", "_v")
        .agg(F.expr("count(*) AS _rows"))
    )
    counts = df.agg(*[F.expr(f"count_if({metrics[m]} < {lo}) AS _{i}") for i, (m, _, lo, _) in enumerate(cuts)])
    below = counts.selectExpr(
        "0 AS _all",
        inline_sql([
            struct_sql(_metric=text_sql(m), _prob=str(p), _v="cast(NULL AS DOUBLE)", _rows=f"_{i}")
            for i, (m, p, _, _) in enumerate(cuts)
        ]),
    )
    return near.unionByName(below.filter("_rows > 0"))


def _meet(values: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Join rows with a ``_v`` to a computed side of few rows per key.

    A light side is broadcast. Otherwise the values of a key are dealt over many tasks by
    their hash, and the side's rows, narrow and one or two per key, are repeated for them.
    """
    if is_light(side):
        return values.join(F.broadcast(side), keys)
    salted = values.withColumn("_salt", F.expr(f"int(pmod(xxhash64(_v), {SALTS}))"))
    return salted.join(side.withColumn("_salt", F.expr(f"explode(sequence(0, {SALTS - 1}))")), [*keys, "_salt"]).drop("_salt")


def _near_group_values(
    df: DataFrame, group_keys: list[str], metrics: dict[str, str], brackets: DataFrame
) -> DataFrame:
    """Values inside their group's brackets with counts; all below a bracket are one NULL."""
    group = group_keys + ["_metric"]
    # One bracket row per group and metric, so each value meets it once.
    cuts = materialize(
        _aggregated(brackets, group, ["sort_array(collect_list(struct(_prob, _lo, _hi))) AS _cuts"])
    )
    long_form = [struct_sql(_metric=text_sql(m), _v=x) for m, x in metrics.items()]
    values = df.selectExpr(*[quoted(k) for k in group_keys], inline_sql(long_form))
    # Rows above a bracket go; rows below it lose their value and become a count.
    return (
        _meet(values.filter("_v IS NOT NULL"), cuts, group)
        .selectExpr(*[quoted(k) for k in group], "_v", "explode(filter(_cuts, c -> _v <= c._hi)) AS _cut")
        .selectExpr(
            *[quoted(k) for k in group],
            "_cut._prob AS _prob",
            "CASE WHEN _v >= _cut._lo THEN _v END AS _v",
        )
        .groupBy(*group, "_prob", "_v")
        .agg(F.expr("count(*) AS _rows"))
    )


# The values of a bracket hold both wanted ranks.
INSIDE = "_below <= _rank_lo AND _rank_hi < _below + _inside"


def _with_counts(brackets: DataFrame, near: DataFrame, point: list[str]) -> DataFrame:
    """Brackets with the number of rows below and inside of them."""
    counts = _aggregated(
        near, point,
        ["coalesce(sum(_rows) FILTER (WHERE _v IS NULL), 0L) AS _below", "coalesce(sum(_rows) FILTER (WHERE _v IS NOT NULL), 0L) AS _inside"],
    )
    return brackets.join(counts, point, "left").na.fill(0, ["_below", "_inside"])


def _bin_sql() -> str:
    """The bin of ``_v`` between ``_min`` and ``_max``: by sign, then by magnitude, then by distance.

    The two ends are in different bins, so every round drops some value.
    """
    low, high = "abs(_min)", "abs(_max)"
    wide = f"least({low}, {high}) > 0 AND greatest({low}, {high}) / least({low}, {high}) > {WIDE_RATIO}D"
    by_size = f"(log2(abs(_v)) - log2({low})) / (log2({high}) - log2({low}))"
    by_distance = "(_v - _min) / (_max - _min)"
    return (
        "CASE WHEN _min = _max THEN 0 WHEN signum(_min) <> signum(_max) THEN int(signum(_v)) "
        f"ELSE least(int(floor(CASE WHEN {wide} THEN {by_size} ELSE {by_distance} END * {BINS})), {BINS - 1}) END"
    )


def _selected(near: DataFrame, wanted: DataFrame, point: list[str]) -> DataFrame:
    """``_at_lo`` and ``_at_hi`` per point: the values at the two wanted ranks.

    A round counts the values in at most ``BINS`` bins of each open range and keeps the bin that
    holds the rank. Ranges shrink about a thousandfold a round, whatever the density.
    """
    values = near.filter("_v IS NOT NULL")
    edge = point + ["_edge"]
    names = ", ".join(quoted(k) for k in edge)
    ranges = _aggregated(values, point, ["min(_v) AS _min", "max(_v) AS _max", "count(*) AS _distinct"])
    ranks = inline_sql([struct_sql(_edge=f"'{e}'", _rank=f"_rank_{e}") for e in ("lo", "hi")])
    held = [*[quoted(k) for k in point], "_below AS _before", "_min", "_max", "_distinct"]
    targets = materialize(wanted.join(ranges, point).selectExpr(*held, ranks))
    while not targets.filter(f"_distinct > {BIN_VALUES} AND _min < _max").isEmpty():
        is_open = f"_distinct > {BIN_VALUES} AND _min < _max"
        bins = (
            _meet(values, materialize(targets.filter(is_open)), point)
            .filter("_v BETWEEN _min AND _max")
            .withColumn("_bin", F.expr(_bin_sql()))
            .groupBy(*edge, "_rank", "_before", "_bin")
            .agg(*[F.expr(x) for x in ("sum(_rows) AS _n", "min(_v) AS _min", "max(_v) AS _max", "count(*) AS _distinct")])
        )
        placed = bins.withColumn("_at", F.expr(f"_before + sum(_n) OVER (PARTITION BY {names} ORDER BY _bin) - _n"))
        chosen = placed.filter("_at <= _rank AND _rank < _at + _n").drop("_before").withColumnRenamed("_at", "_before")
        targets = materialize(targets.filter(f"NOT ({is_open})").unionByName(chosen.select(*targets.columns)))
    through = f"_before + sum(_rows) OVER (PARTITION BY {names} ORDER BY _v)"
    ranked = _meet(values, targets, point).filter("_v BETWEEN _min AND _max").withColumn("_through", F.expr(through))
    at = [f"min(_v) FILTER (WHERE _edge = '{e}' AND _through > _rank) AS _at_{e}" for e in ("lo", "hi")]
    return _aggregated(ranked, point, at)


def _narrowed(
    df: DataFrame,
    keys: list[str],
    metrics: dict[str, str],
    probs: list[float],
    extra: list[str],
    accuracy: int,
) -> DataFrame:
    sketches = _sketches(df, keys, metrics, probs, extra, accuracy)
    if not keys:
        # A constant key lets the joins below serve the global case too.
        sketches, df = sketches.withColumn("_all", F.lit(0)), df.withColumn("_all", F.lit(0))
    sketches = materialize(sketches)
    group_keys = keys or ["_all"]
    point = group_keys + ["_metric", "_prob"]
    brackets = materialize(_brackets(sketches, group_keys, list(metrics), probs, accuracy))

    def near_values(cuts: DataFrame) -> DataFrame:
        return _near_group_values(df, group_keys, metrics, cuts) if keys else _near_values(df, metrics, cuts)

    near = materialize(near_values(brackets))
    missed = materialize(_with_counts(brackets, near, point).filter(f"NOT ({INSIDE})").select(*brackets.columns))
    if not missed.isEmpty():
        opened = missed.withColumns({"_lo": F.expr(f"-{INFINITY}"), "_hi": F.expr(INFINITY)})
        near = materialize(near.join(missed.select(*point), point, "left_anti").unionByName(near_values(opened)))
    picked = _selected(near, _with_counts(brackets, near, point), point)
    value = "CASE WHEN _fraction = 0 THEN _at_lo ELSE _at_lo * (1 - _fraction) + _at_hi * _fraction END"
    found = brackets.join(picked, point, "left").withColumn("_value", F.expr(value))
    arrays = [
        _array(
            [
                f"max(CASE WHEN _metric = {text_sql(m)} AND _prob = {j} THEN _value END)"
                for j in range(len(probs))
            ]
        )
        + f" AS _q_{i}"
        for i, m in enumerate(metrics)
    ]
    out = sketches.join(_aggregated(found, group_keys, arrays), group_keys, "left")
    kept = [c for c in sketches.columns if not c.startswith("_sketch_") and c != "_all"]
    structs = [
        struct_sql(n=f"_sketch_{i}.n", q=f"CASE WHEN _sketch_{i}.n > 0 THEN _q_{i} END")
        + f" AS {quoted(m)}"
        for i, m in enumerate(metrics)
    ]
    return out.selectExpr(*[quoted(c) for c in kept], *structs)
