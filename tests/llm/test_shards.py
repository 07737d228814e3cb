"""The external shuffle: every row once, law of rows, order from content and seed alone."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm.shards import dealt, fisher_yates, read_shards, shuffled, write_shards


def placed(df):
    return {r.doc_id: (r.shard, r.slot) for r in df.collect()}


def check_law(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', cast(id % 50 AS int)) AS text")


def test_shards_hold_every_row_once(docs):
    rows = shuffled(docs, 7, bucket_bytes=20_000).collect()
    check_law(rows, 7)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())


def test_order_depends_on_rows_and_seed_alone(docs):
    first = placed(shuffled(docs, 7, bucket_bytes=20_000))
    other = docs.repartition(13).orderBy(F.desc("doc_id"))
    assert placed(shuffled(other, 7, bucket_bytes=20_000)) == first
    assert placed(shuffled(docs, 7, seed=1, bucket_bytes=20_000)) != first


def test_order_is_random(docs):
    """Neighbours in the input meet neither in a shard nor in its order."""
    at = placed(shuffled(docs, 10, bucket_bytes=20_000))
    order = np.array([s * 300 + p for _, (s, p) in sorted(at.items())])
    assert abs(np.corrcoef(np.arange(3000), order)[0, 1]) < 0.08
    sums = np.bincount([s for s, _ in at.values()], weights=list(at), minlength=10) / 300
    assert abs(sums - 1500).max() < 5 * 866 / 300**0.5


def test_fisher_yates_ignores_arrival():
    marks, checks = np.array([5, -3, 9, 5]), np.array([2, 0, 0, 1])
    turn = np.array([2, 0, 3, 1])
    a, b = fisher_yates(marks, checks, 42, 3), fisher_yates(marks[turn], checks[turn], 42, 3)
    assert list(marks[a]) == list(marks[turn][b]) and list(checks[a]) == list(checks[turn][b])
    seen = Counter(tuple(fisher_yates(np.arange(3), np.zeros(3), s, 0)) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400


def test_a_third_of_all_rows_is_the_same_row(spark, docs):
    same = spark.range(1500).selectExpr("7000L AS doc_id", "repeat('same ', 40) AS text")
    both = docs.unionByName(same)
    found = shuffled(both, 9, bucket_bytes=20_000)
    rows = found.collect()
    check_law(rows, 9)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in both.collect())
    copies = Counter(r.shard for r in rows if r.doc_id == 7000)
    assert len(copies) == 9 and max(copies.values()) < 260  # spread like others


def test_copies_are_numbered_by_many_tasks(spark):
    df = dealt(spark.sql("select 1 as k, 10000L as n union all select 2, 1L"), "n", "c")
    assert sorted((r.k, r.c) for r in df.collect()) == [(1, i) for i in range(10000)] + [(2, 0)]


def test_odd_tables(spark):
    rows = [(None, None, 1, "a"), (1, "", 2, "b"), (1, "", 2, "b"), (2, "x" * 300_000, 3, None), (3, None, 4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, SLOT int, _mark string")
    out = shuffled(df, 40, bucket_bytes=1000)
    assert out.columns == ["doc_id", "text", "_mark", "shard", "slot"]
    got = out.collect()
    check_law(got, 40)
    assert Counter((r.doc_id, r.text, r._mark) for r in got) == Counter((a, b, d) for a, b, _, d in rows)
    assert shuffled(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        shuffled(df, 0)


def test_written_shards_read_back_in_order(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    write_shards(docs, path, 5, bucket_bytes=20_000)
    back = read_shards(spark, path, docs)
    assert placed(back) == placed(shuffled(docs, 5, bucket_bytes=20_000))
    one = [r.slot for r in spark.read.parquet(f"{path}/shard=2").coalesce(1).collect()]
    assert sorted(one) == list(range(600))
