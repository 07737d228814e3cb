"""SimHash near-duplicates against a comparison of all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabwright.llm import simhash as s
from tabwright.llm.components import components


def brute_fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, budget=3):
    """The smallest position reachable from each."""
    low = list(range(len(marks)))
    near = np.bitwise_count(np.array(marks, np.uint64)[:, None] ^ np.array(marks, np.uint64)[None, :]) <= budget
    for i in range(len(marks)):  # spread from every position in order
        if low[i] == i:
            todo = [i]
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(near[k]):
                    if low[j] > i:
                        low[j] = i
                        todo.append(j)
    return low


def clustered(rng, groups, size, flips):
    out = []
    for _ in range(groups):
        base = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(size):
            x = base
            for k in rng.choice(64, rng.integers(0, flips), replace=False):
                x ^= 1 << int(k)
            out.append(x)
    return sorted(set(out))


TEXTS = ["", None, " \n", "one", "One two", "a b c", "a b c a b c d", "É é ß A", "tab\tone\x0btwo\x0cthree\rfour", "nb sp x y z", "w " * 70_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert s.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_all_components(seed):
    rng = np.random.default_rng(seed)
    marks = np.array(clustered(rng, 60, 8, 5), np.uint64)
    a, b = s.trie_links(marks, None, 0)
    turned = s.trie_links(s._swapped(marks), None, 0)
    links = list(zip(a, b)) + list(zip(*map(s._swapped, turned)))
    assert len(a) <= len(marks)  # a link per fingerprint, not per pair
    at = {int(x): i for i, x in enumerate(marks)}
    group = list(range(len(marks)))
    for x, y in links:
        p, q = group[at[int(x)]], group[at[int(y)]]
        group = [min(p, q) if g in (p, q) else g for g in group]
    assert group == brute_components(marks)


@pytest.mark.parametrize("tile", [1 << 14, 16])
def test_links_over_tasks(spark, tile):
    rng = np.random.default_rng(9)
    marks = clustered(rng, 25, 12, 5)
    table = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in marks], "fp long")
    roots = {r.node: r.root for r in components(s.links(table, tile=tile)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in marks]
    groups = {}
    for x, low in zip(signed, brute_components(marks)):
        groups.setdefault(low, set()).add(x)
    found = {}
    for x in signed:
        found.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_documents(spark):
    prose = " ".join(f"w{i}" for i in range(400))
    near = prose.replace("w7 ", "q ")
    rows = [(5, prose), (3, near), (9, prose), (1, "quite other words here and nothing alike"), (7, None), (6, ""), (None, prose), (9, prose)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _who string, root long")
    marks = [brute_fingerprint(t) for _, t in rows]
    low = brute_components(marks)
    keys = {g: min((k for k, _ in (rows[i] for i in range(len(rows)) if low[i] == g) if k is not None), default=None) for g in low}
    out = s.near_duplicates(frame).collect()
    assert sorted((str(r.doc_id), r.component, r.fp % 2**64) for r in out) == sorted((str(k), keys[g], m) for (k, _), g, m in zip(rows, low, marks))
    kept = s.first_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(keys.values()))
    repeated = s.first_of_each(frame.filter("doc_id = 9"))
    assert [r.doc_id for r in repeated.collect()] == [9]
    assert s.near_duplicates(frame.limit(0)).count() == 0 and s.first_of_each(frame.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.unionByName(spark.createDataFrame([(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long"))
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(n)} | {100: 100, 101: 100}
