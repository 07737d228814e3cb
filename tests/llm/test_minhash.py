"""Near copies of known similarity against the exact Jaccard of their shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline as p
from tabwright.llm import minhash as m


def jaccard(a, b):
    x, y = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def planted(rng, n_words, changed):
    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 9))) for _ in range(n_words)]
    copy = list(words)
    for at in rng.sample(range(n_words), changed):
        copy[at] = f"x{rng.random()}"
    return " ".join(words), " ".join(copy)


# words and changed words: similarities from about 0.8 to 1, and some far below
SETTINGS = [(50, 1), (200, 1), (200, 4), (600, 8), (600, 12), (3000, 60), (200, 0), (200, 20), (600, 60)]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    return [planted(rng, *s) for s in SETTINGS for _ in range(30)]


def test_stage_drops_near_copies_down_to_four_fifths(spark, pairs):
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in dict(p.STAGES)["simhash_near_dedup"](spark, docs, "").collect()}
    near = [jaccard(*pair) >= 0.8 for pair in pairs]
    assert sum(near) > 150 and near.count(False) >= 60
    assert kept == {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, n in enumerate(near) if not n}


def test_shingles_and_nodes(spark):
    assert len(m.shingles(None)) == len(m.shingles(" \n")) == 0
    assert m.shingles("A b").tolist() == m.shingles("a  B\n").tolist() and len(m.shingles("a b c d e f")) == 2
    docs = [(5, "x y"), (4, "X  y"), (None, "x y"), (7, None), (6, ""), (4, "X  y"), (9, "z")]
    out = m.first_of_each(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, _who int"))
    assert sorted(r.doc_id for r in out.collect()) == [4, 6, 9]
    keys = np.array([m.band_keys(m.shingles(f"w{i} a b c d")) for i in range(50)])
    assert all(len(set(column)) == 50 for column in keys.T)


def with_boilerplate(rng, shared, n_own, changed):
    """A text that begins with the words that all share, and a near copy of it."""
    text, copy = planted(rng, n_own, changed)
    return " ".join([*shared, text]), " ".join([*shared, copy])


# own words beside 400 shared ones, changed words, similarity between different pairs
@pytest.mark.parametrize("n_own, changed, across", [(400, 14, 1 / 3), (200, 10, 1 / 2), (100, 8, 2 / 3)])
def test_near_copies_that_share_boilerplate(spark, n_own, changed, across):
    """Buckets fill with texts that are alike but no copies, and each is compared with two nodes only."""
    rng = random.Random(11)
    shared = planted(rng, 400, 0)[0].split()
    pairs = [with_boilerplate(rng, shared, n_own, changed) for _ in range(200)]
    assert all(0.8 <= jaccard(*pair) < 0.95 for pair in pairs)
    assert abs(jaccard(pairs[0][0], pairs[1][0]) - across) < 0.03
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    kept = {r.doc_id for r in m.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(len(pairs))}
