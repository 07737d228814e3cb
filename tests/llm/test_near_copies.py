"""Near copies by walks of SimHash tries against the exact similarity of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline as p
from tabwright.llm import minhash, near_copies as n, simhash
from test_minhash import jaccard, planted


def test_the_stage_walks_tries(spark, monkeypatch):
    """The stage bears the name of SimHash; its pairs come from the walk of the trie."""
    monkeypatch.setattr(minhash, "candidates", lambda *_: pytest.fail("bands of minima"))
    monkeypatch.setattr(n, "meetings", lambda nodes, *_: nodes.selectExpr("node a", "node b").limit(0))
    text, copy = planted(random.Random(3), 200, 4)
    rows = spark.createDataFrame([(0, text), (1, copy), (2, text)], "doc_id long, text string")
    stage = dict(p.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, rows, "").collect()) == [0, 1]
    monkeypatch.undo()
    assert [r.doc_id for r in stage(spark, rows, "").collect()] == [0]


@pytest.mark.parametrize("size", [1, 2, 5, 6, 7, 50, 511, 512, 513, 1500])
def test_signature_counts_every_vote(size):
    marks = np.random.default_rng(size).integers(0, 1 << 64, size, np.uint64)
    hashes = np.concatenate([n._hashes(marks[at : at + 100]) for at in range(0, size, 100)])
    bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=int) * 2 > size
    assert n.signature(marks) == np.packbits(bits, bitorder="little").tobytes()
    assert n.signature(marks[:0]) is None


def brute_walk(words, others, allowed):
    apart = words[:, None] ^ others[None, :]
    ok = np.ones(apart.shape, bool)
    for d in range(1, 65):
        ok &= np.bitwise_count(apart >> np.uint64(64 - d)) <= allowed[d]
    return set(zip(*map(list, np.nonzero(ok))))


@pytest.mark.parametrize("depth", [0, 3])
def test_walk_meets_all_that_its_budgets_allow(monkeypatch, depth):
    rng = np.random.default_rng(4)
    base = np.repeat(rng.integers(0, 1 << 60, 40, np.uint64), 12)
    for _ in range(8):
        base ^= np.uint64(1) << rng.integers(0, 60, len(base)).astype(np.uint64)
    base = np.sort(np.concatenate([base, base[:60], base[:1].repeat(50)]) >> np.uint64(depth))
    left, right = base[::2], base[1::2]
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 64)  # so that repeated leaves are cut too
    for a, b in ((base, None), (left, right)):
        found = [x for i, j in simhash.near_leaves(a, b, depth, n.ALLOWED, 15) for x in zip(i, j) if b is not None or x[0] < x[1]]
        want = {x for x in brute_walk(a, a if b is None else b, n.ALLOWED) if b is not None or x[0] < x[1]}
        assert len(found) == len(set(found)) and want <= set(found)


def kept_by_hand(texts, least=0.8):
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if low[i] != low[j] and jaccard(texts[i], texts[j]) >= least:
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    return sorted(set(low))


@pytest.mark.parametrize("most, tile", [(n.PAIRS, n.TILE), (1, 8)])
def test_no_link_is_lost_where_texts_are_half_alike(spark, most, tile):
    """Copies of copies at about 0.8 inside one dense group: links lie between any two of its texts."""
    rng = random.Random(23)
    base = planted(rng, 120, 0)[0].split()
    texts = []
    for _ in range(110):
        words = list(base)
        at = rng.randrange(0, 90)
        words[at : at + rng.randint(6, 13)] = [f"y{rng.random()}"] * 3
        texts.append(" ".join(words))
    near = [jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i]]
    assert sum(0.6 < x < 0.8 for x in near) > 3000 and sum(x >= 0.8 for x in near) > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in n.first_of_each(docs, most=most, tile=tile).collect()) == kept_by_hand(texts)


def test_tables_of_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Texts that are half alike and mostly no copies: nearly all pairs pass a walk, and tables stay small."""
    rng = random.Random(29)
    base = planted(rng, 120, 0)[0].split()
    texts = []
    for k in range(240):
        words = list(base)
        for at in (rng.randrange(0, 55), rng.randrange(60, 115)):
            words[at : at + rng.randint(2, 8)] = [f"z{rng.random()}"]
        texts.append(" ".join(words))
    near = [jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i]]
    assert sum(x < 0.8 for x in near) > 25_000 and sum(x >= 0.8 for x in near) > 10
    rows, write = {}, n.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(n, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in n.first_of_each(docs).collect()) == kept_by_hand(texts)
    assert rows["met"] <= n.PAIRS * n.WALKS * len(texts)


def test_odd_rows(spark):
    docs = [(5, "x y"), (4, "X  y"), (None, "x y"), (7, None), (6, ""), (4, "X  y"), (9, "z")]
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, _who int")
    out = n.first_of_each(frame)
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [4, 6, 9]
    assert n.first_of_each(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        n.first_of_each(frame, least=0.5)
