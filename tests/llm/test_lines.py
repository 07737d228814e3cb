"""Line dedup against an alignment of all pairs that a plain program finds."""

import random
from collections import defaultdict

import pytest

from tabwright.llm import lines as m


def norm(line):
    return " ".join(line.split())


def reference(docs, least):
    """Deleted line numbers by document; ``docs`` are (id, text) in order, ids distinct.

    All pairs of documents, all maximal common runs of lines, wherever they stand.
    """
    split = {i: [(p, norm(x)) for p, x in enumerate(t.split("\n")) if norm(x)] for i, t in docs if t}
    gone = {i: set() for i, _ in docs}
    earlier = []
    for i, own in split.items():
        a = [x for _, x in own]
        for b in earlier:
            places = defaultdict(list)
            for t, x in enumerate(b):
                places[x].append(t)
            for s, x in enumerate(a):
                for t in places.get(x, ()):
                    if s and t and a[s - 1] == b[t - 1]:
                        continue  # not where the common run begins
                    n = 0
                    while s + n < len(a) and t + n < len(b) and a[s + n] == b[t + n]:
                        n += 1
                    if sum(len(y.split()) for y in a[s : s + n]) >= least:
                        gone[i] |= {own[k][0] for k in range(s, s + n)}
        earlier.append(a)
    return gone


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    pool = [[f"p{p} line {k} " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) for k in range(rng.randint(1, 6))] for p in range(12)]
    stock = ["The end.", "All rights  reserved by nobody at all"]
    out, n = [], 0
    for i in range(80):
        body = []
        for _ in range(rng.randint(1, 6)):
            body += rng.choice([[f"own {i} {n + k} " + "w " * rng.randint(1, 20) for k in range(3)], [""], [rng.choice(stock)]])
            n += 3
        for p in sorted(rng.sample(range(12), rng.randint(0, 3))):
            body += [f"before {i} {n}", *pool[p], f"after {i} {n}"]
            n += 1
        out.append((i, "\n".join(x + rng.choice(["", " ", "\t"]) for x in body)))
    return out + [(500, out[3][1]), (501, out[3][1])]


@pytest.mark.parametrize("segment", [2048, 16])
def test_deleted_blocks(spark, docs, segment, monkeypatch):
    monkeypatch.setattr(m, "SEGMENT", segment)
    monkeypatch.setattr(m, "OVERLAP", min(64, segment // 2))
    odd = [(900, None), (901, ""), (902, "\n\n")]
    frame = spark.createDataFrame([(i, t, -1, 7, "w") for i, t in docs + odd], "doc_id long, text string, n_chars long, _Positions long, _who string")
    out = m.dedup_lines(frame.repartition(3))
    assert out.columns == frame.columns
    gone = reference(docs, m.MIN_BLOCK_WORDS)
    assert sum(map(len, gone.values())) > 50
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(docs) + 3
    for i, t in docs:
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert rows[i].text == want, i
        assert rows[i].n_chars == (len(want) if gone[i] else -1)
    assert not rows[500].text.strip() and rows[501].text == rows[500].text
    assert [rows[i].text for i in (900, 901, 902)] == [None, "", "\n\n"]


def test_repeated_rows_null_keys_and_empty_table(spark, docs):
    t = docs[3][1]
    rows = [(1, t), (1, t), (None, t), (2, "short\nlines")]
    out = m.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), removed="removed").collect()
    assert sorted((str(r.doc_id), r.removed > 0) for r in out) == [("1", False), ("1", False), ("2", False), ("None", True)]
    assert m.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_patience_is_an_alignment():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))] for _ in range(2))
        found = m.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < n for (i, j), (k, n) in zip(found, found[1:]))
    assert m.patience(list("abcXYZde"), list("XYZabcde")) in (
        [(0, 3), (1, 4), (2, 5), (6, 6), (7, 7)], [(3, 0), (4, 1), (5, 2), (6, 6), (7, 7)]
    )


def lines_left(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return {r.doc_id: r.text for r in m.dedup_lines(frame).collect()}


def passage(name, lines):
    return [f"{name} {k} " + "word " * 9 for k in range(lines)]


def test_a_passage_goes_whoever_has_it_first(spark):
    """Lines first seen in several documents, a passage that its first holder has twice, and passages in another order."""
    eight = passage("e", 8)
    got = lines_left(spark, ["\n".join(eight[::2]), "\n".join(eight[1::2]), "\n".join(eight), "\n".join(eight)])
    assert got[3] == "\n".join(eight) and not got[4].strip()
    p, q, y, z = passage("p", 7), passage("q", 7), passage("y", 2), passage("z", 2)
    got = lines_left(spark, ["\n".join(z + p + p + y), "\n".join(p), "\n".join(p), "\n".join(p), "\n".join(z + y), "\n".join(y + p + z + p)])
    assert [got[i].strip() for i in (2, 3, 4)] == ["", "", ""]
    assert got[5] == "\n".join(z + y) and got[6] == "\n".join(y)  # z goes too: z and p stand together in the first
    got = lines_left(spark, ["\n".join(p + q), "\n".join(q + ["own"] + p), "\n".join(q[:5] + p[3:] + q[2:])])
    assert got[2].strip() == "own" and not got[3].strip()


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_lines(spark, seed):
    """Lines that repeat a lot, inside documents and between them: every order and overlap occurs."""
    rng = random.Random(seed)
    stock = [f"line {k} " + "w " * rng.randint(1, 30) for k in range(14)]
    docs = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    out = {r.doc_id: r.text for r in m.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone = reference(docs, m.MIN_BLOCK_WORDS)
    for i, t in docs:
        assert out[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), i


def test_least_runs_cover_every_passage():
    rng = random.Random(1)
    for _ in range(500):
        words = [rng.randint(1, 12) for _ in range(rng.randint(0, 12))]
        spans = m.least_runs(words, 15)
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                inside = {k for s, e in spans if i <= s and e <= j for k in range(s, e)}
                assert inside == (set(range(i, j)) if sum(words[i:j]) >= 15 else set())
