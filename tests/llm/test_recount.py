"""Edit-aware counts against encoding the edited text anew."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabwright.llm import recount as r

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
BITS = ["a", "word", " ", "  ", "\n", "\n\n", "'s", "'", "'re", "12", ".", "...", "é", "漢", "\t", " x", "’s", "_"]


@pytest.fixture(scope="module")
def full():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def check(tree, counter):
    pieces = [p for s in range(tree.leaves) for p in tree.pieces(s)]
    assert [n for n, _ in pieces] == list(map(len, counter.cut(tree.text)))
    for node in range(1, tree.leaves):
        assert (tree.sums[node] == tree.sums[2 * node] + tree.sums[2 * node + 1]).all()


@pytest.mark.parametrize("step", [1 << 12, 8])
def test_any_edits(full, step, monkeypatch):
    monkeypatch.setattr(r, "CUT_STEP", step)
    rng, counter = random.Random(step), r.Counter(PATH, PATTERN)
    for _ in range(400):
        tree = r.Tree("".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))), counter)
        assert tree.tokens == full(tree.text)
        for _ in range(rng.randint(1, 6)):
            start = rng.randint(0, len(tree.text))
            end = min(len(tree.text), start + rng.choice([0, 0, 1, 2, 9]))
            want = tree.text[:start] + (new := "".join(rng.choice(BITS) for _ in range(rng.randint(0, 3)))) + tree.text[end:]
            tree.edit(start, end, new)
            assert tree.text == want and tree.tokens == full(want), (tree.text, start, end, new)
            check(tree, counter)


def test_only_the_touched_region_is_encoded():
    counter = r.Counter(PATH, PATTERN)
    tree = r.Tree("some words and more words " * 20_000, counter)
    tree.edit(260_000, 260_004, "other")
    assert 0 < tree.encoded < 8


def test_rows(spark, full):
    long = "word mail me@example.org or 10.0.0.1\nword mail me@example.org or 10.0.0.1\n+49 170 1234567 end"
    edits = [(3, 8, "XX"), (5, 9, "lost"), (100, 200, "!"), (None, 1, "x"), None]
    rows = [(1, long, edits), (None, None, None), (2, "", [(0, 0, "new")]), (3, "abc", []), (1, long, edits), (4, "<|endoftext|>", None)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, edits array<{r.EDIT}>")
    out = {str(x.doc_id): tuple(x)[1:4] for x in r.recount(frame, PATH, PATTERN).collect()}
    edited = long[:3] + "XX" + long[8:] + "!" if len(long) <= 100 else long[:3] + "XX" + long[8:100] + "!" + long[200:]
    assert out == {
        "1": (full(long), full(edited), 2), "None": (0, 0, 0), "2": (0, full("new"), 1), "3": (1, 1, 0), "4": (full("<|endoftext|>"),) * 2 + (0,),
    }
    masked = r.recount(r.with_mask_edits(frame), PATH, PATTERN).filter("doc_id = 1").first()
    assert masked.n_tokens_edited == full("word mail <email> or <ip>\n<number> end") and masked.n_edits == 4
    assert r.recount(frame.limit(0), PATH, PATTERN).count() == 0


def test_later_rounds_go_on_from_the_table(spark, full, tmp_path):
    """Kept trees are read, edited and written; no round encodes more than what its edits touch."""
    rng, counter = random.Random(5), r.Counter(PATH, PATTERN)
    texts = {i: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 300))) for i in range(60)} | {60: "plain words " * 30_000, 61: None}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, chars string, n_tokens int")
    r.build_trees(docs, PATH, PATTERN).write.parquet(f"{tmp_path}/0")
    for turn in range(3):
        trees = spark.read.parquet(f"{tmp_path}/{turn}")
        edits = {}
        for i, t in texts.items():
            places = sorted(rng.sample(range(len(t or "") + 1), min(4, len(t or "") // 2 * 2)))
            edits[i] = [(a, b, rng.choice(BITS)) for a, b in zip(places[::2], places[1::2])] if i % 3 else None
        edits[60] = [(7_000 * (turn + 1), 7_000 * (turn + 1) + 5, "new")]
        side = spark.createDataFrame(list(edits.items()), f"doc_id long, edits array<{r.EDIT}>")
        r.edit_trees(trees.join(side, "doc_id"), PATH, PATTERN).write.parquet(f"{tmp_path}/{turn + 1}")
        for row in spark.read.parquet(f"{tmp_path}/{turn + 1}").collect():
            old = texts[row.doc_id]
            want = old
            for a, b, new in reversed(edits[row.doc_id] or []):
                want = want[:a] + new + want[b:]
            assert row.text == want and row.n_tokens == full(old or "") and row.n_tokens_edited == full(want or "")
            leaves = [r.unpacked(row.tree[c], row.tree.n_pretokens) for c in ("chars", "tokens")]
            assert leaves[0].sum() == len(want or "") and leaves[1].sum() == row.tree.n_tokens == row.n_tokens_edited
            assert leaves[0].tolist() == list(map(len, counter.cut(want or "")))
            assert edits[row.doc_id] or row.n_reencoded == 0
            texts[row.doc_id] = want
            if row.doc_id == 60:
                assert row.n_pretokens > 59_000 and 0 < row.n_reencoded < 10


def test_nothing_is_encoded_for_rows_without_edits(spark, monkeypatch):
    counter = r.Counter(PATH, PATTERN)
    tree = r.Tree("some words, and more", counter)
    row = r.tree_row(tree.leaf_sums())
    monkeypatch.setattr(r.Counter, "cut", None)
    again = r.Tree.kept(tree.text, counter, r.unpacked(row["chars"], row["n_pretokens"]), r.unpacked(row["tokens"], row["n_pretokens"]))
    assert (again.sums == tree.sums).all() and again.tokens == row["n_tokens"]


@pytest.mark.parametrize("top", [0, 1, 255, 256, 65_535, 65_536, 1 << 31])
def test_leaves_of_any_size(top):
    values = r.np.array([1, top, 3], r.np.int64)
    assert r.unpacked(r.packed(values), 3).tolist() == values.tolist()
