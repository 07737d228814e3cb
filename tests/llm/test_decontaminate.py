"""Decontamination against a brute-force search for windows."""

import hashlib
import random
from weakref import WeakSet

import pytest

from tabwright.llm import decontaminate as d


def brute(text, items, window=10):
    words = d.words_of(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = d.words_of(item_text)
        n = min(window, len(own))
        if not own:
            continue
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def example(rng, n):
    return " ".join(rng.choice("ab cd ef gh Ärz it's".split()) for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    items = [(i, example(rng, rng.choice([1, 3, 4, 9, 10, 11, 14, 30]))) for i in range(25)]
    items = [x for x in items if len(d.words_of(x[1])) > 2]
    items += [(100, None), (101, ""), (102, "?!"), (None, "one null id with a text of more than ten words here now")]
    items += [items[0], (7, "the same id again but other words which are long enough to be found")]
    docs = [(i, example(rng, rng.choice([0, 1, 5, 40, 200]))) for i in range(60)]
    docs += [(200 + i, f"Xx {t} yy zz " + (t or "").upper()) for i, (_, t) in enumerate(items)]
    docs += [(900, None), (901, ""), (902, "!"), (docs[3]), (None, items[0][1]), (903, "w " * 50_000)]
    return docs, items


@pytest.mark.parametrize("shard", [1 << 22, 300])
def test_report_equals_brute_force(spark, tables, shard, monkeypatch):
    monkeypatch.setattr(d, "SHARD_BYTES", shard)
    docs, items = tables
    out = d.report(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    want = sorted(
        (str(i), n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0)
        for i, t in docs
        for n, h, f in [brute(t, items)]
    )
    assert sorted((str(r[0]), *r[1:6]) for r in out) == want
    assert any(r.contaminated for r in out) and not all(r.contaminated for r in out)


@pytest.mark.parametrize("shard", [1 << 22, 300])
def test_cleaned_texts_hold_no_window_and_clean_ones_stay(spark, tables, shard, monkeypatch):
    monkeypatch.setattr(d, "SHARD_BYTES", shard)
    docs, items = tables
    frame = spark.createDataFrame([(i, t, -1, "x", 1) for i, t in docs], "doc_id long, text string, n_chars long, items string, _hits int")
    out = d.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == frame.columns
    rows = out.collect()
    long = [x for x in items if len(d.words_of(x[1])) >= 10]
    for r in rows:
        assert brute(r.text, long)[1] == 0
        assert r.n_chars == -1 or r.n_chars == len(r.text)
    clean = [t for i, t in docs if brute(t, long)[1] == 0]
    kept = [r.text for r in rows if r.n_chars == -1]
    assert sorted(map(str, kept)) == sorted(map(str, clean))
    assert len(rows) < len(docs)  # documents that are an item go


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    out = d.report(docs, none).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out] == [(2, 0, 0, False), (0, 0, 0, False)]
    assert d.report(docs.limit(0), none).count() == 0
    assert d.decontaminate(docs, none).collect() == docs.collect()


def test_driver_holds_one_automaton_and_repeated_items_are_one_shard(spark, tables, monkeypatch):
    monkeypatch.setattr(d, "SHARD_BYTES", 300)
    docs, items = tables
    alive, counts, init = WeakSet(), [], d.Automaton.__init__

    def counted(self, *args):
        init(self, *args)
        alive.add(self)
        counts.append(len(alive))

    monkeypatch.setattr(d.Automaton, "__init__", counted)
    d.decontaminate(
        spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert len(counts) > 1 and max(counts) == 1
    same = spark.createDataFrame([(1, "one item of ten words that a table repeats often")] * 500, "item_id long, text string")
    parts = d.dealt(same)
    assert parts.shards == 1 and parts.pieces.count() == 1


@pytest.mark.parametrize("shard", [1 << 22, 100])
def test_coverage_counts_short_items(spark, shard, monkeypatch, tmp_path):
    from corpus_pipeline import STAGES

    monkeypatch.setattr(d, "SHARD_BYTES", shard)
    short, other = "one short item of just eight words here", "another item that has nine words in all now"
    long = " ".join(f"long{i}" for i in range(12))
    rest = [f"free{i}" for i in range(40)]
    split = long.split()
    docs = {
        1: short,
        2: f"{short} x {other} y",  # short spans only
        3: f"{short} " + " ".join(rest[:8]),  # half of the words
        4: f"{short} " + " ".join(rest[:7]),
        5: f"{short} x {long} " + " ".join(rest[:18]),  # 20 of 39 words, 12 of them in a span that goes
        6: f"{short} x {long} " + " ".join(rest[:19]),
        7: " ".join(rest), 8: None, 9: "",
        # cutting the inner passage joins the outer one: 24 of 48 words, and 24 of 47
        10: " ".join([*split[:6], *split, *split[6:], *rest[:24]]), 11: " ".join([*split[:6], *split, *split[6:], *rest[:23]]),
        # cutting moves the short item to another place, and a second cut is counted once
        12: " ".join([*split[:6], *split, *split[6:], "x", *short.split(), *rest[:32]]),
        13: " ".join([*split[:6], *split, *split[6:], "x", *short.split(), *rest[:30]]),
    }
    spark.createDataFrame([(1, short), (2, other), (3, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame([(k, t, -1) for k, t in docs.items()], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r.text for r in dict(STAGES)["benchmark_decontamination"](spark, frame, str(tmp_path)).collect()}
    assert sorted(out) == [3, 6, 7, 8, 9, 10, 12]
    assert out[3] == docs[3] and long not in out[6] and short in out[6] and short in out[12]
