"""Language filters: held-out accuracy, exact counts on a small model, and odd rows."""

import random

import numpy as np
import pytest

from tabwright.llm import langid as g

SYLLABLES = {"aa": "ka lo mi tu ren", "bb": "sch ung ver eit ko", "cc": "ción ñar que los ado"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, l := rng.choice(list(SYLLABLES)), rng.randint(2, 60)), l if i % 7 else None, "s") for i in range(400)]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "12 -- 3\n", "bb", "s"), (None, rows[0][1], "aa", "s"), rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").cache()


def test_ngrams_equal_windows_over_letters():
    text = "Ab1c  déf\n\n漢x"
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    flat = "  " + " ".join(letters.split()) + "  "
    want = {flat[i : i + g.N] for i in range(len(flat) - g.N + 1)} - {" " * g.N}
    got = np.concatenate(list(g.ngrams(text)))
    assert len(np.unique(got)) == len(want) and len(got) == len(flat) - g.N + 1


def test_long_text_in_pieces(monkeypatch):
    text = "Some words, and some more! " * 50
    whole = sorted(np.concatenate(list(g.ngrams(text))))
    monkeypatch.setattr(g, "PIECE", 17)
    assert sorted(np.concatenate(list(g.ngrams(text)))) == whole


def test_filters_return_every_member_and_few_others():
    rng = np.random.default_rng(1)
    codes = {k: rng.integers(0, 2**63, 5000).astype(np.uint64) for k in range(10)}
    f = g.Filters.build([str(k) for k in range(10)], codes)
    for k, own in codes.items():
        masks = np.bitwise_and.reduce([f.table[:, k // 8][at] for at in g._slots(own, len(f.table))])
        assert ((masks >> np.uint8(k % 8)) & 1).all()
    assert f.false_rate.max() < 0.02


def test_held_out_accuracy(spark, docs):
    model = g.fit(docs.filter(~g.held_out()))
    assert model.languages == ["aa", "bb", "cc"]
    out = g.predict(docs, model).withColumn("out", g.held_out())
    assert out.count() == docs.count()
    rows = out.join(docs.withColumnRenamed("lang_pred", "x"), "doc_id").filter("out and doc_id < 1000 and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in out.filter("doc_id >= 1000").collect()}
    assert set(odd.values()) == {("und", 0.0)} and len(odd) == 3
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_stage_keeps_all_columns_and_clean_rows(spark, docs):
    out = g.accepted(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id is None or r.doc_id < 1000)


def test_nothing_to_learn_from(spark, docs):
    model = g.fit(docs.filter("doc_id < 0"))
    assert {r.lang_pred for r in g.predict(docs, model).collect()} == {"und"}
    unlabelled = docs.drop("lang").selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert g.accepted(unlabelled).count() == docs.count() - 3
    assert g.accepted(docs.limit(0)).count() == 0


def test_any_number_of_languages(spark):
    """A language has its bit whatever its position, also beyond a thousand of them."""
    word = lambda i: "".join(chr(0x4E00 + 4 * i + k) for k in range(4))
    rows = [(i, f"{word(i)} " * 4, f"l{i:04}") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = g.predict(docs, g.fit(docs)).collect()
    assert all(r.lang_pred == f"l{r.doc_id:04}" for r in out)


def test_sample_is_bounded_by_characters_too(spark, docs, monkeypatch):
    whole = g.fit(docs)
    monkeypatch.setattr(g, "FIT_CHARS", 4_000)
    assert 0 < g.fit(docs).table.sum() < whole.table.sum()
