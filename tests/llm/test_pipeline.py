"""Every stage of the pipeline on its own input, against cases planted there."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from tabwright.llm.catalog import bpe_file
from tabwright.llm.decontaminate import words_of
from tabwright.llm.simhash import fingerprint

SYLLABLES = {"en": "the ing er on th and ti", "de": "ung sch ver ein keit lich be", "es": "ción que los ado ras miento"}
STAGE = dict(p.STAGES)


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def prose(rng, lang, lines=6):
    return "\n".join(words(rng, lang, rng.randint(8, 25)) + "." for _ in range(lines))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, prose(rng, l := rng.choice(list(SYLLABLES)), rng.randint(5, 20)), l, "s") for i in range(120)]
    items = [(i, words(rng, "en", 30)) for i in range(8)]
    passage = "\n".join(words(rng, "en", 20) for _ in range(4))
    rows += [(200, rows[5][1], rows[5][2], "s"), (201, rows[6][1], rows[6][2], "s")]  # whole copies
    rows += [(300 + k, prose(rng, "en", 4) + "\n" + passage + "\n" + prose(rng, "en", 4), "en", "s") for k in range(5)]
    near = rows[7][1].split(" ")
    near[10] = "changed"
    rows += [(400, " ".join(near), rows[7][2], "s")]
    rows += [(500 + k, prose(rng, "de", 5) + "\n" + items[k][1].upper() + "\n" + prose(rng, "de", 5), "de", "s") for k in range(4)]
    rows += [(600, items[6][1], "en", "s"), (700, "12 + 30 = 42", "en", "s"), (701, None, "en", "s"), (702, "", "en", "s"), rows[3]]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items, passage


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_named_in_order():
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]


def test_language_keeps_all_text(spark, corpus):
    folder, rows, *_ = corpus
    out = STAGE["language_id"](spark, read(spark, folder), folder)
    assert out.columns == read(spark, folder).columns
    assert ids(out) == sorted(i for i, *_ in rows if i < 700)


def test_lines_go_from_later_documents(spark, corpus):
    folder, rows, _, passage = corpus
    docs = read(spark, folder)
    out = {r.doc_id: r for r in STAGE["line_dedup"](spark, docs, folder).collect()}
    before = {i: t for i, t, *_ in rows}
    assert set(before) - set(out) == {200, 201}
    assert out[300].text == before[300]
    for k in range(301, 305):
        assert passage not in out[k].text and out[k].text == before[k].replace(passage + "\n", "")
        assert out[k].n_chars == len(out[k].text)
    assert all(out[i].text == before[i] for i in range(120))


def test_one_of_each_group_stays(spark, corpus):
    folder, rows, *_ = corpus
    out = ids(STAGE["simhash_near_dedup"](spark, read(spark, folder), folder))
    marks = [fingerprint(t) for _, t, *_ in rows]
    near = np.bitwise_count(np.array(marks, np.uint64)[:, None] ^ np.array(marks, np.uint64)[None, :]) <= 3
    low = [min(rows[j][0] for j in np.flatnonzero(near[i])) for i in range(len(rows))]  # groups here are cliques
    assert out == sorted(set(low)) and 200 not in out and 201 not in out


def test_no_window_of_an_item_is_left(spark, corpus):
    folder, rows, items, _ = corpus
    out = STAGE["benchmark_decontamination"](spark, read(spark, folder), folder)
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words_of(t)] for i in range(len(w) - 9)}
    found = {r.doc_id: r.text for r in out.collect()}
    assert {i for i, *_ in rows} - set(found) == {600}
    for text in found.values():
        w = words_of(text)
        assert not windows & {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    assert all(found[i] == t for i, t, *_ in rows if i < 500 or i >= 700)


def test_run_packs_what_the_stages_keep(spark, corpus):
    folder, *_ = corpus
    docs = read(spark, folder)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
    tokenizer = Tokenizer.from_file(bpe_file())
    want = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    got: dict = {}
    for r in p.run(spark, folder).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want


def test_empty_and_odd_tables(spark, corpus, tmp_path):
    folder, *_ = corpus
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = read(spark, folder).limit(0)
    odd = spark.createDataFrame(
        [(None, None, None, 0, "x"), (1, "", "en", 0, None), (1, "a b", None, 3, "x"), (1, "a b", None, 3, "x")],
        "doc_id long, text string, lang string, n_chars long, positions string",
    )
    for name, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        out = stage(spark, odd, str(tmp_path))
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == odd.columns, name
