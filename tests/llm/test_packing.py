"""Packing: exact round trip of every token, full windows, and neighbours that share words."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabwright.llm import packing, tokens
from tabwright.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a \nb", "\n \n", "it's they're 'll x's",
    "tab\t x\t\t y", "nb sp   x", "x\x1c \x1cy", "<|endoftext|> and <|endoftext|>", "漢字 🙂 é́ ¼ ² x1y2", "z" * 5000,
    "word " * 3000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    rng, encoder = random.Random(4), Encoder(PATH)
    texts = ODD + ["".join(rng.choice(["a", "Be", " ", " ", "\n", "'s", "1", ".", "\t", "é"]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids if t else []
        assert encoder.ids(t).tolist() == want, repr(t)


def test_long_texts_are_encoded_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CHARS_AT_ONCE", 50)
    rng, encoder = random.Random(9), Encoder(PATH)
    for _ in range(60):
        t = "".join(rng.choice(["a", "Be", " ", "  ", "\n", " \n", "'s", "12", ".", "é"]) for _ in range(400))
        assert len(list(tokens.pieces(t))) > 3 and encoder.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("shard", [1 << 21, 3000])
def test_round_trip(spark, tokenizer, shard, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no key", "x")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(2), PATH).collect()
    ids = {i: (tokenizer.encode(t, add_special_tokens=False).ids if t else []) + [1] for i, t, _ in rows}
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == ids[i]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert total <= 2048 and total & (total - 1) == 0


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "same text")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len({r.start for r in packing.pack(frame, PATH).collect()}) >= 1
    assert sum(r.length for r in packing.pack(frame, PATH).collect()) == 3 * packing.pack(frame, PATH).first().doc_tokens
    assert packing.pack(frame.limit(0), PATH).count() == 0


def test_neighbours_share_rare_terms():
    docs = [np.array(x, np.uint16) for x in ([5, 5, 9], [7, 7, 1], [9, 3, 1], [2, 2, 1], [7, 4, 1])]
    index = packing.Index(docs)
    unused = np.ones(5, bool)
    unused[0] = False
    assert index.neighbours(0, unused)[0] == 2
    unused[1] = False
    assert index.neighbours(1, unused)[0] == 4


def topics_per_window(rows, topic_of):
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id)
    full = [w for w in windows.values() if len(w) > 2]
    return np.mean([len({topic_of(i) for i in w}) / len(w) for w in full])


@pytest.mark.parametrize("partitions", [1, 8])
def test_neighbours_are_found_in_all_partitions(spark, partitions):
    """A hundred topics in turn: windows hold few of them, however the documents are spread."""
    rng = random.Random(3)
    common = ["and", "the", "of", "in", "to", "was"]
    words = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(4)) for _ in range(3000)]
    rows = []
    for i in range(800):
        own = words[30 * (i % 100) : 30 * (i % 100) + 30]
        rows.append((i, " ".join(rng.choice(common if rng.random() < 0.3 else own) for _ in range(90))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions, "doc_id")
    out = packing.pack(docs, PATH).collect()
    found = topics_per_window(out, lambda i: i % 100)
    order = rng.sample(range(800), 800)
    by_chance = topics_per_window(out, dict(zip(range(800), (order[i] % 100 for i in range(800)))).get)
    assert found < 0.6 < 0.8 < by_chance


def test_statistics_are_those_of_the_corpus(spark, tokenizer):
    texts = ["alpha beta", "beta gamma beta", None, "", "delta"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    encoder = Encoder(PATH)
    got = packing.statistics(packing.encoded(docs, PATH, "doc_id", "text"), encoder.width)
    ids = [tokenizer.encode(t).ids if t else [] for t in texts]
    assert got.docs == 15 and abs(got.mean - (sum(map(len, ids)) / 15 + 1)) < 1e-9
    assert all(got.df[t] == sum(t in x for x in ids) for t in {t for x in ids for t in x})


def test_a_token_that_a_third_shares_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 200)
    docs = spark.range(300).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same copy' ELSE concat('text number ', id) END AS text")
    ids = packing.encoded(docs, PATH, "doc_id", "text")
    width = Encoder(PATH).width
    groups = packing.together(ids, packing.statistics(ids, width), width).groupBy("term", "tile").count().collect()
    assert sum(r["count"] for r in groups) == 300 and max(r["count"] for r in groups) <= 60


def test_crc_of_pieces(spark):
    from pyspark.sql import functions as F

    row = packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH).select("ids", F.crc32("ids")).first()
    assert row[1] == zlib.crc32(row[0])
