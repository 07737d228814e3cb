"""The registered queries over the driver's smallest tables: SQL or plain programs."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from compare import compare, connect
from tabwright.llm import quality, recount
from tabwright.llm.catalog import QUERIES, SQL
from tests.llm.test_lines import reference
from tests.llm.test_quality import brute as base_counts
from tests.llm.test_runs import brute as brute_runs
from tests.llm.test_runs import brute_collapse
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_spelling import brute_forms, brute_words

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name)[0] == "ok"


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_language(spark, docs):
    out = rows(spark, "op3_language_filters")
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in out if r.held_out]) > 0.95


def test_lines(spark, docs):
    out = {r.doc_id: r for r in rows(spark, "op4_line_alignment")}
    assert out.keys() == docs.keys()
    gone = reference([(i, docs[i].text) for i in sorted(docs)], 40)
    for i in docs:
        assert out[i].text == "\n".join(x for k, x in enumerate(docs[i].text.split("\n")) if k not in gone[i])
        assert out[i].removed_lines == len(gone[i])
    assert sum(r.removed_lines > 0 for r in out.values()) > 0


def test_counts(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = lambda text: len(t.encode(text, add_special_tokens=False).ids)
    edited = 0
    for r in rows(spark, "op5_edit_aware_counts"):
        text = docs[r.doc_id].text
        cuts = [(m.start(), m.end(), new) for p, new in recount.MASKS for m in re.finditer(p, text)]
        at, seen = 0, set()
        for line in text.split("\n"):
            if line and line in seen:
                cuts.append((at - 1, at + len(line), ""))
            seen.add(line)
            at += len(line) + 1
        out, done = [], 0
        for start, end, new in sorted(cuts):
            if start >= done:
                out += [text[done:start], new]
                done = end
        assert (r.n_tokens, r.n_tokens_edited) == (size(text), size("".join(out) + text[done:]))
        edited += r.n_edits > 0
    assert edited


def test_quality(spark, docs):
    out = rows(spark, "op6_compression_bands")
    assert len(out) == len(docs)
    for r in out:
        if len(docs[r.doc_id].text) < 3000:
            assert tuple(r)[1:6] == base_counts(docs[r.doc_id].text)
        assert r.base_failed == (r.n_words < quality.MIN_WORDS or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_main_text(spark):
    import html
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    out = rows(spark, "op7_text_blocks")
    assert len(out) == len(pages)
    for r in out:
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_simhash(spark, docs):
    ids = sorted(docs)
    marks = [brute_fingerprint(docs[i].text) for i in ids]
    want = {i: (f"{m:016x}", ids[low]) for i, m, low in zip(ids, marks, brute_components(marks))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op8_simhash_trie")} == want


def test_packing(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: t.encode(d.text, add_special_tokens=False).ids + [1] for i, d in docs.items()}
    at, lengths = defaultdict(int), defaultdict(int)
    for r in sorted(rows(spark, "op9_bm25_packing"), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece)
        at[r.doc_id] += r.length
        lengths[r.sequence_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    assert all(n <= 2048 and n & (n - 1) == 0 for n in lengths.values())


def test_spelling(spark, docs):
    words = brute_words([(i, d.text) for i, d in docs.items()], typos=97)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows(spark, "op11_spelling_chunks")}
    assert got == brute_forms(words) and len(got) > 100


def test_shards(spark, docs):
    out = rows(spark, "op12_external_shuffle")
    assert sorted(r.doc_id for r in out) == sorted(docs)
    slots = defaultdict(list)
    for r in out:
        data = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(x) == list(range(5)) for x in slots.values())


def repeated(key, words):
    """The contract's planted repetition, written word by word."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_runs(spark, docs):
    sha, met = (lambda t: hashlib.sha256(t.encode()).hexdigest()), 0
    for r in rows(spark, "op13_square_catcher"):
        words = repeated(r.doc_id, [w.decode() for w in docs[r.doc_id].text.encode().split()])
        if len(words) > 1500:
            continue
        found = brute_runs(words)
        met += bool(found)
        top = min(found, key=lambda x: (-x.length, x.start, x.period), default=None)
        want = (top.start, top.length, top.period, 1000 * top.length // top.period) if top else (None,) * 4
        assert tuple(r)[1:] == (
            len(found), *want, sha("".join(f"{x.start},{x.length},{x.period}\n" for x in found)),
            sha(brute_collapse(words, found)),
        )
    assert met >= 10
