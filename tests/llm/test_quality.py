"""Base counts against a plain reading of their definitions, and the bands on typical texts."""

import random
import re

import pytest

from tabwright.llm import quality as q

TEXTS = [
    None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x a b c y a b c", "a a a a", "a b a b a b a b",
    "p q\np q\n\np q\n \n ", "tab\tone\x0btwo\x0cthree\rfour", "nbsp one  two\x1cthree", "#*$%&|<> <a>",
    "é ü 漢字 🙂🙂 ́", "a b c d a b c x a b", "w " * 20_000,
]


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeat = {k for i, w in enumerate(wins) if wins.count(w) > 1 for k in (i, i + 1, i + 2)} if len(words) < 999 else set(range(len(words)))
    lines = t.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat)


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert q.base_counts(text) == brute(text)


def test_random_counts():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", " ", "\n", "c ", "#", "d e "]) for _ in range(rng.randint(0, 60)))
        assert q.base_counts(t) == brute(t), repr(t)


def test_query_rows(spark):
    rng = random.Random(1)
    # words that come again, as in a language; letters at random are what the bands reject
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    prose = " ".join(words[int(400 * rng.random() ** 2)] for _ in range(900))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(5)) for _ in range(900))
    rows = [(1, prose), (2, "spam and eggs " * 400), (3, noise), (4, None), (5, "short text"), (None, prose), (1, prose)]
    frame = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "doc_id long, text string, key string, kept double")
    out = q.quality(frame).collect()
    assert sorted((str(r.doc_id), r.kept) for r in out) == sorted(
        [("1", True), ("2", False), ("3", False), ("4", False), ("5", False), ("None", True), ("1", True)]
    )
    for r in out:
        text = dict((str(k), v) for k, v in rows)[str(r.doc_id)]
        assert tuple(r)[1:6] == brute(text) or r.doc_id in (1, 2, 3, None)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert q.quality(frame.limit(0)).count() == 0


def verdict(text):
    import zstandard

    return q.compression(text.encode(), zstandard.ZstdCompressor(level=q.LEVEL))[2]


def random_words(rng, size, kind):
    out = []
    while sum(map(len, out)) + len(out) < size:
        if kind == "hex":
            out.append(f"{rng.getrandbits(32):08x}")
        elif kind == "base64":
            out.append("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(rng.randint(6, 16))))
        else:
            out.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))))
    return " ".join(out)


@pytest.mark.parametrize("size", [1_200, 1_900, 2_699, 3_900, 5_000, 22_499, 107_999])
@pytest.mark.parametrize("kind", ["hex", "base64", "letters"])
def test_random_text_goes_from_one_kilobyte_on(kind, size):
    import random

    assert not any(verdict(random_words(random.Random(i), size, kind)) for i in range(5))


@pytest.mark.parametrize("size", [372, 866])
def test_shorter_base64_goes(size):
    import random

    assert not any(verdict(random_words(random.Random(i), size, "base64")) for i in range(5))


def test_prose_stays_and_half_junk_goes(spark):
    import random
    from pathlib import Path

    folder = "/root/testdata/sf0.01/documents.parquet"
    if not Path(folder).exists():
        pytest.skip("driver tables are not here")
    prose = []
    for r in spark.read.parquet(folder).filter("text IS NOT NULL").collect():
        n_words, _, _, _, repeated = q.base_counts(r.text)
        if n_words >= q.MIN_WORDS and 100 * repeated <= q.MAX_REPEATED_PERCENT * n_words:
            prose.append(r.text)
    assert len(prose) > 500
    assert sum(not verdict(t) for t in prose) < 0.01 * len(prose)
    long = [t for t in prose if len(t) > 4_000]
    assert len(long) > 30
    for i, t in enumerate(long):
        junk = random_words(random.Random(i), len(t.encode()) + 2 * q.CHUNK_BYTES, "hex")
        assert not verdict(t + " " + junk)


def test_kept_equals_a_plain_program(spark):
    """The verdict of the query's rows, written out with zstandard alone."""
    import random

    import numpy as np
    import zstandard

    rng = random.Random(2)
    texts = [random_words(rng, n, k) for n in (300, 700, 1500, 3000, 9000) for k in ("hex", "base64", "letters")]
    texts += ["the same line again and again\n" * n for n in (3, 20, 400)] + [None, "", "short"]
    out = {r.doc_id: r for r in q.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    z = zstandard.ZstdCompressor(level=3)

    def ratios(d):
        mixed = np.random.Generator(np.random.PCG64(len(d))).permutation(np.frombuffer(d, np.uint8)).tobytes()
        return len(z.compress(d)) / len(d), len(z.compress(d)) / len(z.compress(mixed))

    def limit(table, n):
        return [row[1:] for row in table if row[0] <= n][-1]

    for i, t in enumerate(texts):
        d = (t or "").encode()
        ok = True
        if d:
            low, high = limit(q.WHOLE_BANDS, len(d))
            ok = low <= ratios(d)[0] <= high
            if len(d) < 4096:
                ok = ok and (len(d) < 1024 or ratios(d)[1] <= limit(q.ORDER_LIMITS, len(d))[1])
            else:
                cuts = [d[a : a + 2048] for a in range(0, len(d) - 2047, 2048)]
                cuts[-1] += d[2048 * len(cuts) :]
                bad = 0
                for c in cuts:
                    low, high = limit(q.CHUNK_BANDS, len(c))
                    bad += len(c) if not low <= ratios(c)[0] <= high or ratios(c)[1] > q.CHUNK_ORDER_LIMIT else 0
                ok = ok and bad <= 0.25 * len(d)
        assert out[i].kept == (ok and not out[i].base_failed), (i, len(d))
