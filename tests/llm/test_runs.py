"""Periodic runs against a plain program, however the words are appended."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabwright.llm.runs import Run, SquareCatcher, collapse, periodic_runs, runs_of, word_chunks


def brute(words, times=4, least=6):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if length >= max(least, times * q):
                run = words[start : start + length]
                if not any(all(run[x] == run[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append(Run(start, length, q))
            start = end + 1
    return sorted(out)


def brute_collapse(words, runs):
    gone = {i for r in runs for i in range(r.start + r.period, r.start + r.length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def appended(words, pieces, times=4, least=6):
    catcher, at = SquareCatcher(times, least), 0
    for size in pieces:
        catcher.append(np.array(words[at : at + size], np.int64))
        at += size
    catcher.append(np.array(words[at:], np.int64))
    return catcher.runs()


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 2), max_size=70), st.integers(0, 69), st.integers(1, 12), st.booleans(),
    st.lists(st.integers(0, 9), max_size=8), st.integers(3, 5), st.integers(1, 9),
)
def test_runs_equal_the_plain_program(words, a, p, repeat, pieces, times, least):
    if repeat and a < len(words):
        words = [words[a + (i - a) % p] if i >= a and a + p <= len(words) else w for i, w in enumerate(words)]
    assert appended(words, pieces, times, least) == brute(words, times, least)


@pytest.mark.parametrize(
    "words",
    [
        [0] * 500,
        ([0] * 50 + [1]) * 20,
        [1, 2] * 4,
        [1, 2] * 4 + [1],
        [5] * 6 + [1, 2, 3] * 5 + [5] * 5,
        [int(bin(i).count("1") % 2) for i in range(600)],  # the Thue-Morse word has no run of three periods
        [x for _ in range(5) for x in range(33)],
    ],
)
def test_made_words(words):
    assert runs_of([str(w).encode() for w in words]) == appended(words, [1] * len(words)) == brute(words)


def test_long_random_words():
    random.seed(5)
    words = [random.randrange(2) for _ in range(3000)]
    words[700:1900] = words[700:850] * 8
    assert appended(words, [1000, 1, 900]) == brute(words)


def test_a_text_is_read_in_pieces():
    text = "\x0b a\tb  c\n" * 200 + "end é"
    assert [w for piece in word_chunks(text, 16) for w in piece] == text.encode().split()
    runs, kept = collapse(text)
    assert runs == [Run(0, 600, 3)] and kept == "a b c end é"
    assert collapse(None) == collapse("") == collapse(" \n ") == ([], "")
    assert collapse("x " * 5) == ([], "x x x x x") and collapse("x " * 6) == ([Run(0, 6, 1)], "x")


def test_a_non_breaking_space_is_part_of_a_word():
    assert collapse("a\xa0b " * 8)[0] == [Run(0, 8, 1)]


def test_odd_tables(spark):
    long = "spam ham " * 60_000 + "tail"
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "go " * 7, "x"), (3, "go " * 7, "x"), (None, "one two " * 4, None), (4, long, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=str)
    assert out == sorted(
        [
            (1, [], ""), (2, [], ""), (3, [(0, 7, 1)], "go"), (3, [(0, 7, 1)], "go"),
            (0, [(0, 8, 2)], "one two"), (4, [(0, 120_000, 2)], "spam ham tail"),
        ], key=str,
    )
    assert periodic_runs(df.limit(0)).collect() == []
    assert periodic_runs(df).columns == ["doc_id", "runs", "collapsed"]


def test_runs_need_three_periods():
    with pytest.raises(ValueError):
        SquareCatcher(2)
