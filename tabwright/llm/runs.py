"""Periodic runs of words by online dyadic square catching.

Words are appended, and each completed block of a power of two ``b`` has a catcher: it looks
for the block again from ``b`` to under ``2 b`` words further on, as the words arrive. A block
met again ``q`` words on starts a suffix comparison at the period ``q``. Where ``q`` words in a
row equal those ``q`` before there is a square; squares at neighbouring places are one run.

A run of at least ``times`` (3 or more) periods holds ``times - 2`` neighbouring blocks of the level
``b <= q < 2 b`` that all come again at ``q``, so only those are compared. Blocks are told apart
by sums of hashes over a prefix array: equal blocks never differ, and what was caught is
compared word by word. With ``n`` words a level costs ``n`` comparisons in numpy, so
the whole costs ``n log n``, also for a text of one word repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, texts_of

TIMES, LEAST = 4, 6
CHUNK = 1 << 20
WHITE = re.compile(rb"[\x20\x09-\x0d]")
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers never vanish


class Ids(dict):
    """Numbers for words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def word_chunks(text: str, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words between ASCII white space, about ``size`` bytes of text at a time."""
    data, at = text.encode(), 0
    while at < len(data):
        gap = WHITE.search(data, at + size) if at + size < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def mixed(ids: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers for word numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * BASE
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True, order=True)
class Run:
    start: int
    length: int
    period: int


class SquareCatcher:
    """Appended words to runs of at least ``times`` periods and ``least`` words.

    ``append`` takes any number of words; the runs do not depend on how they are cut.
    """

    def __init__(self, times: int = TIMES, least: int = LEAST) -> None:
        if times < 3:
            raise ValueError("a run needs at least three periods")
        self.times, self.least = times, least
        self.n = 0
        self._ids = np.empty(0, np.int64)
        self._sums = np.zeros(1, np.uint64)  # sums[i]: hash * base ** place over the first i words
        self._powers = np.ones(1, np.uint64)
        self._seen: dict[int, int] = {}  # level: windows that its catchers have met
        self._caught: dict[int, list[np.ndarray]] = {}

    def append(self, ids: np.ndarray) -> None:
        ids = np.asarray(ids, np.int64)
        if self.n + len(ids) >= len(self._ids):
            self._grow(self.n + len(ids))
        n, m = self.n, self.n + len(ids)
        self._ids[n:m] = ids
        self._sums[n + 1 : m + 1] = self._sums[n] + np.cumsum(mixed(ids) * self._powers[n:m], dtype=np.uint64)
        self.n = m
        b = 1
        while self.times * b <= m:
            self._catch(b)
            b *= 2

    def _grow(self, n: int) -> None:
        room = max(64, n + n // 2)
        self._ids = np.concatenate([self._ids[: self.n], np.empty(room - self.n, np.int64)])
        self._sums = np.concatenate([self._sums[: self.n + 1], np.empty(room - self.n, np.uint64)])
        more = np.concatenate([self._powers[-1:], np.full(room + 1 - len(self._powers), BASE)])
        self._powers = np.concatenate([self._powers, np.multiply.accumulate(more)[1:]])

    def _catch(self, b: int) -> None:
        """Let the catchers of a level meet the windows that the new words complete."""
        rows = (self.n - b + 1 - b) // b  # windows come in rows: row j belongs to block j
        done = self._seen.get(b, 0)
        if rows <= done:
            return
        # each window is scaled up to the power of its row's end, each block to that of the same end
        first, last = done * b + b, rows * b + b
        windows = (self._sums[first + b : last + b] - self._sums[first:last]).reshape(-1, b)
        blocks = (self._sums[done * b + b : rows * b + b : b] - self._sums[done * b : rows * b : b])[:, None]
        # a window q words further on has b ** q times the sum of its block
        hit = windows == blocks * self._powers[b : 2 * b]
        row, col = np.nonzero(hit)
        if len(row):
            self._caught.setdefault(b, []).append(np.stack([col + b, row + done]))
        self._seen[b] = rows

    def runs(self) -> list[Run]:
        """The runs among the words so far, by start and period."""
        found: dict[tuple[int, int], int] = {}
        reach = np.zeros(self.n + 1, np.int64)  # the end of the furthest known run at a place
        b = 1
        while self.times * b <= self.n:
            # the row that is not full yet is met here, window by window
            self._settle(b, found, reach)
            b *= 2
        return sorted(Run(start, end - start, q) for (start, end), q in found.items())

    def _settle(self, b: int, found: dict, reach: np.ndarray) -> None:
        period, block = self._met(b)
        if not len(period):
            return
        need = self.times - 2
        # inside a known run of a smaller period a block meets itself at multiples of that period
        begin = block * b
        open_ = reach[begin] < np.minimum(begin + period + need * b, self.n)
        period, block = period[open_], block[open_]
        order = np.lexsort((block, period))
        period, block = period[order], block[order]
        cut = np.flatnonzero((np.diff(period) != 0) | (np.diff(block) != 1)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(period)]])
        new = []
        for i in np.flatnonzero(ends - starts >= need) if len(period) else ():
            q, low, high = int(period[starts[i]]), int(block[starts[i]]) * b, (int(block[ends[i] - 1]) + 1) * b
            new += self._compare(q, low, high, b)
        for start, end, q in new:
            if (start, end) not in found and end - start >= max(self.least, self.times * q):
                found[start, end] = q
                reach[start:end] = np.maximum(reach[start:end], end)

    def _met(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Periods and block numbers that the catchers of a level met."""
        parts = list(self._caught.get(b, ()))
        rows = self._seen.get(b, 0)
        first, last = rows * b + b, self.n - b + 1
        if last > first and (rows + 1) * b <= self.n:
            windows = self._sums[first + b : last + b] - self._sums[first:last]
            block = self._sums[rows * b + b :][:1] - self._sums[rows * b :][:1]
            col = np.flatnonzero(windows == block * self._powers[b : b + len(windows)])
            parts.append(np.stack([col + b, np.full(len(col), rows)]))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(parts, axis=1))

    def _compare(self, q: int, low: int, high: int, b: int) -> list[tuple[int, int, int]]:
        """Stretches around ``low`` to ``high`` whose words equal those ``q`` further on."""
        low, high = max(0, low - b), min(high + b, self.n - q)
        ids = self._ids
        same = ids[low:high] == ids[low + q : high + q]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        out = []
        for start, end in zip(edges[::2] + low, edges[1::2] + low):
            if end - start + q >= max(self.least, self.times * q):
                out.append((int(start), int(end) + q, q))
        return out


def runs_of(words: list[bytes], times: int = TIMES, least: int = LEAST) -> list[Run]:
    ids = Ids()
    catcher = SquareCatcher(times, least)
    catcher.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    return catcher.runs()


def collapse(text: str | None, times: int = TIMES, least: int = LEAST) -> tuple[list[Run], str]:
    """Runs of a text, and its words without those after the first period of a run, joined by a space."""
    ids, catcher = Ids(), SquareCatcher(times, least)
    for words in word_chunks(text or ""):
        catcher.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    runs = catcher.runs()
    if not runs:
        return runs, b" ".join(w for words in word_chunks(text or "") for w in words).decode()
    kept = np.ones(catcher.n, bool)
    for r in runs:
        kept[r.start + r.period : r.start + r.length] = False
    out, at = [], 0
    for words in word_chunks(text or ""):
        out += [words[i] for i in np.flatnonzero(kept[at : at + len(words)])]
        at += len(words)
    return runs, b" ".join(out).decode()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """``(key, runs, collapsed)``, a row per input row.

    ``runs`` are structs ``start, length, period`` in words, by start and period: all stretches of at
    least ``times`` periods and ``least`` words that no neighbouring word extends, with their
    smallest period. ``collapsed`` is the text without the repetitions, its words joined by one
    space. Null, empty and blank texts have no runs and an empty ``collapsed``. Repeated rows and
    null keys are rows like others; other columns are not read. A text of any length is read in
    pieces; numbers of its words are held, eight bytes each, and three such arrays.
    """

    def run(batch):
        found = [collapse(t, times, least) for t in texts_of(batch, "t")]
        return {
            "k": batch.column("k"),
            "runs": [[{"start": r.start, "length": r.length, "period": r.period} for r in runs] for runs, _ in found],
            "collapsed": [c for _, c in found],
        }

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    out = map_batches(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")), run, schema, rows=1024)
    return out.withColumnRenamed("k", key)
