"""Near copies by five-word shingles: candidates from walks of SimHash tries, each confirmed exactly.

Two texts are near copies when the Jaccard similarity of their sets of shingles is at
least 0.8. At that similarity 15 of 100 SimHash bits differ, so one walk with a budget of
three misses most pairs, and one with a budget that fits them compares a good part of all
pairs. Here a text has 34 fingerprints of 64 bits; each is walked as a trie twice, once with
the halves swapped. A walk allows no error in the first 8 bits, one in the first 20 and 15
in all. By the binomial law a pair of similarity 0.8 passes one walk with a probability of
0.117, and one of the 68 with 0.9997.

Pairs that pass are held against another fingerprint, then against all 2,176 bits, and
then their sets of shingles are intersected. Where both nodes of a pair have many pairs in a
task, the task gives no pairs of that dense part but only that its nodes belong together. The
nodes so brought together are a crowd. Crowds are walked again with their sets beside them, each
pair of tiles in one task that intersects what passes and gives the groups it finds. So no
table of pairs grows with the square of a group's size; the comparisons in tasks do.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh, map_batches, texts_of, written
from tabwright.llm.components import components
from tabwright.llm.minhash import LEAST, ROWS_AT_ONCE, WIDTH, confirmed, rows_kept, sets_of, shingles
from tabwright.llm.simhash import BITS, HALF, _roots, near_leaves

WORDS = 34
WALKS = 2 * WORDS
PREFIX, UPPER = 8, 20
# errors that a walk allows in the first d bits
ALLOWED = np.repeat([0, 1, 15], [PREFIX + 1, UPPER - PREFIX, BITS - UPPER])
# bits of one other fingerprint, and share of all bits, that may differ: 15 of 100 do at a
# similarity of 0.8, up to 19 where the sets have very few shingles
MATE, APART, APART_FEW, FEW = 20, 0.19, 0.23, 32
TILE = 16_384  # nodes in one side of a task
PAIRS = 4  # a pair of nodes that both have more pairs in a task is left to the walk of crowds
# nodes in one side of a task on a crowd; a set counts as one more node for so many shingles
CROWD, SET = 2_048, 256
CHECKS_AT_ONCE = 1 << 14
MARKS_AT_ONCE = 1 << 10


@cache
def _factors() -> np.ndarray:
    """An odd factor per fingerprint, again and again: long arrays multiply faster than short rows."""
    return np.tile(np.random.default_rng(8).integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1), MARKS_AT_ONCE)


def _hashes(marks: np.ndarray) -> np.ndarray:
    """A row per shingle with a hash per fingerprint."""
    out = np.repeat(marks, WORDS)
    out *= _factors()[: len(out)]
    out ^= out >> np.uint64(HALF)
    return out.reshape(-1, WORDS)


def signature(marks: np.ndarray) -> bytes | None:
    """The fingerprints of a set of shingles: a bit is 1 if set in over half the hashes."""
    if not len(marks):
        return None
    votes = np.zeros(WORDS * BITS, np.int64)
    for at in range(0, len(marks), MARKS_AT_ONCE):
        rows, weight = _hashes(marks[at : at + MARKS_AT_ONCE]), 1
        while len(rows):
            # three rows become their sum and their carry, bit by bit
            carries = []
            while (third := len(rows) // 3) >= 2:
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                odd = a ^ b
                carries.append((a & b) | (c & odd))
                rows = np.concatenate([odd ^ c, rows[3 * third :]])
            votes += weight * np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8).astype(np.int64)
            rows, weight = np.concatenate(carries) if carries else rows[:0], weight * 2
    return np.packbits(votes * 2 > len(marks), bitorder="little").tobytes()


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WORDS)


def prints(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """``(key, node, n, sig)``, a row per input row; ``node`` is a hash of the set of ``n`` shingles."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, width) for t in texts_of(batch, "t")]
        nodes = [xxhash.xxh64_intdigest(s.astype("<u8").tobytes()) - (1 << 63) for s in sets]
        return {"key": batch.column("k"), "node": nodes, "n": list(map(len, sets)), "sig": list(map(signature, sets))}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_batches(rows, run, f"key {kind}, node bigint, n int, sig binary", ROWS_AT_ONCE)


def _walked(words: np.ndarray) -> np.ndarray:
    """A row per node with its fingerprint for each walk."""
    return np.concatenate([words, (words << np.uint64(HALF)) | (words >> np.uint64(HALF))], axis=1)


def _mates(words: np.ndarray) -> np.ndarray:
    """A row per node with the other fingerprint that pairs of each walk are held against."""
    return np.tile(np.roll(words, -1, axis=1), 2)


def _rank(x: np.ndarray) -> np.ndarray:
    """How often each value came before."""
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(x[order]) != 0][: len(x)])
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
    return out


def meetings(nodes: DataFrame, most: int, tile: int = TILE) -> DataFrame:
    """``nodes(node, sig)`` to pairs ``(a, b)``, a > b, that pass a walk.

    Pairs of which both nodes have ``most`` pairs in a task already are not given, nor any other pair
    of the nodes that pairs of the task connect with them. Each of those nodes is linked to
    one of them instead, as ``(a, b)`` with a < b.
    """
    depth = min(PREFIX, max(0, math.ceil(math.log2(max(nodes.count(), 1) / tile)) + 1))

    def loads(batch: pa.RecordBatch) -> dict:
        homes = _walked(_words(batch.column("sig"))) >> np.uint64(BITS - depth) if depth else np.zeros((batch.num_rows, WALKS), np.uint64)
        at, n = np.unique(homes.astype(np.int64) + (np.arange(WALKS) << depth), return_counts=True)
        return {"walk": at >> depth, "home": at & ((1 << depth) - 1), "n": n}

    def spread(batch: pa.RecordBatch) -> dict:
        words = _words(batch.column("sig"))
        return {
            "walk": np.tile(np.arange(WALKS), len(words)),
            "word": _walked(words).ravel().view(np.int64),
            "mate": _mates(words).ravel().view(np.int64),
            "node": np.repeat(batch.column("node").to_numpy(), WALKS),
        }

    heavy = (
        map_batches(nodes.select("sig"), loads, "walk int, home int, n bigint")
        .groupBy("walk", "home").agg(F.ceil(F.sum("n") / tile).cast("int").alias("tiles"))
        .filter("tiles > 1")
    )
    heavy = written(heavy, "heavy")
    rows = map_batches(nodes, spread, "walk int, word bigint, mate bigint, node bigint", ROWS_AT_ONCE)
    rows = rows.withColumn("home", F.expr(f"cast(shiftrightunsigned(word, {BITS - depth}) as int)") if depth else F.lit(0))
    sides = ["walk", "home", "word", "mate", "node"]
    if heavy.isEmpty():
        rows = rows.select(*sides, F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(True).alias("first"))
    else:
        # each pair of tiles is a task of its own
        rows = (
            rows.join(heavy, ["walk", "home"], "left")
            .withColumn("mine", F.expr("cast(pmod(xxhash64(node), coalesce(tiles, 1)) as int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, coalesce(tiles, 1) - 1)")))
            .select(*sides, F.least("mine", "other").alias("s"), F.greatest("mine", "other").alias("t"), F.expr("mine <= other").alias("first"))
        )

    def join_nodes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alone = key[2] == key[3]
        parts = [rows] if alone else [rows[rows["first"]], rows[~rows["first"]]]
        parts = [p.iloc[np.argsort(p["word"].to_numpy().view(np.uint64), kind="stable")] for p in parts]
        left, right = ({c: p[c].to_numpy() for c in ("word", "mate", "node")} for p in (parts[0], parts[-1]))
        nodes = left["node"] if alone else np.concatenate([left["node"], right["node"]])
        after = 0 if alone else len(left["node"])
        parent, given, full = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
        found = [np.empty((2, 0), np.int64)]
        walk = near_leaves(left["word"].view(np.uint64), None if alone else right["word"].view(np.uint64), depth, ALLOWED, int(ALLOWED[-1]))
        for i, j in walk:
            near = np.bitwise_count(left["mate"].view(np.uint64)[i] ^ right["mate"].view(np.uint64)[j]) <= MATE
            if alone:
                near &= i < j
            i, j = i[near], j[near] + after
            _roots(parent, i, j)
            room = (given[i] + _rank(i) < most) | (given[j] + _rank(j) < most)
            np.add.at(given, i[room], 1)
            np.add.at(given, j[room], 1)
            found.append(np.array([i[room], j[room]]))
            full[i[~room]] = True
        crowded = np.zeros(len(nodes), bool)
        crowded[parent[full]] = True
        i, j = np.concatenate(found, axis=1)
        open_ = ~crowded[parent[i]]
        a, b = nodes[i[open_]], nodes[j[open_]]
        inside = np.flatnonzero(crowded[parent] & (parent != np.arange(len(nodes))))
        c, d = nodes[inside], nodes[parent[inside]]
        return pd.DataFrame({"a": np.r_[np.maximum(a, b), np.minimum(c, d)], "b": np.r_[np.minimum(a, b), np.maximum(c, d)]})

    return rows.groupBy("walk", "home", "s", "t").applyInPandas(join_nodes, "a bigint, b bigint")


class _Sets:
    """The sets of shingles of some nodes, ascending ids of the shingles in one array."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array(list(map(len, sets)))
        self.at = np.cumsum(self.n) - self.n
        marks, self.ids, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.flags = np.zeros(len(marks), bool)
        # shingles that another of the nodes has too: no intersection is larger
        self.shared = np.add.reduceat(held[self.ids] > 1, self.at, dtype=np.int64)

    def possible(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        return self._enough(i, j, np.minimum(self.shared[i], self.shared[j]), least)

    def similar(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        both = np.empty(len(i), np.int64)
        order = np.argsort(i, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
            mine, others = i[part[0]], j[part]
            own = self.ids[self.at[mine] : self.at[mine] + self.n[mine]]
            self.flags[own] = True
            n = self.n[others]
            start = np.cumsum(n) - n
            places = np.repeat(self.at[others] - start, n) + np.arange(n.sum())
            both[part] = np.add.reduceat(self.flags[self.ids[places]], start, dtype=np.int64)
            self.flags[own] = False
        return self._enough(i, j, both, least)

    def _enough(self, i: np.ndarray, j: np.ndarray, both: np.ndarray, least: float) -> np.ndarray:
        return both >= least * (self.n[i] + self.n[j] - both)


def crowd_links(crowds: DataFrame, least: float = LEAST, tile: int = CROWD) -> DataFrame:
    """``crowds(crowd, node, sig, marks)`` to links ``(a, b)`` that join all nodes of a crowd that pass a walk and
    are similar enough. A task gives a link per node at most."""
    loads = crowds.groupBy("crowd").agg(F.ceil(F.sum(1 + F.size("marks") / SET) / tile).cast("int").alias("tiles")).filter("tiles > 1")
    # each pair of tiles is a task of its own
    rows = (
        crowds.join(written(loads, "crowded"), "crowd", "left")
        .withColumn("mine", F.expr("cast(pmod(xxhash64(node), coalesce(tiles, 1)) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, coalesce(tiles, 1) - 1)")))
        .select("crowd", "node", "sig", "marks", F.least("mine", "other").alias("s"), F.greatest("mine", "other").alias("t"), F.expr("mine <= other").alias("first"))
    )

    def join_nodes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alone = key[1] == key[2]
        nodes, first = rows["node"].to_numpy(), rows["first"].to_numpy()
        sides = [np.arange(len(nodes))] if alone else [np.flatnonzero(first), np.flatnonzero(~first)]
        words = _words(pa.array(rows["sig"]))
        walked, mates, sets = _walked(words), _mates(words), _Sets(list(rows["marks"]))
        parent = np.arange(len(nodes))
        for walk in range(WALKS):
            word, mate = walked[:, walk], mates[:, walk]
            left, right = (x[np.argsort(word[x], kind="stable")] for x in (sides[0], sides[-1]))
            for i, j in near_leaves(word[left], None if alone else word[right], 0, ALLOWED, int(ALLOWED[-1])):
                if alone:
                    i, j = i[i < j], j[i < j]
                i, j = left[i], right[j]
                near = (np.bitwise_count(mate[i] ^ mate[j]) <= MATE) & sets.possible(i, j, least)
                i, j = i[near], j[near]
                # nodes that are joined already need no look at their sets
                while len(i := i[open_ := parent[i] != parent[j]]):
                    j = j[open_]
                    a, b, i, j = i[:CHECKS_AT_ONCE], j[:CHECKS_AT_ONCE], i[CHECKS_AT_ONCE:], j[CHECKS_AT_ONCE:]
                    links = sets.similar(a, b, least)
                    _roots(parent, a[links], b[links])
        joined = parent != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[joined], "b": nodes[parent[joined]]})

    return rows.groupBy("crowd", "s", "t").applyInPandas(join_nodes, "a bigint, b bigint")


def close(pairs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs ``(a, b)`` that all bits and the sizes of their sets leave possible."""
    of_a, of_b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")

    def run(batch: pa.RecordBatch) -> dict:
        n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        apart = np.bitwise_count(_words(batch.column("sig_a")) ^ _words(batch.column("sig_b"))).sum(1, dtype=np.int64)
        large = np.maximum(n, m)
        near = pa.array((apart <= np.where(large < FEW, APART_FEW, APART) * WORDS * BITS) & (np.minimum(n, m) >= least * large))
        return {c: batch.column(c).filter(near) for c in "ab"}

    return map_batches(pairs.join(of_a, "a").join(of_b, "b"), run, "a bigint, b bigint", 4 * ROWS_AT_ONCE)


def first_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, width: int = WIDTH, most: int = PAIRS, tile: int = TILE
) -> DataFrame:
    """The documents, all columns, without those that link to an earlier one.

    Of a group the row with the smallest key stays (nulls last, then by text hash); of
    rows that repeat both key and text, one. Texts without a word are one group. Walks are
    laid out for a ``least`` of 0.8 or more.
    """
    if least < LEAST:
        raise ValueError(f"the walks are worked out for a similarity of at least {LEAST}")
    who = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
    own = fresh(docs, "_who")
    here = docs.withColumn(own, who)
    seen = written(prints(here, own, text, width), "prints")
    nodes = written(seen.groupBy("node").agg(F.min("key").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    texts = here.select(F.col(own).alias("low"), F.col(text).alias("t"))
    worded = nodes.filter("sig is not null").select("node", "n", "sig")
    met = written(meetings(worded.select("node", "sig"), most, tile), "met")
    pairs = written(close(met.filter("a > b").distinct(), worded, least), "candidates")
    links = confirmed(pairs, written(sets_of(pairs, nodes, texts, width), "shingles"), least)
    dense = met.filter("a < b").distinct()
    if not dense.isEmpty():
        crowds = written(components(dense), "crowds")
        sets = sets_of(crowds.selectExpr("node a", "root b"), nodes, texts, width)
        crowds = crowds.withColumnRenamed("root", "crowd").join(worded.select("node", "sig"), "node").join(sets, "node")
        links = links.unionByName(crowd_links(written(crowds, "crowd-sets"), least, min(tile, CROWD)))
    return rows_kept(here, own, seen, nodes, components(links))
