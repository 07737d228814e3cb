"""SimHash near-duplicates by a self-join of a binary trie.

A fingerprint has 64 bits, one vote per shingle and bit. Distinct fingerprints,
sorted, are the leaves of a binary trie: a node is a range of them. The self-join
walks pairs of nodes from the root, splits both at the next bit, adds one to the
pair's error where the bits differ, and drops the pair when its budget is used up.

At most three differing bits leave at most one in one half of the bits, so the
trie is walked twice, once with the halves swapped, with a budget of one in the
upper half and of three below. That keeps the number of live pairs near the number
of fingerprints. The upper levels are walked as Spark keys: a fingerprint goes to
its own prefix and to the prefixes one bit away. A prefix with too many
fingerprints is dealt into tiles, and each pair of tiles is a task of its own, so
no group grows with the data. A task gives a link from every fingerprint to the
smallest one that it found connected, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh, map_batches, texts_of, written
from tabwright.llm.components import components

BITS, HALF = 64, 32
TILE = 16_384  # fingerprints in one side of a task
MAX_PREFIX = 20
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 19
BRUTE = 16  # a node pair with at most so many leaf pairs is compared leaf by leaf


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Words split at ASCII white space, A-Z lower-cased; no word gives zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        part = shingles[at : at + SHINGLES_AT_ONCE]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in part), "<u8", len(part))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, width: int = 3) -> DataFrame:
    """``(key, fp)``, a row per input row; ``fp`` holds the 64 bits as a signed long."""

    def run(batch):
        marks = np.array([fingerprint(t, width) for t in texts_of(batch, "t")], np.uint64)
        return {"key": batch.column("k"), "fp": marks.view(np.int64)}

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"key {kind}, fp bigint")


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge linked leaves in ``parent``, an array of roots by leaf."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def trie_links(left: np.ndarray, right: np.ndarray | None, start: int, budget: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints of a node pair whose first ``start`` bits are walked already.

    ``right`` None joins ``left`` with itself. Returns every fingerprint that is
    linked, with the smallest one that links reach inside this pair of nodes.
    """
    leaves = np.unique(left if right is None else np.concatenate([left, right]))
    parent = np.arange(len(leaves))
    lefts = np.unique(left)
    rights = lefts if right is None else np.unique(right)
    at_l, at_r = np.searchsorted(leaves, lefts), np.searchsorted(leaves, rights)
    allowed = np.where(np.arange(BITS + 1) <= HALF, 1, budget)
    for i, j in near_leaves(lefts, None if right is None else rights, start, allowed, budget):
        _roots(parent, at_l[i], at_r[j])
    linked = parent != np.arange(len(leaves))
    return leaves[linked], leaves[parent[linked]]


def near_leaves(
    lefts: np.ndarray, right: np.ndarray | None, start: int, allowed: np.ndarray, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk two sorted arrays of fingerprints as tries; yields the places of leaves with at most ``budget`` differing bits.

    A pair of nodes goes on while its error in the first d bits is at most ``allowed[d]``. ``right`` None joins
    ``lefts`` with itself; then a place also meets itself, and some pairs come in both orders.
    """
    rights = lefts if right is None else right
    one, stack = np.array([0]), []
    if len(lefts) and len(rights):
        walked = (lefts[:1] ^ rights[:1]) >> np.uint64(BITS - start) if start else one
        stack.append((start, one, one + len(lefts), one, one + len(rights), np.bitwise_count(walked).astype(int)))
    while stack:
        depth, la, lb, ra, rb, err = stack.pop()
        if len(la) > PAIRS_AT_ONCE:
            half = len(la) // 2
            stack.append((depth, la[half:], lb[half:], ra[half:], rb[half:], err[half:]))
            stack.append((depth, la[:half], lb[:half], ra[:half], rb[:half], err[:half]))
            continue
        small = ((lb - la) * (rb - ra) <= BRUTE) | (depth >= BITS)
        if small.any():
            yield from _compare(lefts, rights, la[small], lb[small], ra[small], rb[small], budget)
            la, lb, ra, rb, err = (x[~small] for x in (la, lb, ra, rb, err))
        if not len(la):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        above = np.uint64((1 << BITS) - (1 << (BITS - depth)))
        lm = np.searchsorted(lefts, (lefts[la] & above) | bit)
        rm = np.searchsorted(rights, (rights[ra] & above) | bit)
        grown = []
        for l_from, l_to, l_bit in ((la, lm, 0), (lm, lb, 1)):
            for r_from, r_to, r_bit in ((ra, rm, 0), (rm, rb, 1)):
                if right is None and l_bit > r_bit:
                    # of two equal nodes the mirrored pair is the same pair
                    keep = (la != ra) | (lb != rb)
                else:
                    keep = np.ones(len(la), bool)
                e = err + (l_bit != r_bit)
                keep &= (l_from < l_to) & (r_from < r_to) & (e <= allowed[depth + 1])
                grown.append(tuple(x[keep] for x in (l_from, l_to, r_from, r_to, e)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*grown))))


def _compare(lefts, rights, la, lb, ra, rb, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare the leaves of small node pairs; yields the places of those within the budget."""
    wide = rb - ra
    counts = (lb - la) * wide
    huge = counts > 4 * PAIRS_AT_ONCE
    for k in np.flatnonzero(huge):  # only arrays that repeat leaves have such pairs
        cuts = np.arange(la[k], lb[k] + (step := max(1, 4 * PAIRS_AT_ONCE // wide[k])), step).clip(max=lb[k])
        for at, to in zip(cuts[:-1], cuts[1:]):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(at, to), np.arange(ra[k], rb[k]), indexing="ij"))
            near = np.bitwise_count(lefts[i] ^ rights[j]) <= budget
            yield i[near], j[near]
    la, ra, wide, counts = (x[~huge] for x in (la, ra, wide, counts))
    for chunk in np.array_split(np.arange(len(la)), max(1, int(counts.sum()) // (4 * PAIRS_AT_ONCE) + 1)):
        n = counts[chunk]
        pair = np.repeat(chunk, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = la[pair] + inside // wide[pair], ra[pair] + inside % wide[pair]
        near = np.bitwise_count(lefts[i] ^ rights[j]) <= budget
        yield i[near], j[near]


def _swapped(fp: np.ndarray) -> np.ndarray:
    return (fp << np.uint64(HALF)) | (fp >> np.uint64(HALF))


def links(marks: DataFrame, budget: int = 3, tile: int = TILE) -> DataFrame:
    """``marks(fp)`` distinct longs to star links ``(a, b)``; at most ``budget`` = 3 bits differ along a link."""
    if not 0 <= budget <= 3:
        raise ValueError("the halves' budget is worked out for at most three differing bits")
    n = marks.count()
    depth = min(MAX_PREFIX, max(0, math.ceil(math.log2(max(n, 1) / tile)) + 2))
    high = F.expr(f"cast(shiftrightunsigned(fp, {BITS - depth}) as int)") if depth else F.lit(0)
    turned = marks.select("fp", F.lit(0).alias("turn")).unionByName(
        marks.select(F.expr(f"shiftleft(fp, {HALF}) | shiftrightunsigned(fp, {HALF})").alias("fp"), F.lit(1).alias("turn"))
    )
    homes = turned.withColumn("home", high)
    tiles = (
        homes.groupBy("turn", F.col("home").alias("there")).count()
        .select("turn", "there", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
        .filter("tiles > 1")
    )
    flips = ", ".join(["home", *(f"home ^ {1 << i}" for i in range(depth))])
    # tile numbers come from the fingerprint alone, so a row knows its own without a count
    near = (
        homes.withColumn("there", F.explode(F.expr(f"array({flips})")))
        .join(tiles, ["turn", "there"], "left")
        .join(tiles.select("turn", F.col("there").alias("home"), F.col("tiles").alias("own")), ["turn", "home"], "left")
        .withColumn("mine", F.expr("cast(pmod(xxhash64(fp), coalesce(own, 1)) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, coalesce(tiles, 1) - 1)")))
        .withColumn("first", F.expr("home < there or (home = there and mine <= other)"))
        .select(
            "fp", "turn",
            F.expr("if(first, home, there)").alias("p"), F.expr("if(first, there, home)").alias("q"),
            F.expr("if(first, mine, other)").alias("s"), F.expr("if(first, other, mine)").alias("t"),
            F.expr("home = there and mine = other").alias("alone"), "first",
        )
    )

    def join_nodes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        first = rows["first"].to_numpy()
        right = None if rows["alone"].iloc[0] else fp[~first]
        a, b = trie_links(fp[first], right, depth, budget)
        if key[0]:
            a, b = _swapped(a), _swapped(b)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return near.groupBy("turn", "p", "q", "s", "t").applyInPandas(join_nodes, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 3, width: int = 3) -> DataFrame:
    """``(key, fp, component)``: a row per document, ``component`` the smallest key reachable over links.

    Equal fingerprints are one leaf, so exact copies cost nothing beyond their own
    row. Null and wordless texts share fingerprint zero and are linked like others.
    Null keys never name a component; a component of null keys alone is null.
    """
    prints = written(fingerprints(docs.select(F.col(key).alias("key"), text), "key", text, width), "fingerprints")
    grouped = grouped_prints(prints, F.min("key").alias("low"), budget)
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component"))
    named = grouped.join(lowest, "root").select("fp", "component")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def grouped_prints(prints: DataFrame, lowest: Column, budget: int = 3) -> DataFrame:
    """``(fp, low, n, root)``: a row per distinct fingerprint, ``root`` naming its component."""
    marks = written(prints.groupBy("fp").agg(lowest, F.count("*").alias("n")), "marks")
    roots = components(links(marks.select("fp"), budget))
    return marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 3) -> DataFrame:
    """The documents, all columns, without those that link to an earlier one.

    Of a component the row with the smallest key stays (nulls last, then by text
    hash); of rows that repeat both key and text, one.
    """
    who = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
    prints = written(fingerprints(docs.select(who.alias("key"), text), "key", text), "fingerprints")
    low = F.min("key").alias("low")
    kept = grouped_prints(prints, low, budget).groupBy("root").agg(F.min("low").alias("key"))
    # how often the row that stays occurs: only repeated rows need a further look
    kept = written(kept.join(prints, ["key"]).groupBy("key").agg(F.count("*").alias("copies")), "kept")
    own = fresh(docs, "_who")
    here = docs.withColumn(own, who)
    once = here.join(kept.filter("copies = 1").select(F.col("key").alias(own)), own, "left_semi")
    more = here.join(kept.filter("copies > 1").select(F.col("key").alias(own)), own, "left_semi")
    return once.unionByName(more.dropDuplicates([own])).drop(own)
