"""Near copies by five-word shingles: candidates from MinHash bands, each confirmed exactly.

Two texts are near copies when the Jaccard similarity of their sets of shingles is at
least 0.8. At that similarity about ten of 64 SimHash bits differ, which no walk of a
trie finds without comparing a good part of all pairs; so the candidates come from bands
of minima here, and SimHash with three bits stays a query of its own.

Texts with the same set of shingles are one node. A node goes to a bucket per band; in
a bucket every node is a candidate with the smallest and the largest node, so buckets
give links and never their pairs. A candidate counts after its two sets of shingles
were intersected; the confirmed links are grouped by star rounds over written tables.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh, map_batches, texts_of, written
from tabwright.llm.components import components

WIDTH = 5
LEAST = 0.8
# A pair of similarity s shares a bucket with probability 1 - (1 - s**ROWS) ** BANDS, which
# is 0.9996 at 0.8.
BANDS, ROWS = 20, 5
SHINGLES_AT_ONCE = 1 << 10
ROWS_AT_ONCE = 256  # rows of one batch that is given back; sets are larger than their texts


def shingles(text: str | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; words are those of ``simhash.fingerprint``,
    fewer than ``width`` words are one shingle and no word gives none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in parts), np.uint64))


@cache
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return a | np.uint64(1), b


def band_keys(marks: np.ndarray) -> np.ndarray:
    """A signed long per band over the minima of its rows."""
    a, b = _mixers()
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(marks), SHINGLES_AT_ONCE):
        low = np.minimum(low, (a * marks[at : at + SHINGLES_AT_ONCE] + b).min(1))
    rows = low.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


def prints(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """``(key, node, bands)``, a row per input row; ``node`` is a hash of the set of shingles."""

    def run(batch: pa.RecordBatch) -> dict:
        nodes, bands = [], []
        for t in texts_of(batch, "t"):
            marks = shingles(t, width)
            nodes.append(xxhash.xxh64_intdigest(marks.astype("<u8").tobytes()) - (1 << 63))
            bands.append(band_keys(marks) if len(marks) else marks.view(np.int64))
        return {"key": batch.column("k"), "node": nodes, "bands": bands}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_batches(rows, run, f"key {kind}, node bigint, bands array<bigint>", ROWS_AT_ONCE)


def candidates(marks: DataFrame) -> DataFrame:
    """``marks(node, bands)`` to pairs ``(a, b)`` of nodes that share a bucket, each pair once."""
    homes = written(marks.select("node", F.posexplode("bands").alias("band", "bucket")).distinct(), "buckets")
    ends = homes.groupBy("band", "bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    # written, so that both sides of the join come from shuffles that Spark can split
    ends = written(ends, "bucket-ends")
    pairs = homes.join(ends, ["band", "bucket"]).select("node", F.explode(F.array("low", "high")).alias("end"))
    return pairs.filter("node <> end").select(F.greatest("node", "end").alias("a"), F.least("node", "end").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs ``(a, b)`` whose ``sets(node, marks)`` are similar enough."""
    left, right = (sets.select(F.col("node").alias(side), F.col("marks").alias(f"of_{side}")) for side in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = pairs.join(left, "a").join(right, "b")
    return found.filter(both >= F.lit(least) * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def sets_of(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(node, marks)``: the shingles of the nodes in ``pairs(a, b)``, from the texts of ``rows(low, t)``."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = rows.join(nodes.select("node", "low").join(asked, "node"), "low").dropDuplicates(["node"]).select("node", "t")

    def run(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column("node"), "marks": [shingles(t, width).view(np.int64) for t in texts_of(batch, "t")]}

    return map_batches(texts, run, "node bigint, marks array<bigint>", ROWS_AT_ONCE)


def rows_kept(here: DataFrame, own: str, seen: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``here`` with the smallest key of a group; ``roots(node, root)`` groups nodes, others stand alone."""
    roots = roots.withColumnRenamed("node", "other")
    named = nodes.join(roots, nodes["node"] == roots["other"], "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.groupBy("root").agg(F.min("low").alias("key"))
    # how often the row that stays occurs: only repeated rows need a further look
    kept = written(kept.join(seen.select("key"), "key").groupBy("key").agg(F.count("*").alias("copies")), "kept")
    once = here.join(kept.filter("copies = 1").select(F.col("key").alias(own)), own, "left_semi")
    more = here.join(kept.filter("copies > 1").select(F.col("key").alias(own)), own, "left_semi")
    return once.unionByName(more.dropDuplicates([own])).drop(own)


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """The documents, all columns, without those that link to an earlier one.

    Of a group the row with the smallest key stays (nulls last, then by text hash); of
    rows that repeat both key and text, one. Texts without a word are one group.
    """
    who = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
    own = fresh(docs, "_who")
    here = docs.withColumn(own, who)
    seen = written(prints(here, own, text, width), "prints")
    nodes = written(seen.groupBy("node").agg(F.min("key").alias("low")), "nodes")
    pairs = written(candidates(seen.select("node", "bands")), "candidates")
    sets = written(sets_of(pairs, nodes, here.select(F.col(own).alias("low"), F.col(text).alias("t")), width), "shingles")
    return rows_kept(here, own, seen, nodes, components(confirmed(pairs, sets, least)))
