"""Line dedup by pairwise alignment.

Documents that share the hash of a run of lines with enough words are overlapping candidates:
such runs are rare, where single lines are common. A run links every later document to the
first one that has it, so a run that a million documents share gives a million links and
not their pairs, and yet every passage that some earlier document has meets it in
the first holder of each of its runs; nothing needs a cap. Each linked pair is aligned with patience
diff, again and again until no common block of enough words is left, and the blocks are deleted
from the later document. The first document that has a passage always keeps it.

Lines are compared without outer white space, inner white space as one space. Long
documents are aligned in overlapping segments of lines, so a pair is small at any length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh, map_batches, texts_of, written

MIN_BLOCK_WORDS = 40
SEGMENT, OVERLAP = 2048, 64


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences by patience diff, in order.

    Lines that are unique on both sides are anchors; equal lines next to an anchor extend
    it, and the gaps are aligned in the same way. Only where there is no anchor do equal
    lines at the two ends match.
    """
    matched: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b), False)]
    while stack:
        a0, a1, b0, b1, extend = stack.pop()
        anchors = [] if extend else _increasing(_unique_common(a, b, a0, a1, b0, b1))
        if anchors:
            matched += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            stack += [
                (i + 1, k, j + 1, m, 0 < at < len(anchors)) for at, ((i, j), (k, m)) in enumerate(zip(edges, edges[1:]))
            ]
            continue
        whole = (a0, a1, b0, b1)
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        if a0 < a1 and b0 < b1 and (extend or whole != (a0, a1, b0, b1)):
            stack.append((a0, a1, b0, b1, False))
    return sorted(matched)


def _unique_common(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    def once(x: list, lo: int, hi: int) -> dict:
        at: dict = {}
        for i in range(lo, hi):
            at[x[i]] = -1 if x[i] in at else i
        return at

    in_b = once(b, b0, b1)
    return [(i, in_b[x]) for x, i in once(a, a0, a1).items() if i >= 0 and in_b.get(x, -1) >= 0]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases on both sides; pairs come in the first side's order."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[k] = last[at - 1] if at else -1
        tails[at : at + 1] = [j]
        last[at : at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def aligned_blocks(later: list[tuple], first: list[tuple], least: int) -> list[int]:
    """Positions in the later document of aligned blocks of at least ``least`` words.

    Lines are ``(rank, mark, check, words, position)``; lines of neighbouring ranks on
    both sides are one block.
    """
    found: list[int] = []
    block: list[tuple] = []
    words, at = 0, None
    for i, j in patience([x[1:3] for x in later], [x[1:3] for x in first]):
        here = (later[i][0], first[j][0])
        if at is None or here != (at[0] + 1, at[1] + 1):
            found += [x[4] for x in block] if words >= least else []
            block, words = [], 0
        block.append(later[i])
        words += later[i][3]
        at = here
    return found + ([x[4] for x in block] if words >= least else [])


def common_blocks(later: list[tuple], first: list[tuple], least: int) -> list[int]:
    """Positions in the later document of all blocks of ``least`` words that the first one has anywhere.

    The alignment is repeated on the lines that are left until it finds no block; each time
    other lines are anchors, so passages in another order are found too. Lines that are no anchor
    because they repeat are found by their shortest runs.
    """
    gone: set[int] = set()
    left = later
    while found := aligned_blocks(left, first, least):
        gone.update(found)
        left = [x for x in left if x[4] not in gone]
    known = {tuple(x[1:3] for x in first[i:j]) for i, j in least_runs([x[3] for x in first], least)}
    for i, j in least_runs([x[3] for x in later], least):
        if tuple(x[1:3] for x in later[i:j]) in known:
            gone.update(x[4] for x in later[i:j])
    return sorted(gone)


def least_runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """Start and end of the shortest runs of lines with ``least`` words, of those that begin and of those that end with a line."""
    n, spans = len(words), set()
    end = total = 0
    for start in range(n):
        while end < n and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        spans.add((start, end))
        total -= words[start]
    start = total = 0
    for end in range(1, n + 1):
        total += words[end - 1]
        while start < end and total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            spans.add((start, end))
    return sorted(spans)


def lists_of(sizes: list[int], **fields: np.ndarray) -> pa.Array:
    """A list column of structs whose fields lie one list after another."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))


def line_arrays(docs: DataFrame, who: str, text: str, least: int) -> DataFrame:
    """``who, lines, runs``, a row per document with a line.

    ``lines`` are structs ``rank, mark, check, words, position`` of the lines with a word. ``runs`` are
    its :func:`least_runs`: place of the first line and a hash of all. Two documents share a passage
    of ``least`` words if and only if they share such a run, and the shared runs cover all of it.
    """

    def run(batch: pa.RecordBatch) -> dict:
        digests, words, positions, ranks, sizes = [], [], [], [], []
        run_digests, run_starts, run_sizes = [], [], []
        for t in texts_of(batch, "t"):
            own, own_words = [], []
            for position, raw in enumerate(t.encode().split(b"\n") if t else ()):
                if cells := raw.split():
                    own.append(xxhash.xxh3_128_digest(b" ".join(cells)))
                    own_words.append(len(cells))
                    positions.append(position)
            spans = least_runs(own_words, least)
            run_digests += [xxhash.xxh3_128_digest(b"".join(own[i:j])) for i, j in spans]
            run_starts += [i for i, _ in spans]
            run_sizes.append(len(spans))
            digests += own
            words += own_words
            ranks += range(len(own))
            sizes.append(len(own))
        mark, check = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T.copy()
        run_mark, run_check = np.frombuffer(b"".join(run_digests), "<i8").reshape(-1, 2).T.copy()
        small = [np.array(x, np.int32) for x in (ranks, words, positions, run_starts)]
        return {
            "who": batch.column("who"),
            "lines": lists_of(sizes, rank=small[0], mark=mark, check=check, words=small[1], position=small[2]),
            "runs": lists_of(run_sizes, rank=small[3], mark=run_mark, check=run_check),
        }

    kind = docs.schema[who].dataType.simpleString()
    schema = (
        f"who {kind}, lines array<struct<rank:int,mark:bigint,check:bigint,words:int,position:int>>, "
        "runs array<struct<rank:int,mark:bigint,check:bigint>>"
    )
    found = map_batches(docs.select(F.col(who).alias("who"), F.col(text).alias("t")), run, schema, rows=1024)
    return found.filter("size(runs) > 0").withColumnRenamed("who", who)


def removals(docs: DataFrame, who: str, text: str, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``(who, positions)`` of the lines to delete, for documents that have any.

    ``who`` orders the documents; rows that repeat it are the same document.
    """
    overlap = max(OVERLAP, least)
    arrays = written(line_arrays(docs, who, text, least), "lines")
    runs = arrays.select(who, F.explode("runs").alias("run")).select(who, "run.*")
    shared = (
        runs.groupBy("mark", "check")
        .agg(F.min(F.struct(F.col(who), F.col("rank"))).alias("home"), F.max(who).alias("last"))
        .filter(F.col("last") > F.col(f"home.{who}"))
        .select("mark", "check", F.col(f"home.{who}").alias("first"), F.col("home.rank").alias("first_rank"))
    )
    # written, so that both sides of the join come from shuffles that Spark can split
    shared = written(shared, "shared-runs")
    part = f"cast(rank div {SEGMENT} as int)"
    links = runs.join(shared, ["mark", "check"]).filter(F.col("first") < F.col(who))
    pairs = links.selectExpr(who, f"{part} AS part", "first", f"cast(first_rank div {SEGMENT} as int) AS first_part").distinct()
    pairs = written(pairs, "pairs")

    def segments(name: str, number: str, lines: str, others: DataFrame) -> DataFrame:
        """The lines of the segments that pairs ask for; a run that begins in a segment ends inside its overlap."""
        cut = f"slice(lines, {number} * {SEGMENT} + 1, {SEGMENT + overlap}) AS {lines}"
        own = arrays.select(F.col(who).alias(name), "lines")
        found = others.select(name, number).distinct().join(own, name).selectExpr(name, number, cut)
        return found.dropDuplicates([name, number])  # rows that repeat a document

    later = written(segments(who, "part", "lines", pairs), "later-lines")
    first = written(segments("first", "first_part", "first_lines", pairs), "first-lines")
    both = pairs.join(later, [who, "part"]).join(first, ["first", "first_part"])

    def align(batch: pa.RecordBatch) -> dict:
        out = []
        for later, first in zip(batch.column("lines"), batch.column("first_lines")):
            a, b = ([tuple(x.values()) for x in side.as_py()] for side in (later, first))
            out.append(common_blocks(a, b, least))
        return {"who": batch.column("who"), "positions": out}

    kind = arrays.schema[who].dataType.simpleString()
    found = map_batches(both.select(F.col(who).alias("who"), "lines", "first_lines"), align, f"who {kind}, positions array<int>", rows=64)
    return (
        found.select(F.col("who").alias(who), F.explode("positions").alias("position"))
        .groupBy(who)
        .agg(F.collect_set("position").alias("positions"))
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars",
                least: int = MIN_BLOCK_WORDS, removed: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with common blocks deleted from later documents.

    Documents are ordered by ``key`` (nulls last, then by text hash); rows that repeat
    key and text are one document and are treated alike. Null and empty texts have no
    lines and stay as they are. A document of which every line is deleted keeps its row
    with an empty text. ``length`` names a column that is kept in step with the text,
    ``removed`` one to add with the number of deleted lines.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = [c for c in docs.columns if c != removed]
    own, gone_at, count = (fresh(docs, n) for n in ("_who", "_positions", removed or "_removed"))
    who = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
    here = docs.select(*columns, who.alias(own))
    gone = removals(here.select(own, F.col(text).alias("_text")), own, "_text", least).withColumnRenamed("positions", gone_at)
    found = here.join(gone, own, "left").drop(own)
    schema = found.drop(gone_at).withColumn(removed or count, F.lit(0).cast("bigint")).schema
    arrow = to_arrow_schema(schema)
    counted = length if length in columns else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = batch.column(gone_at).to_pylist()
            texts = []
            for t, drop in zip(texts_of(batch, text), positions):
                if drop:
                    drop = set(drop)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
                texts.append(t)
            out = {c: batch.column(c) for c in columns} | {text: pa.array(texts, pa.string())}
            if counted:
                old = batch.column(counted).to_pylist()
                out[counted] = pa.array([len(t) if d else n for t, d, n in zip(texts, positions, old)])
            out[removed or count] = pa.array([len(d or ()) for d in positions])
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return found.mapInArrow(apply, schema).select(*columns, *([removed] if removed else []))
