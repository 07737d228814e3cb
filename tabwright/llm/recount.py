"""Edit-aware token counts: a segment tree of pre-tokens per document.

A byte-level BPE encodes every pre-token on its own, so a document's token count is the
sum over its pre-tokens. A segment tree keeps characters and tokens of every pre-token
and of every subtree. An edit finds its place by descending the character sums; only the
touched pre-tokens, with the few characters before and after on which their borders
depend, are cut and encoded again, and the sums on the way to the root are mended.

Trees are a table: ``build_trees`` makes it, ``edit_trees`` reads it and returns it as the
edits leave it, and no later round encodes more than its own edits.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, texts_of
from tabwright.llm.tokens import Encoder

# A pre-token looks at most so many characters beyond its own end: one, to see that it
# ends there, or two after an apostrophe.
LOOKAHEAD = 2
CUT_STEP = 1 << 12  # characters cut at a time while looking for the old borders
CACHE_ENTRIES, CACHE_CHARS = 300_000, 40
BATCH = 256  # documents whose trees a task holds at once


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of each, with a bounded cache."""

    def __init__(self, tokenizer: str, pattern: str) -> None:
        self.encoder = Encoder(tokenizer)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, pieces: list[str]) -> list[int]:
        found = list(map(self.known.get, pieces))
        if None in found:
            missing = list({p for p, n in zip(pieces, found) if n is None})
            new = dict(zip(missing, map(self.encoder.count, missing)))
            found = [new[p] if n is None else n for p, n in zip(pieces, found)]
            if len(self.known) + len(new) > CACHE_ENTRIES:
                self.known.clear()
            self.known.update((p, n) for p, n in new.items() if len(p) <= CACHE_CHARS)
        return found


class Tree:
    """Sums of characters and tokens over slots; a slot is one pre-token of the first text.

    After an edit the first touched slot holds all pre-tokens of the new region and the
    others hold none, so the tree keeps its shape. The first text is never copied: a slot
    that an edit changed has a text of its own, the others lie in the first text.
    """

    def __init__(self, text: str, counter: Counter) -> None:
        pieces = counter.cut(text)
        self._plant(text, counter, np.fromiter(map(len, pieces), np.int64, len(pieces)), counter.count(pieces))

    @classmethod
    def kept(cls, text: str, counter: Counter, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        """The tree of a text whose pre-tokens are known: nothing is cut or encoded."""
        tree = cls.__new__(cls)
        tree._plant(text, counter, chars, tokens)
        return tree

    def _plant(self, text: str, counter: Counter, chars: np.ndarray, tokens: np.ndarray | list[int]) -> None:
        self.counter, self.first = counter, text
        self.starts = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
        n = self.leaves = 1 << max(0, (len(chars) - 1).bit_length())
        self.sums = np.zeros((2 * n, 2), np.int64)
        self.sums[n : n + len(chars), 0] = chars
        self.sums[n : n + len(chars), 1] = tokens
        level = n
        while level > 1:
            below = self.sums[level : 2 * level]
            self.sums[level // 2 : level] = below[::2] + below[1::2]
            level //= 2
        self.inner: dict[int, list[tuple[int, int]]] = {}  # pre-tokens of slots that edits made
        self.texts: dict[int, str] = {}  # and their texts
        self.changed: list[int] = []  # those slots in order
        self.encoded = 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def size(self) -> int:
        return int(self.sums[1, 0])

    @property
    def text(self) -> str:
        return "".join(self._parts(0))

    def leaf_sums(self) -> np.ndarray:
        """Characters and tokens of all pre-tokens of the present text, in order."""
        out, at = [], 0
        for slot in self.changed:
            out += [self.sums[self.leaves + at : self.leaves + slot], np.array(self.inner[slot], np.int64).reshape(-1, 2)]
            at = slot + 1
        found = np.concatenate([*out, self.sums[self.leaves + at :]])
        return found[found[:, 0] > 0]

    def _place(self, slot: int) -> int:
        """Where a slot begins in the first text."""
        return int(self.starts[min(slot, len(self.starts) - 1)])

    def _own(self, slot: int) -> str:
        """The present text of a slot."""
        own = self.texts.get(slot)
        return self.first[self._place(slot) : self._place(slot + 1)] if own is None else own

    def _parts(self, slot: int) -> Iterator[str]:
        """The present text from a slot on, unchanged stretches and changed slots in turn."""
        for k in range(bisect_left(self.changed, slot), len(self.changed)):
            other = self.changed[k]
            yield self.first[self._place(slot) : self._place(other)]
            yield self.texts[other]
            slot = other + 1
        yield self.first[self._place(slot) :]

    def _stretches(self, at: int) -> Iterator[str]:
        """The present text from a character on, in parts of at most ``CUT_STEP`` characters."""
        slot, begin = self.find(at)
        skip = at - begin
        k = bisect_left(self.changed, slot)
        while slot < self.leaves:
            other = self.changed[k] if k < len(self.changed) else self.leaves
            left, right = self._place(slot) + (skip if slot < other else 0), self._place(other)
            for x in range(left, right, CUT_STEP):
                yield self.first[x : min(right, x + CUT_STEP)]
            if other < self.leaves:
                own = self.texts[other]
                for x in range(skip if slot == other else 0, len(own), CUT_STEP):
                    yield own[x : x + CUT_STEP]
            slot, skip, k = other + 1, 0, k + 1

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds the character at ``at``, or the last one, and where it begins."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.leaves, start

    def pieces(self, slot: int) -> list[tuple[int, int]]:
        """Characters and tokens of the slot's pre-tokens."""
        n, tokens = self.sums[self.leaves + slot].tolist()
        return self.inner.get(slot) or ([(n, tokens)] if n else [])

    def following(self, slot: int) -> Iterator[int]:
        """The slots from this one on that hold characters."""
        while True:
            yield slot
            node = self.leaves + slot
            while node > 1 and (node % 2 or not self.sums[node + 1, 0]):
                node //= 2
            if node <= 1:
                return
            node += 1
            while node < self.leaves:
                node = 2 * node if self.sums[2 * node, 0] else 2 * node + 1
            slot = node - self.leaves

    def _borders(self, at: int) -> Iterator[tuple[int, int, int]]:
        """``(border, slot, number in the slot)`` of pre-tokens from the slot at ``at`` on."""
        slot, border = self.find(at)
        for slot in self.following(slot):
            for k, (n, _) in enumerate(self.pieces(slot)):
                yield border, slot, k
                border += n

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` of the present text."""
        shift = len(new) - (end - start)
        safe = max(0, start - LOOKAHEAD)
        first, begin = self.find(safe)
        slot_at = begin
        before: list[tuple[int, int]] = []
        for n, tokens in self.pieces(first):
            if begin + n > safe:
                break
            before.append((n, tokens))
            begin += n
        # the last slot may end at the text's end, before the lookahead: its last piece can grow
        if before and begin >= self.size:
            begin -= before.pop()[0]
        head = self._own(first)[: begin - slot_at]
        old = self._borders(end)
        border = next(old, None)
        fresh: list[str] = []
        last, after, tail = None, [], ""
        at = begin
        for piece in self._cut_parts(self._edited(begin, start, end, new)):
            while border is not None and (border[0] < end or border[0] + shift < at):
                border = next(old, None)
            if border is not None and border[0] + shift == at and at >= start + len(new):
                last = border[1]
                skipped, after = self.pieces(last)[: border[2]], self.pieces(last)[border[2] :]
                tail = self._own(last)[sum(n for n, _ in skipped) :]
                break
            fresh.append(piece)
            at += len(piece)
        counts = self.counter.count(fresh)
        self.encoded += len(fresh)
        made = before + [(len(p), n) for p, n in zip(fresh, counts)]
        changed: dict[int, tuple[list[tuple[int, int]], str]] = {slot: ([], "") for slot in list(self._until(first, last))}
        head += "".join(fresh)
        if last == first:
            made, head = made + after, head + tail
        elif last is not None:
            changed[last] = after, tail
        changed[first] = made, head
        self._set(changed)

    def _edited(self, begin: int, start: int, end: int, new: str) -> Iterator[str]:
        """The text from ``begin`` on as the edit will leave it."""
        left = start - begin
        for part in self._stretches(begin) if left > 0 else ():
            yield part[:left]
            left -= len(part)
            if left <= 0:
                break
        yield new
        if end < self.size:
            yield from self._stretches(end)

    def _until(self, first: int, last: int | None) -> Iterator[int]:
        for slot in self.following(first):
            if slot == last:
                return
            yield slot

    def _cut_parts(self, parts: Iterator[str]) -> Iterator[str]:
        """Pre-tokens of a text that comes in parts; the last of a stretch may be cut short."""
        held, step, more = "", CUT_STEP, True
        while more or held:
            gathered = [held]
            size = len(held)
            while size < step and (part := next(parts, None)) is not None:
                gathered.append(part)
                size += len(part)
            more = size >= step
            held = "".join(gathered)
            end = len(held) - (LOOKAHEAD if more else 0)
            done = 0
            for piece in self.counter.cut(held):
                if done + len(piece) > end:
                    break
                done += len(piece)
                yield piece
            held = held[done:]
            step = CUT_STEP if done else 2 * step
            if not more and not done:
                return

    def _set(self, changed: dict[int, tuple[list[tuple[int, int]], str]]) -> None:
        for slot, (pieces, text) in changed.items():
            if slot not in self.texts:
                insort(self.changed, slot)
            self.inner[slot], self.texts[slot] = pieces, text
            self.sums[self.leaves + slot] = [sum(n for n, _ in pieces), sum(t for _, t in pieces)]
        nodes = {self.leaves + slot for slot in changed}
        while nodes := {n // 2 for n in nodes if n > 1}:
            for n in nodes:
                self.sums[n] = self.sums[2 * n] + self.sums[2 * n + 1]


EDIT = "struct<start: int, end: int, text: string>"
TREE = "struct<chars: binary, tokens: binary, n_pretokens: bigint, n_tokens: bigint>"
COUNTS = ["n_tokens", "n_tokens_edited", "n_edits", "n_pretokens", "n_reencoded"]


def in_order(edits: list[dict] | None, size: int) -> list[tuple[int, int, str]]:
    """Edits of one text, from the last to the first, so that places stay those of the first text.

    Places are clipped to the text; of edits that overlap the earlier one holds. Null
    edits and places are left out; a null text deletes.
    """
    known = [e for e in edits or [] if e and e["start"] is not None and e["end"] is not None]
    out: list[tuple[int, int, str]] = []
    for e in sorted(known, key=lambda e: (e["start"], e["end"])):
        start = min(max(e["start"], 0), size)
        end = min(max(e["end"], start), size)
        if not out or start >= out[-1][1]:
            out.append((start, end, e["text"] or ""))
    return out[::-1]


def packed(values: np.ndarray) -> bytes:
    """Numbers in 1, 2 or 4 bytes each, as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.empty(0, np.uint8)


def tree_row(leaves: np.ndarray) -> dict:
    """A tree as it is kept: characters and tokens of its leaves, and the sum of tokens at the root.

    The sums between them are added up again when the tree is read, which is faster than reading them.
    """
    return {
        "chars": packed(leaves[:, 0]), "tokens": packed(leaves[:, 1]),
        "n_pretokens": len(leaves), "n_tokens": int(leaves[:, 1].sum()),
    }


def build_trees(
    docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(key, text, tree)`` and the columns ``keep``, a row per input row, to be written as a table.

    This alone encodes whole texts; ``edit_trees`` goes on from the table. ``tokenizer`` is a
    byte-level BPE file and ``pattern`` its rule for pre-tokens. Null and empty texts have a
    tree without leaves.
    """

    def run(batch: pa.RecordBatch) -> dict:
        counter = _counter(tokenizer, pattern)
        trees = [tree_row(Tree(t or "", counter).leaf_sums()) for t in texts_of(batch, "t")]
        return {**{name: batch.column(name) for name in names}, "tree": trees}

    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *kept)
    names = rows.columns
    found = map_batches(rows, run, f"{_columns(rows)}, tree {TREE}", BATCH)
    return found.select(F.col("k").alias(key), F.col("t").alias(text), "tree", *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)])


def edit_trees(
    trees: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text", edits: str = "edits"
) -> DataFrame:
    """Make ``edits``, an array of ``(start, end, text)`` in code points, in kept trees.

    ``(key, text, tree)`` after the edits, to be written for the edits that follow, and
    ``COUNTS``: tokens before and after, edits made, pre-tokens before, and how many were
    encoded. Only pre-tokens that an edit touches are encoded; a row without an edit costs
    no more than its copy. Edits may insert into null and empty texts; without edits a
    null text stays null.
    """

    def run(batch: pa.RecordBatch) -> dict:
        counter = _counter(tokenizer, pattern)
        out: dict[str, list] = {name: [] for name in ["t", "tree", *COUNTS]}
        for t, kept, e in zip(texts_of(batch, "t"), batch.column("tree"), batch.column("e")):
            row = kept.as_py()
            before, n, encoded = row["n_tokens"], row["n_pretokens"], 0
            made = in_order(e.as_py(), len(t or ""))
            if made:
                tree = Tree.kept(t or "", counter, unpacked(row["chars"], n), unpacked(row["tokens"], n))
                for start, end, new in made:
                    tree.edit(start, end, new)
                t, row, encoded = tree.text, tree_row(tree.leaf_sums()), tree.encoded
            for name, value in zip(out, (t, row, before, row["n_tokens"], len(made), n, encoded)):
                out[name].append(value)
        return {"k": batch.column("k"), **out}

    rows = trees.select(F.col(key).alias("k"), F.col(text).alias("t"), "tree", F.col(edits).cast(f"array<{EDIT}>").alias("e"))
    schema = f"{_columns(rows.select('k'))}, t string, tree {TREE}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    found = map_batches(rows, run, schema, BATCH)
    return found.select(F.col("k").alias(key), F.col("t").alias(text), "tree", *COUNTS)


def _columns(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def recount(docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """``key`` and ``COUNTS`` of a single round of edits, for which no tree is kept."""
    trees = build_trees(docs, tokenizer, pattern, key, text, keep=(edits,))
    return edit_trees(trees, tokenizer, pattern, key, text, edits).select(key, *COUNTS)


@cache
def _counter(tokenizer: str, pattern: str) -> Counter:
    """One per Python worker, so that its cache lasts from batch to batch."""
    return Counter(tokenizer, pattern)


# What the registered query edits: personal data becomes a placeholder.
MASKS = [
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])", "<ip>"),
    (r"(?<!\w)\+?\d(?:[ ()-]{0,2}\d){6,}(?!\w)", "<number>"),
]


def with_mask_edits(docs: DataFrame, text: str = "text", edits: str = "edits") -> DataFrame:
    """``docs`` with the edits that mask mail addresses, network addresses and long numbers,
    and that delete lines which repeat an earlier line of the text."""
    import re

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.drop(edits).withColumn(edits, F.lit(None).cast(f"array<{EDIT}>")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(re.compile(p), new) for p, new in MASKS]
        for batch in batches:
            found = []
            for t in texts_of(batch, text):
                own = [{"start": m.start(), "end": m.end(), "text": new} for p, new in masks for m in p.finditer(t or "")]
                found.append(own + repeated_lines(t or ""))
            columns = [batch.column(f.name).cast(f.type) for f in arrow if f.name != edits]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow.field(edits).type)], schema=arrow)

    return docs.drop(edits).mapInArrow(run, schema)


def repeated_lines(text: str) -> list[dict]:
    seen: set[str] = set()
    out, at = [], 0
    for line in text.split("\n"):
        if line in seen and line:
            out.append({"start": at - 1, "end": at + len(line), "text": ""})
        seen.add(line)
        at += len(line) + 1
    return out
