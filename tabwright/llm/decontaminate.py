"""Benchmark decontamination with a generalised suffix automaton of test items.

The automaton holds every run of words of the normalised items. Training words are
streamed through it: each word yields the length of the longest run ending there
that some item has. Where that length reaches a window, the window's words are hit,
and the state of the window names the items. Spans of hit words that are too long,
or documents that are covered too much, are removed.

Only words whose neighbours form a pair that the items have can be part of a window
of two or more; that test is vectorised and leaves short runs for the automaton.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh, map_batches, texts_of, written

WINDOW = 10
# Fixed value: what a word is, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# One automaton is built from about so many bytes of items and broadcast; more items
# are dealt into shards and the documents pass one shard after the other.
SHARD_BYTES = 4 << 20
PIECE_WORDS = 1 << 14


def lower(text: str) -> str:
    """A-Z only: bytes know no other letters, and UTF-8 keeps all others apart."""
    return text.encode().lower().decode()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower(text)) if text else []


class Automaton:
    """Generalised suffix automaton over words, with the items of every window.

    ``add`` takes pieces of items: words, the item's id, and whether the piece is an
    item shorter than a window, which only counts as a whole.
    """

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.code: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, dict[int, set[str]]] = {}  # by state, then by the item's length
        self.shortest = window

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            there = nxt[last][word]
            return there if length[there] == length[last] + 1 else self._clone(last, word, there)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            there = nxt[at][word]
            link[new] = there if length[there] == length[at] + 1 else self._clone(at, word, there)
        return new

    def _clone(self, at: int, word: int, there: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[there]))
        length.append(length[at] + 1)
        link.append(link[there])
        link[there] = copy
        while at >= 0 and nxt[at].get(word) == there:
            nxt[at][word] = copy
            at = link[at]
        return copy

    def add(self, pieces: list[tuple[str, list[str]]]) -> Automaton:
        coded = [(item, [self.code.setdefault(w, len(self.code)) for w in ws]) for item, ws in pieces if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        for item, ws in coded:  # states are final now
            short = len(ws) < self.window
            self.shortest = min(self.shortest, len(ws))
            for end, state, _ in self.walk(ws):
                if short and end == len(ws) - 1:
                    self.whole.setdefault(self._at(state, len(ws)), {}).setdefault(len(ws), set()).add(item)
                elif not short and end >= self.window - 1:
                    self.items.setdefault(self._at(state, self.window), set()).add(item)
        pairs = {(a, b) for _, ws in coded for a, b in zip(ws, ws[1:])}
        self.pairs = np.sort(np.array([(a << 32) | b for a, b in pairs], np.int64))
        return self

    def _at(self, state: int, length: int) -> int:
        """The state of the last ``length`` words, of a state that holds as many."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """For each word its position, the state and the longest matching length there."""
        nxt, link, lengths = self.next, self.link, self.length
        state = matched = 0
        for at, word in enumerate(codes):
            while state and word not in nxt[state]:
                state = link[state]
                matched = lengths[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            yield at, state, matched

    def runs(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges outside of which no window or short item can lie."""
        known = codes >= 0
        if self.shortest == 1 or len(codes) < 2:
            joined, least = known, self.shortest
        else:
            keys = (codes[:-1] << 32) | codes[1:]
            at = np.searchsorted(self.pairs, keys)
            at[at == len(self.pairs)] = 0
            joined = known[:-1] & known[1:] & (self.pairs[at] == keys) if len(self.pairs) else np.zeros(len(keys), bool)
            least = self.shortest - 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]])))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least
        more = 0 if self.shortest == 1 or len(codes) < 2 else 1
        return list(zip(starts[long].tolist(), (ends[long] + more).tolist()))

    def hits(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans of hit words, the items found, and the longest matching length."""
        get = self.code.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans: list[list[int]] = []
        found: set[str] = set()
        longest = 0

        def mark(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                last = spans.pop()
                start, end = min(start, last[0]), max(end, last[1])
            spans.append([start, end])

        for start, end in self.runs(codes):
            for at, state, matched in self.walk(codes[start:end].tolist()):
                longest = max(longest, matched)
                stop = start + at + 1
                if self.whole and matched:
                    up = state
                    while up > 0:
                        for length, names in self.whole.get(up, {}).items():
                            if length <= matched:
                                found |= names
                                mark(stop - length, stop)
                        up = self.link[up]
                if matched >= self.window:
                    found |= self.items[self._at(state, self.window)]
                    mark(stop - self.window, stop)
        return [tuple(s) for s in spans], found, longest


def _pieces(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Items as word pieces that overlap by a window less one word."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"item": [], "words": []}
        for item, t in zip(batch.column("i").to_pylist(), texts_of(batch, "t")):
            words = words_of(t)
            last = max(1, len(words) - window + 1)
            for at in range(0, last, PIECE_WORDS):
                out["item"].append(item)
                out["words"].append(" ".join(words[at : at + PIECE_WORDS + window - 1]))
        return out

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"))
    return map_batches(rows, run, "item string, words string").filter("words <> ''")


@dataclass
class Dealt:
    """Distinct pieces of items as a written table, and the number of shards they are dealt into."""

    pieces: DataFrame
    shards: int
    window: int


def dealt(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> Dealt:
    """Shards hold about ``SHARD_BYTES`` of words at most; repeated items count once."""
    pieces = written(_pieces(items, item_id, text, window).distinct(), "items")
    size = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    return Dealt(pieces, size // SHARD_BYTES + 1, window)


def automata(parts: Dealt) -> Iterator[Automaton]:
    """One automaton per shard, built when it is asked for."""
    for k in range(parts.shards):
        rows = parts.pieces.filter(F.expr(f"pmod(xxhash64(item, words), {parts.shards}) = {k}")) if parts.shards > 1 else parts.pieces
        yield Automaton(parts.window).add([(r.item, r.words.split(" ")) for r in rows.collect()])


@dataclass
class Found:
    """What a document has of the items: spans of word positions, items, longest match."""

    spans: list[tuple[int, int]]
    items: set[str]
    longest: int


HITS = "struct<n_words: bigint, starts: array<bigint>, ends: array<bigint>, items: array<string>, longest: bigint>"


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, into: str = "hits") -> DataFrame:
    """``docs`` with ``into``: number of words, spans of hit words, item ids and longest match.

    A null or wordless text has no words and no hits. A null item id counts as the
    item ``null``; null or wordless items hit nothing; repeated items count once by
    id. No items at all leave every document unhit. Extra columns pass through; one
    named like ``into`` is replaced.
    """
    return _find(docs, dealt(items, item_id, item_text, window), text, into)


def _find(docs: DataFrame, parts: Dealt, text: str, into: str) -> DataFrame:
    found = docs.drop(into)
    machines = automata(parts)
    for k in range(parts.shards):
        # the driver holds one automaton at a time
        shared = docs.sparkSession.sparkContext.broadcast(next(machines))
        found = _find_shard(written(found, "hits") if k else found, shared, text, into, k)
    return found


def _find_shard(docs: DataFrame, shared: Broadcast, text: str, into: str, shard: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    before = [c for c in docs.columns if c != into]
    schema = docs.select(*before).withColumn(into, F.lit(None).cast(HITS)).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            old = batch.column(into).to_pylist() if shard else [None] * batch.num_rows
            hits = []
            for t, seen in zip(texts_of(batch, text), old):
                words = words_of(t)
                spans, names, longest = machine.hits(words)
                if seen:
                    spans = merged(spans + list(zip(seen["starts"], seen["ends"])))
                    names, longest = names | set(seen["items"]), max(longest, seen["longest"])
                hits.append({
                    "n_words": len(words), "starts": [s for s, _ in spans], "ends": [e for _, e in spans],
                    "items": sorted(names), "longest": longest,
                })
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).cast(arrow.field(c).type) for c in before] + [pa.array(hits, arrow.field(into).type)],
                schema=arrow,
            )

    return docs.select(*before, *([into] if shard else [])).mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated``: a row per document."""
    found = find(docs.select(key, text), items, text)
    n_hit = F.expr("aggregate(zip_with(hits.ends, hits.starts, (e, s) -> e - s), 0L, (a, n) -> a + n)")
    return found.select(
        key,
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("hits.longest").alias("longest_match"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and a space where a span was."""
    starts = [m.span() for m in WORD.finditer(lower(text))]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : starts[first][0]])
        at = starts[end - 1][1]
    out.append(text[at:])
    return " ".join(out)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", length: str | None = "n_chars",
                  max_span: int = WINDOW - 1, max_coverage: float = 0.5, all_hits: bool = False) -> DataFrame:
    """``docs`` without item text: spans of more than ``max_span`` hit words are cut out, and
    documents of which more than ``max_coverage`` of the words are cut are removed.

    With ``all_hits`` coverage counts every hit word of the text as it came, also those of
    spans that are too short to be cut, such as items shorter than a window.

    Cutting can bring words together that form a new window; the rest is searched
    again until nothing is found, and coverage is counted over all cuts. Documents
    without hits stay as they are, also null and empty ones. ``length`` names a column
    that keeps the text's number of characters, where there is one.
    """
    columns = docs.columns
    parts = dealt(items)
    if parts.shards > 1:
        return _decontaminate_by_shard(docs, parts, text, length, max_span, max_coverage, all_hits)
    shared = docs.sparkSession.sparkContext.broadcast(next(automata(parts)))

    def clean(value: str | None) -> tuple[str | None, bool]:
        machine = shared.value
        words = words_of(value)
        lost, places = np.zeros(len(words), bool), np.arange(len(words))  # of the text as it came
        spans = machine.hits(words)[0]
        for s, e in spans if all_hits else ():
            lost[s:e] = True
        while spans := [s for s in spans if s[1] - s[0] > max_span]:
            value = cut(value, spans)
            gone = np.concatenate([np.arange(s, e) for s, e in spans])
            lost[places[gone]] = True
            places = np.delete(places, gone)
            spans = machine.hits(words_of(value))[0]
        return value, lost.sum() <= max_coverage * len(lost)

    return _rewritten(docs, text, clean, length).select(*columns)


def _decontaminate_by_shard(docs, parts, text, length, max_span, max_coverage, all_hits) -> DataFrame:
    """The same for items of several automata, a pass each."""
    columns = docs.columns
    hits, spans, words, gone, short = (fresh(docs, n) for n in ("_hits", "_spans", "_words", "_gone", "_short"))
    docs = docs.withColumns({
        words: F.lit(None).cast("bigint"), gone: F.lit(0).cast("bigint"), short: F.lit(None).cast("array<bigint>"),
    })
    every = f"arrays_zip(`{hits}`.starts, `{hits}`.ends)"
    long = f"filter({every}, s -> s.ends - s.starts > {max_span})"
    lost = f"aggregate({long}, 0L, (a, s) -> a + s.ends - s.starts)"
    # words of spans that the first search leaves in, by their place in the text as it is now
    first = f"flatten(transform(filter({every}, s -> s.ends - s.starts <= {max_span}), s -> sequence(s.starts, s.ends - 1)))"
    left = f"filter(`{short}`, p -> not exists({long}, s -> p >= s.starts and p < s.ends))"
    known = f"coalesce(`{short}`, {first if all_hits else 'cast(array() as array<bigint>)'})"
    moved = "transform({0}, p -> p - aggregate(filter({1}, s -> s.ends <= p), 0L, (a, s) -> a + s.ends - s.starts))"
    while True:
        found = (
            written(_find(docs, parts, text, hits), "hits")
            .withColumn(short, F.expr(known))
            .withColumns({
                short: F.expr(moved.format(left, long)),
                spans: F.expr(long),
                words: F.coalesce(words, F.col(hits).getField("n_words")),
                gone: F.col(gone) + F.expr(lost),
            })
        )
        again = not found.filter(F.size(spans) > 0).isEmpty()
        docs = _rewritten(
            found, text, lambda t, cuts: (cut(t, [(s["starts"], s["ends"]) for s in cuts]) if cuts else t, True),
            length, extra=spans,
        ).drop(hits, spans)
        if not again:
            return docs.filter(F.col(gone) + F.size(short) <= F.lit(max_coverage) * F.col(words)).select(*columns)


def _rewritten(docs: DataFrame, text: str, fn, length: str | None, extra: str | None = None) -> DataFrame:
    """Every row with its text replaced; rows for which ``fn`` says no go."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.schema)
    counted = length if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = list(texts_of(batch, text))
            more = batch.column(extra).to_pylist() if extra else None
            done = [fn(t, more[i]) if extra else fn(t) for i, t in enumerate(old)]
            columns = {c: batch.column(c).cast(arrow.field(c).type) for c in arrow.names}
            columns[text] = pa.array([t for t, _ in done], arrow.field(text).type)
            if counted:
                was = batch.column(counted).to_pylist()
                sizes = [n if new is before or new == before else len(new) for (new, _), before, n in zip(done, old, was)]
                columns[counted] = pa.array(sizes, arrow.field(counted).type)
            out = pa.RecordBatch.from_arrays([columns[c] for c in arrow.names], schema=arrow)
            yield out.filter(pa.array([keep for _, keep in done], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
