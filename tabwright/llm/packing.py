"""Lexical retrieval packing: windows filled with the seed's BM25 neighbours.

All documents are encoded once, into a table of token ids. From it come the statistics of
the whole corpus: the documents that hold each token, their number and mean length. Documents
are then brought together by their rarest shared token, whatever file or partition they come
from: it is the key of a shuffle, and a token of very many documents is dealt over
several tasks. There they form shards of bounded size, each an inverted index of token ids
with BM25 weights. A seed's tokens are all looked up; the documents not yet used that score best
follow it in its window, and the one that overflows is cut and goes on as the next window's
seed. When nothing is retrieved any more, the next unused document is the seed. What is left
of a shard at its end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, texts_of, written
from tabwright.llm.tokens import encoder_of

WINDOW = 2048
END = 1
SHARD_TOKENS, SHARD_DOCS = 1 << 19, 1 << 12
K1, B = 1.2, 0.75
NO_TERM = -1


@dataclass(frozen=True)
class Statistics:
    """What BM25 asks of the corpus: documents that hold each token, all documents, their mean length."""

    df: np.ndarray
    docs: int
    mean: float

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[terms]
        return np.log1p((self.docs - df + 0.5) / (df + 0.5)).astype(np.float32)


def distinct_terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a document in order, and how often each occurs."""
    if not len(ids):
        return ids, np.empty(0, int)
    inner = np.sort(ids, kind="stable")  # of 16-bit ids it takes linear time
    first = np.flatnonzero(np.concatenate([[True], inner[1:] != inner[:-1]]))
    return inner[first], np.diff(np.concatenate([first, [len(inner)]]))


class Index:
    """Inverted BM25 index over the documents of a shard, with the weights of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Statistics | None = None) -> None:
        found = [distinct_terms(ids) for ids in docs]
        sizes = [len(terms) for terms, _ in found]
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        term = np.concatenate([terms for terms, _ in found])
        tf = np.concatenate([counts for _, counts in found]).astype(np.float32)
        doc = np.repeat(np.arange(len(docs)), sizes)
        length = np.array([len(ids) for ids in docs], np.float32)
        here = np.bincount(term) if len(term) else np.zeros(1, int)
        corpus = corpus or Statistics(here, len(docs), float(length.mean()))
        norm = K1 * (1 - B + B * length / max(1.0, corpus.mean))
        weight = corpus.idf(term) * tf * (K1 + 1) / (tf + norm[doc])
        self.term, self.shared = term, here[term] > 1
        order = np.argsort(term, kind="stable")
        self.at = np.concatenate([[0], np.cumsum(here)])
        self.posting, self.weight = doc[order], weight[order]
        self.n = len(docs)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties in order."""
        own = slice(self.start[seed], self.start[seed + 1])
        terms = self.term[own][self.shared[own]].astype(np.int64)
        if not len(terms):
            return terms
        ranges = [slice(a, b) for a, b in zip(self.at[terms].tolist(), self.at[terms + 1].tolist())]
        hit = np.concatenate([self.posting[r] for r in ranges])
        score = np.bincount(hit, np.concatenate([self.weight[r] for r in ranges]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def packed_order(docs: list[np.ndarray], window: int, corpus: Statistics | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(doc, start, length, sequence, offset)`` of one shard."""
    index = Index(docs, corpus)
    sizes = [len(ids) for ids in docs]
    unused = np.ones(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = filled = fresh = 0
    seed, ranked, at = None, None, 0
    while True:
        if ranked is not None:
            while at < len(ranked) and not unused[ranked[at]]:
                at += 1
        if ranked is not None and at < len(ranked):
            doc = int(ranked[at])
        else:
            while fresh < len(docs) and not unused[fresh]:
                fresh += 1
            if fresh == len(docs):
                break
            doc, seed = fresh, None
        unused[doc] = False
        done = 0
        while done < sizes[doc]:
            take = min(window - filled, sizes[doc] - done)
            pieces.append((doc, done, take, sequence, filled))
            done, filled = done + take, filled + take
            if filled == window:
                sequence, filled, seed = sequence + 1, 0, None
        if seed is None:  # a window begins with this document, or with what is left of it
            seed = doc
            ranked, at = index.neighbours(doc, unused), 0
    return _tail(pieces, sequence, filled)


def _tail(pieces: list, last: int, filled: int) -> list:
    """The last window, if it isn't full, as sequences of powers of two."""
    head = [p for p in pieces if p[3] != last]
    cuts = [1 << b for b in reversed(range(filled.bit_length())) if filled >> b & 1]
    room = cuts.pop(0) if cuts else 0
    sequence, offset = last, 0
    for doc, start, length, *_ in (p for p in pieces if p[3] == last):
        while length:
            take = min(length, room)
            head.append((doc, start, take, sequence, offset))
            start, length, offset, room = start + take, length - take, offset + take, room - take
            if not room and cuts:
                room, sequence, offset = cuts.pop(0), sequence + 1, 0
    return head


def encoded(docs: DataFrame, tokenizer: str, key: str, text: str) -> DataFrame:
    """``key, ids, df``: the token ids of each row, and with the first row of a batch how many of its rows hold each token."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = list(encoder_of(tokenizer).ids_of(texts_of(batch, "t")))
        terms = [distinct_terms(x)[0] for x in ids]
        held = np.bincount(np.concatenate(terms)) if terms else np.empty(0, int)
        at = np.flatnonzero(held)
        df = np.stack([at, held[at]]).astype("<u4").tobytes()
        return {"key": batch.column("k"), "ids": [x.tobytes() for x in ids], "df": [df, *[None] * (len(ids) - 1)]}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return written(map_batches(rows, run, f"key {kind}, ids binary, df binary", rows=1024), "tokens")


def statistics(tokens: DataFrame, width: np.dtype, end: int = 1) -> Statistics:
    """The corpus in numbers; the driver receives a row per token of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column("df"):
                term, n = np.frombuffer(cell.as_py(), "<u4").reshape(2, -1)
                if len(term) and term[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(term[-1]) + 1 - len(total), np.int64)])
                total[term] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    parts = tokens.filter("df IS NOT NULL").select("df").mapInArrow(run, "term bigint, n bigint")
    rows = parts.groupBy("term").agg(F.sum("n").alias("n")).collect()
    docs, size = tokens.agg(F.count("*"), F.sum(F.octet_length("ids"))).first()
    df = np.zeros(max((r["term"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        df[r["term"]] = r["n"]
    return Statistics(df, docs, (size or 0) / width.itemsize / max(1, docs) + end)


def together(tokens: DataFrame, corpus: Statistics, width: np.dtype) -> DataFrame:
    """``key, ids, term, other, tile``: the rarest and the next rarest token that another document has too.

    The rows of a token are dealt into tiles by its number of documents, so no task gets them all.
    """
    df = tokens.sparkSession.sparkContext.broadcast(corpus.df)
    per_tile = max(1, int(SHARD_TOKENS / max(1.0, corpus.mean)))

    def run(batch: pa.RecordBatch) -> dict:
        term, other, tiles = [], [], []
        for cell in batch.column("ids"):
            terms = distinct_terms(np.frombuffer(cell.as_buffer(), width))[0]
            n = df.value[terms]
            n = np.where(n > 1, n, np.iinfo(np.int64).max)
            best = np.argsort(n, kind="stable")[:2]
            best = [int(terms[i]) for i in best if n[i] < np.iinfo(np.int64).max] + [NO_TERM, NO_TERM]
            term.append(best[0])
            other.append(best[1])
            tiles.append(-(-int(df.value[best[0]]) // per_tile) if best[0] != NO_TERM else 1 << 30)
        return {"key": batch.column("key"), "ids": batch.column("ids"), "term": term, "other": other, "tiles": tiles, "row": batch.column("row")}

    kind = tokens.schema["key"].dataType.simpleString()
    rows = tokens.select("key", "ids", F.monotonically_increasing_id().alias("row"))
    found = map_batches(rows, run, f"key {kind}, ids binary, term int, other int, tiles int, row bigint")
    return found.withColumn("tile", F.expr("cast(pmod(xxhash64(row), tiles) as int)")).drop("tiles")


SCHEMA = "key {key}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of documents: ``start`` and ``length`` in the document, ``ids`` (little-endian
    unsigned 32-bit), the document's number of tokens, and the place in a sequence.

    ``tokenizer`` is a file of the tokenizers library that every machine has. Every
    document ends with ``end``; a null or empty text is that token alone. Repeated rows
    and rows without key are packed like others. Sequences hold ``window`` tokens, or a
    power of two at the end of a shard, and so have no padding. ``sequence_id`` holds the
    partition in its upper bits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if window & (window - 1):
        raise ValueError("the window is a power of two")
    width = encoder_of(tokenizer).width
    tokens = encoded(docs, tokenizer, key, text)
    corpus = statistics(tokens, width)
    shared = tokens.sparkSession.sparkContext.broadcast(corpus)
    arrow = to_arrow_schema(_parse_datatype_string(schema := SCHEMA.format(key=tokens.schema["key"].dataType.simpleString())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        keys, shard, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal base
            pieces = packed_order(shard, window, shared.value)
            doc, start, length, sequence, offset = (list(x) for x in zip(*pieces))
            ids = [shard[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc, start, length)]
            columns = {
                "key": [keys[d] for d in doc], "start": start, "length": length, "ids": ids,
                "doc_tokens": [len(shard[d]) for d in doc], "sequence_id": [base + s for s in sequence], "offset": offset,
            }
            base += max(sequence) + 1
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for k, cell in zip(batch.column("key").to_pylist(), batch.column("ids")):
                keys.append(k)
                shard.append(np.append(np.frombuffer(cell.as_buffer(), width), width.type(end)))
                held += len(shard[-1])
                if held >= SHARD_TOKENS or len(shard) >= SHARD_DOCS:
                    yield close()
                    keys, shard, held = [], [], 0
        if shard:
            yield close()

    near = together(tokens, corpus, width).repartition("term", "tile").sortWithinPartitions("term", "tile", "other", "row")
    return near.select("key", "ids").mapInArrow(run, schema).withColumnRenamed("key", key)
