"""Language identification with language-bitmask n-gram filters.

Every language has the character n-grams that are typical for it in labelled texts.
They are put into Bloom filters of equal size that are stored bit-sliced: a slot holds
a bit per language, so the AND of an n-gram's slots returns all languages that have it
at once. A text's n-grams are counted per language by those bits, counts are corrected
for the filters' false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, texts_of, written

N = 4
HASHES = 3
UNKNOWN = "und"
# Bounds of the sample to learn from: about so many labelled documents and characters per
# language, by a hash of the key. All that the sample teaches is kept, so a filter holds at
# most FIT_CHARS / MIN_COUNT n-grams.
FIT_ROWS = 8_000
FIT_CHARS = 1 << 25
MIN_COUNT = 3
# An n-gram is typical for a language if it is at least this fraction as frequent there
# as in the language where it is most frequent.
TYPICAL = 0.34
BITS_PER_NGRAM = 12
PIECE = 1 << 22  # letters of a text handled at once
SCORE_FLOOR = 0.10


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points in lower case, everything but letters as single spaces, two at the ends."""
    low = text.lower()
    carry = np.array([32, 32], np.uint32)
    for at in range(0, len(low), PIECE):
        points = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([carry, np.where(_letters()[points], points, np.uint32(32))])
        space = points == 32
        keep = np.ones(len(points), bool)
        keep[2:] = ~(space[2:] & space[1:-1])
        points = points[keep]
        carry = points[-(N - 1) :]
        yield points
    yield np.concatenate([carry, np.array([32, 32], np.uint32)])


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """64-bit codes of all n-grams that hold a letter, a piece of the text at a time."""
    if not text:
        return
    for points in _pieces(text):
        if len(points) < N:
            continue
        wide = points.astype(np.uint64)
        code = np.zeros(len(points) - N + 1, np.uint64)
        blank = np.ones(len(code), bool)
        for i in range(N):
            part = wide[i : len(points) - N + 1 + i]
            code = code * np.uint64(0x9E3779B97F4A7C15) + part
            blank &= part == 32
        code = code[~blank]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
        if len(code):
            yield code


def _slots(code: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The n-gram's slots; ``size`` is a power of two."""
    step = (code >> np.uint64(33)) | np.uint64(1)
    for i in range(HASHES):
        yield ((code + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``table[slot]`` holds a bit per language."""

    languages: list[str]
    table: np.ndarray  # slots x bytes
    false_rate: np.ndarray  # per language

    @staticmethod
    def build(languages: list[str], members: dict[int, np.ndarray]) -> Filters:
        """``members``: the n-gram codes of each language, by its position."""
        most = max((len(m) for m in members.values()), default=0)
        size = 1 << max(10, int(np.ceil(np.log2(max(1, most * BITS_PER_NGRAM)))))
        table = np.zeros((size, max(1, -(-len(languages) // 8))), np.uint8)
        for k, codes in members.items():
            for at in _slots(codes, size):
                table[at, k // 8] |= np.uint8(1 << (k % 8))
        full = np.unpackbits(table, axis=1, bitorder="little").mean(axis=0)[: len(languages)]
        return Filters(languages, table, full**HASHES)

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """N-grams of the text, and per language how many of them its filter returns."""
        total, found = 0, np.zeros(self.table.shape[1] * 8, np.int64)
        for code in ngrams(text):
            total += len(code)
            for byte in range(self.table.shape[1]):
                column = self.table[:, byte]
                masks = np.bitwise_and.reduce([column[at] for at in _slots(code, len(column))])
                found[byte * 8 : byte * 8 + 8] += np.bincount(masks, minlength=256) @ _BITS
        return total, found[: len(self.languages)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and share of its n-grams, corrected; no letter gives ``und`` and 0.

        A tie goes to the language that comes first by name.
        """
        total, found = self.counts(text)
        if not total or not self.languages:
            return UNKNOWN, 0.0
        share = (found / total - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        best = int(np.argmax(share))
        return self.languages[best], float(np.clip(share[best], 0.0, 1.0))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filters:
    """Learn the filters from rows with a label; null labels and texts teach nothing.

    About ``FIT_ROWS`` documents and ``FIT_CHARS`` characters per language are read, chosen by
    a hash of the key; n-gram counts are summed before they leave the executors. What comes to
    the driver grows with that sample and the number of languages, not with the table.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).filter("l is not null and t is not null")
    sizes = {r.l: (r.n, r.chars) for r in rows.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars")).collect()}
    if not sizes:
        return Filters.build([], {})
    shares = [(l, min(1.0, FIT_ROWS / n, FIT_CHARS / max(1, chars))) for l, (n, chars) in sizes.items()]
    draw = F.expr("pmod(xxhash64(k, 'fit'), 1048576) / 1048576")
    chosen = rows.join(F.broadcast(spark.createDataFrame(shares, "l string, share double")), "l").filter(draw < F.col("share"))
    chosen = chosen.select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for l, t in zip(batch.column("l").to_pylist(), texts_of(batch, "t")):
                for code in ngrams(t):
                    by_lang.setdefault(l, []).append(code)
            for l, codes in by_lang.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_pydict({"l": pa.array([l] * len(code)), "code": code.view(np.int64), "n": n.astype(np.int64)})

    counted = written(chosen.mapInArrow(count, "l string, code bigint, n bigint").groupBy("l", "code").agg(F.sum("n").alias("n")), "ngrams")
    totals = counted.groupBy("l").agg(F.sum("n").alias("total"))  # a row per language
    top = counted.join(F.broadcast(totals), "l").select("l", "code", "n", (F.col("n") / F.col("total")).alias("rate"))
    peak = top.groupBy("code").agg(F.max("rate").alias("peak"))
    typical = top.join(peak, "code").filter((F.col("n") >= MIN_COUNT) & (F.col("rate") >= TYPICAL * F.col("peak")))
    found: pd.DataFrame = typical.select("l", "code").toPandas()
    by_language = {l: codes.to_numpy(np.int64).view(np.uint64) for l, codes in found.groupby("l")["code"]}
    # documents without a letter can leave a language without n-grams: it is known all the same
    languages = sorted(sizes)
    members = {k: by_language.get(l, np.empty(0, np.uint64)) for k, l in enumerate(languages)}
    return Filters.build(languages, members)


def predict(docs: DataFrame, model: Filters, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, lang_pred, score)`` for every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        found = [shared.value.predict(t) for t in texts_of(batch, "t")]
        return {"key": batch.column("k"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_batches(rows, run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from learning. A null key hashes as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def accepted(docs: DataFrame, text: str = "text", key: str = "doc_id", floor: float = SCORE_FLOOR) -> DataFrame:
    """All columns of the documents that are in some known language.

    Rejected: texts without a letter, null ones included, and texts of which less than
    ``floor`` of the n-grams are typical for the best language. Where the labelled
    documents taught no n-gram there is nothing to judge by: every text with a letter stays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    model = fit(docs.filter(~held_out(key)), text=text, key=key)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = to_arrow_schema(docs.schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            if machine.table.any():
                good = [lang != UNKNOWN and score >= floor for lang, score in map(machine.predict, texts_of(batch, text))]
            else:
                good = [machine.counts(t)[0] > 0 for t in texts_of(batch, text)]
            columns = [batch.column(f.name).cast(f.type) for f in names]
            yield pa.RecordBatch.from_arrays(columns, schema=names).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
