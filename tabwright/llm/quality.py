"""Quality rules: base counts and compression bands.

Text that repeats itself compresses too well, random text hardly at all. The ratio of
compressed to plain bytes is taken with zstandard over the whole document and over
fixed chunks of it; each must lie inside a band for its length, since short inputs
compress badly whatever they say. Random text over few letters, such as hexadecimal digits,
has the ratio of prose, but none of it comes from its order: so a second ratio holds the
compressed bytes against those of the same bytes shuffled, and it too has limits by length.

The limits come from all documents of the driver's tables at scale 0.1 that pass the base
rules: the greatest ratio in a band of lengths plus about five percent of it, and for the
second one a value between the greatest of prose and the least of random words (0.925 and 0.971
from 2 KB, 0.957 and 0.971 from 1.2 KB; at 1 KB they meet, and 0.3 % of prose lies beyond). Under
1 KB prose gains nothing over its letters either, so there only the first ratio speaks, and
short texts of hexadecimal digits stay.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, texts_of

LEVEL = 3
CHUNK_BYTES = 2048
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
# Bands: from so many bytes on, the ratio must lie between low and high. The frame's
# own bytes dominate below 64.
WHOLE_BANDS = [
    (0, 0.0, 9.0), (64, 0.18, 1.20), (256, 0.20, 0.76), (512, 0.20, 0.72), (1024, 0.20, 0.61), (2048, 0.20, 0.55),
    (4096, 0.20, 0.50), (8192, 0.20, 0.48), (65536, 0.18, 0.47),
]
CHUNK_BANDS = [(0, 0.0, 9.0), (256, 0.20, 0.95), (1024, 0.18, 0.61), (2048, 0.18, 0.55)]
# From so many bytes on, a text must compress better than its shuffled bytes by this factor.
ORDER_LIMITS = [(0, 0.0, 9.0), (1024, 0.0, 0.98), (1200, 0.0, 0.965), (2048, 0.0, 0.945)]
CHUNK_ORDER_LIMIT = 0.955
# A document goes when more than this share of its bytes is in chunks outside their bands.
MAX_BAD_CHUNKS = 0.25



def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in them, symbols, repeated lines with a word, and words in
    three-word windows that occur twice or more."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    with_word = [x for x in lines if x.strip(SPACES)] if len(lines) > 1 else lines[:1]
    repeated_lines = len(with_word) - len(set(with_word))
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) < len(words) - 2:
        covered = 0  # words before this position are counted or passed
        for at, window in enumerate(zip(words, words[1:], words[2:])):
            if windows[window] > 1:
                repeated += at + 3 - max(covered, at)
                covered = at + 3
    return len(words), chars, symbols, repeated_lines, repeated


def _band(bands: list[tuple[int, float, float]], size: int) -> tuple[float, float]:
    return bands[bisect.bisect_right(bands, (size, 9.9, 9.9)) - 1][1:]


def order_ratio(data: bytes, size: int, squeeze: zstandard.ZstdCompressor) -> float:
    """The compressed ``size`` against that of the same bytes in an order that depends on their number alone."""
    mixed = np.random.Generator(np.random.PCG64(len(data))).permutation(np.frombuffer(data, np.uint8))
    return size / len(squeeze.compress(mixed.tobytes()))


def chunks(data: bytes) -> Iterator[bytes]:
    """Fixed chunks; what is left at the end belongs to the last one."""
    last = max(1, len(data) // CHUNK_BYTES) - 1
    for i in range(last + 1):
        yield data[i * CHUNK_BYTES : (i + 1) * CHUNK_BYTES if i < last else len(data)]


def compression(data: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in chunks outside their bands, and whether all bands hold.

    No bytes: ratio 1, no bad chunk, and the bands hold. A text of one chunk is judged as a whole.
    """
    if not data:
        return 1.0, 0.0, True
    size = len(squeeze.compress(data))
    low, high = _band(WHOLE_BANDS, len(data))
    good = low <= size / len(data) <= high
    if len(data) < 2 * CHUNK_BYTES:
        good = good and (len(data) < ORDER_LIMITS[1][0] or order_ratio(data, size, squeeze) <= _band(ORDER_LIMITS, len(data))[1])
        return size / len(data), 0.0 if good else 1.0, good
    bad = 0
    for part in chunks(data):
        chunk_low, chunk_high = _band(CHUNK_BANDS, len(part))
        part_size = len(squeeze.compress(part))
        fits = chunk_low <= part_size / len(part) <= chunk_high
        bad += 0 if fits and order_ratio(part, part_size, squeeze) <= CHUNK_ORDER_LIMIT else len(part)
    return size / len(data), bad / len(data), good and bad <= MAX_BAD_CHUNKS * len(data)


SCHEMA = (
    "key {key}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, bad_chunk_share double"
)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with the base counts, ``base_failed``, ``kept`` and the ratios.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than half of the words in
    repeated windows. Null and empty texts have no words and so fail. Repeated rows are
    judged each; other columns are not looked at.
    """
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]

    def run(batch: pa.RecordBatch) -> dict:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for t in texts_of(batch, "t"):
            counts = base_counts(t)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED_PERCENT * counts[0]
            ratio, share, within = compression((t or "").encode(), squeeze)
            rows.append((*counts, failed, within and not failed, ratio, share))
        return {"key": batch.column("k"), **dict(zip(names[1:], map(list, zip(*rows))))}

    kind = docs.schema[key].dataType.simpleString()
    out = map_batches(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, SCHEMA.format(key=kind))
    return out.withColumnRenamed("key", key)
