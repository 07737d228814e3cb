"""WARC archives: from one gzip stream per file to one gzip member per record.

A monolithic archive is a single gzip stream, so no record can be read without
inflating all before it. The normaliser inflates each stream once, as it is read by
Spark's text reader in pieces that end at a version line, puts records together by
their Content-Length, and writes every record as a member of its own, with a sidecar
index of offsets and lengths. A record is then a slice of its file.

Files are written by Spark's text writer, so they land wherever Spark can write. The
writer puts a separator after each row; here it is an empty gzip member, which every
gzip reader skips. Archives roll over at ``ARCHIVE_BYTES``; a record is held whole, a
file never.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tabwright.llm.common import exists, map_batches, written

VERSION = b"WARC/1.0\r\n"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
ARCHIVE_BYTES = 8 << 20
TASK_BYTES = 64 << 20  # archives that one task reads, about
LEVEL = 6
RECORDS_AT_ONCE = 512
RECORDS = "archive string, offset bigint, record_id string, uri string, payload binary"
INDEX = "archive string, offset bigint, length bigint, record_id string, uri string, payload_bytes bigint, payload_digest string"


def write_monoliths(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """One gzip stream of WARC records per partition. A null payload is an empty one; a null
    key or URL has no header. Control characters and blanks of a URL are written as escapes."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))

    def header(name: str, value) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    record = F.concat(
        F.lit(VERSION.decode() + "WARC-Type: response\r\n"),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.url_encode(F.col(key).cast("string")), F.lit(">"))),
        header("WARC-Target-URI", F.regexp_replace(F.col(url), r"[\x00-\x20\x7F]", "%20")),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
        body, F.lit("\r\n\r"),
    )  # fmt: skip  # the writer adds the last line feed
    pages.select(record.alias("value")).write.option("compression", "gzip").text(path)


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, the record's bytes and its payload, from what lies between version lines."""
    data, parts, size, need = b"", [], 0, None
    for piece in pieces:
        # a version line inside a header or a payload was no record's beginning
        parts += [VERSION, piece] if parts else [piece]
        size += len(piece) + (len(VERSION) if len(parts) > 1 else 0)
        if need is None:
            data = b"".join(parts)
            parts = [data]
            end = data.find(b"\r\n\r\n")
            if end < 0:
                if not data.strip():
                    parts, size = [], 0  # before the first record
                continue
            headers = {}
            for line in data[:end].decode("utf-8", "replace").split("\r\n"):
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = value.strip()
            need = end + 4 + int(headers["content-length"])
        if size >= need:
            data = b"".join(parts)
            yield headers, VERSION + data[:need] + b"\r\n\r\n", data[end + 4 : need]
            data, parts, size, need = b"", [], 0, None
    if need is not None or b"".join(parts).strip():
        raise ValueError("the archive ends inside a record")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """The record as a gzip member with a fixed header, so equal records give equal bytes."""
    return gzip.compress(record, LEVEL, mtime=0)


def normalise(spark: SparkSession, monoliths: str, path: str) -> None:
    """Rewrite all archives of a folder: ``path/kind=archive/archive=NAME/`` has one file of
    members, ``path/kind=index/archive=NAME/`` its sidecar. Streams are inflated once."""
    pieces = (
        spark.read.option("lineSep", VERSION.decode()).text(monoliths)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("piece"))
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, p) for b in batches for f, p in zip(b.column("file").to_pylist(), b.column("piece").to_pylist()))
        out: list[tuple[str, str, int, bytes]] = []
        held = 0
        for row in _rewritten(rows):
            out.append(row)
            held += len(row[3])
            if held > 4 << 20:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kind, archive, seq, value = map(list, zip(*rows))
        return pa.RecordBatch.from_pydict({"kind": kind, "archive": archive, "seq": pa.array(seq, pa.int64()), "value": pa.array(value, pa.binary())})

    rows = pieces.mapInArrow(rewrite, "kind string, archive string, seq bigint, value binary")
    (
        rows.sortWithinPartitions("kind", "archive", "seq")
        .select("kind", "archive", F.col("value").cast("string").alias("value"))
        .write.partitionBy("kind", "archive")
        .options(lineSep=EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1")
        .text(path)
    )


def _rewritten(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, str, int, bytes]]:
    """Rows ``(kind, archive, seq, value)`` of the archives and their index, file after file."""
    pending: list[tuple[str, bytes]] = []

    def of_one_file() -> Iterator[bytes]:
        while pending and pending[0][0] == name:
            yield pending.pop()[1]
            if (more := next(rows, None)) is not None:
                pending.append(more)

    if (row := next(rows, None)) is not None:
        pending.append(row)
    while pending:
        name = pending[0][0]
        part = seq = offset = 0
        entries: list[str] = []
        for headers, record, payload in _records(of_one_file()):
            if offset >= ARCHIVE_BYTES:
                part, offset = part + 1, 0
            archive = f"{name.partition('.')[0]}-{part:05d}"
            value = member(record)
            yield "archive", archive, seq, value
            entry = (offset, len(value), headers.get("warc-record-id", ""), quote(headers.get("warc-target-uri", "")), len(payload), digest(payload))
            yield "index", archive, seq, "\t".join(map(str, entry)).encode()
            seq, offset = seq + 1, offset + len(value) + len(EMPTY_MEMBER)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecars as a table, a row per record; none where no record was written."""
    if not exists(spark, f"{path}/kind=index"):
        return spark.createDataFrame([], INDEX)
    lines = (
        spark.read.schema("value string, archive string").options(lineSep=EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1")
        .option("basePath", f"{path}/kind=index").text(f"{path}/kind=index")
    )
    cells = F.split("value", "\t", -1)
    names = [x.split()[0] for x in INDEX.split(", ")][1:]
    kinds = dict(x.split() for x in INDEX.split(", "))
    return lines.filter("value <> ''").select("archive", *(cells[i].cast(kinds[n]).alias(n) for i, n in enumerate(names)))


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The records that ``index`` lists: each is sliced out of its archive and inflated alone.

    Returns ``archive, offset, record_id, uri, payload``, with null for an absent id or
    URI. A slice that is not one record with the digest of the index ends the job.
    """
    if not exists(spark, f"{path}/kind=archive"):
        return spark.createDataFrame([], RECORDS)
    files = (
        spark.read.format("binaryFile").option("basePath", f"{path}/kind=archive").load(f"{path}/kind=archive")
        .select(F.col("archive").cast("string").alias("archive"), "length", "content")
    )
    entry = F.struct("offset", "length", "payload_digest")
    places = index.select("archive", "offset", "length", "payload_digest")
    parts = -(-files.select("length").agg(F.sum("length")).first()[0] // TASK_BYTES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        # the session's partitions would be too large for archives to meet their entries there
        files, places = files.repartition(parts, "archive"), places.repartition(parts, "archive")
    wanted = places.groupBy("archive").agg(F.collect_list(entry).alias("entries"))

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, entries in zip(*(batch.column(c) for c in ("archive", "content", "entries"))):
                file, places = memoryview(content.as_buffer()), entries.as_py()
                for at in range(0, len(places), RECORDS_AT_ONCE):
                    rows = [_record_at(file, e) for e in places[at : at + RECORDS_AT_ONCE]]
                    yield pa.RecordBatch.from_pylist([{"archive": name.as_py(), **r} for r in rows], schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(RECORDS))
    return files.join(wanted, "archive").select("archive", "content", "entries").mapInArrow(inflate, RECORDS)


def _record_at(file: memoryview, entry: dict) -> dict:
    stream = zlib.decompressobj(wbits=31)
    record = stream.decompress(file[entry["offset"] : entry["offset"] + entry["length"]]) + stream.flush()
    ((headers, _, payload),) = _records(iter([record[len(VERSION) :]]))
    if stream.unused_data or digest(payload) != entry["payload_digest"]:
        raise ValueError("the index does not fit the archive")
    own = {"record_id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri")}
    return {"offset": entry["offset"], **own, "payload": payload}


def page_key(record_id: Column) -> Column:
    """The key that ``write_monoliths`` put into the record's id, as text."""
    return F.url_decode(F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1))


def with_types(records: DataFrame, key: str, smallest: int = 0) -> DataFrame:
    """Adds ``record_type`` and ``refers_to`` to rows with ``payload_digest`` and ``payload_bytes``.

    Of equal payloads of at least ``smallest`` bytes the one with the largest key (nulls
    last, then the latest place) is the response, the others revisit it.
    """
    place = F.struct(key, "archive", "offset")
    kept = (
        records.filter(F.col("payload_bytes") >= smallest).groupBy("payload_digest", "payload_bytes")
        .agg(F.max(place).alias("kept"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    )
    # written, so that a hot payload's rows come from a shuffle that Spark can split
    kept = written(kept, "kept")
    again = F.col("kept").isNotNull() & (F.col("kept") != place)
    return (
        records.join(kept, ["payload_digest", "payload_bytes"], "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col(f"kept.{key}")))
        .drop("kept")
    )


def digests(records: DataFrame, key: str, kind: str) -> DataFrame:
    """``key, payload_bytes, payload_digest, archive, offset`` of read records."""

    def run(batch: pa.RecordBatch) -> dict:
        payloads = [p.as_py() for p in batch.column("payload")]
        own = {c: batch.column(c) for c in ("record_id", "archive", "offset")}
        return own | {"payload_bytes": list(map(len, payloads)), "payload_digest": list(map(digest, payloads))}

    found = map_batches(records, run, "record_id string, archive string, offset bigint, payload_bytes bigint, payload_digest string")
    return written(found.select(page_key("record_id").cast(kind).alias(key), *found.columns[1:]), "records")
