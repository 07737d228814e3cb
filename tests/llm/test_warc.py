"""WARC: exact round trips, members at the indexed offsets, and revisits."""

import base64
import glob
import gzip
import hashlib
import os

import pytest

from tabwright.llm import warc as w
from tabwright.llm.common import shared_folder

NASTY = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
ROWS = [
    (1, "http://x/", "<p>one</p>"), (2, "http://y/ä b\r\n", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "http://z/WARC/1.0", NASTY),
    (6, "v", "é🙂" * 1000), (7, "v", "\n"), (8, "v", NASTY), (9, "", "x" * 200_000), (None, "w", "<p>one</p>"), (2, "again", "<p>one</p>"),
    (10, "v", w.EMPTY_MEMBER.decode("latin-1")),
]


def written_back(spark, rows):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string").repartition(3)
    whole, single = shared_folder(spark, "m"), shared_folder(spark, "a")
    w.write_monoliths(pages, whole)
    w.normalise(spark, whole, single)
    return whole, single, w.read_index(spark, single)


@pytest.mark.parametrize("archive,task", [(1 << 24, 1 << 26), (500, 1 << 26), (500, 100)])
def test_round_trip(spark, archive, task, monkeypatch):
    monkeypatch.setattr(w, "ARCHIVE_BYTES", archive)
    monkeypatch.setattr(w, "TASK_BYTES", task)
    whole, single, index = written_back(spark, ROWS)
    records = w.read_records(spark, single, index).collect()
    got = sorted((str(r.record_id and r.record_id[10:-1]), bytes(r.payload)) for r in records)
    assert got == sorted((str(k), (h or "").encode()) for k, _, h in ROWS)
    assert {r.uri for r in records if r.record_id == "<urn:page:2>"} == {"http://y/ä%20b%20%20", "again"}
    monoliths = b"".join(sorted(gzip.open(f).read() for f in glob.glob(f"{whole}/*.gz")))
    files = {os.path.basename(os.path.dirname(f))[8:]: open(f, "rb").read() for f in glob.glob(f"{single}/kind=archive/*/part-*")}
    assert sum(len(gzip.decompress(f)) for f in files.values()) == len(monoliths)
    for e in index.collect():
        record = gzip.decompress(files[e.archive][e.offset : e.offset + e.length])
        assert record.startswith(w.VERSION) and record.endswith(b"\r\n\r\n")
        assert len(record.partition(b"\r\n\r\n")[2]) == e.payload_bytes + 4
    # one record alone, by its entry
    one = index.filter("record_id = '<urn:page:6>'")
    assert [bytes(r.payload).decode() for r in w.read_records(spark, single, one).collect()] == [ROWS[5][2]]


def test_types(spark):
    _, single, index = written_back(spark, ROWS)
    rows = w.digests(w.read_records(spark, single, index), "page_id", "bigint")
    found = w.with_types(rows, "page_id").collect()
    assert len(found) == len(ROWS)
    by_payload = {}
    for k, _, h in ROWS:
        by_payload.setdefault((h or "").encode(), []).append(k)
    want = []
    for payload, keys in by_payload.items():
        ordered = sorted(keys, key=lambda k: (k is not None, k or 0))
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want += [(str(k), len(payload), sha, "response" if i == len(keys) - 1 else "revisit", str(None if i == len(keys) - 1 else ordered[-1])) for i, k in enumerate(ordered)]
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found) == sorted(want)
    small = w.with_types(rows, "page_id", smallest=1).filter("payload_bytes = 0").collect()
    assert {r.record_type for r in small} == {"response"}


def test_empty_table(spark):
    _, single, index = written_back(spark, ROWS[:1])
    assert w.read_records(spark, single, index.limit(0)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    whole, single = shared_folder(spark, "m"), shared_folder(spark, "a")
    w.write_monoliths(pages, whole)
    w.normalise(spark, whole, single)
    rows = w.digests(w.read_records(spark, single, w.read_index(spark, single)), "page_id", "bigint")
    assert w.with_types(rows, "page_id").count() == 0
