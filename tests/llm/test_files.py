"""WARC archives and media shards: exact round trips."""

import hashlib
import io
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import media, warc
from spanloom.llm.storage import fresh_dir, written

TEXTS = [None, "", "a", "x" * 575, "x" * 576, "é" * 288, "é" * 300, "long " * 40000, "a", "\x00\n\r\n0\r\n\r\nWARC/1.1"]


def test_media(spark):
    rows = [(k, t, "clash", 1) for k, t in enumerate(TEXTS)] + [(None, "a", "", 2), (0, None, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, offset int")
    kept = media.stored(docs, shard_bytes=3000)
    got = kept.filled(media.with_payload_features).collect()
    assert sorted((r.doc_id, r.shard, r.offset, r.length) for r in kept.rows().collect() if r.doc_id is not None) == sorted((r.doc_id, r.shard, r.offset, r.length) for r in got if r.doc_id is not None)
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        want.setdefault((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])), 0)
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == set(want)
    by = {}
    for r in got:
        assert r.digest == r.payload_sha256
        assert by.setdefault(r.payload_sha256, x := (r.media_bytes, r.media_sha256, r.feature)) == x
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            info = tar.getmember(f"{r.digest[:2]}/{r.digest}.png")
            assert (info.offset_data, info.size) == (r.offset, r.length)
            assert hashlib.sha256(tar.extractfile(info).read()).hexdigest() == r.media_sha256
    # a payload has one place, whichever rows have it
    places = {(r.digest, r.shard, r.offset) for r in got}
    assert len(places) == len({r.digest for r in got})
    meta = kept.filled(media.with_metadata).collect()
    assert all((r.width, r.bit_depth, r.channels) == (576, 8, 1) and r.height == -(-max(r.n_bytes, 1) // 576) for r in meta)
    assert media.stored(docs.limit(0)).filled(media.with_payload_features).count() == 0


@pytest.mark.parametrize("segment, chunk", [(50, 7), (32 << 10, 4 << 10)])
def test_warc(spark, segment, chunk):
    html = [None, "", "tiny", "tiny", "é" * 60, "é" * 60, "é" * 60, "a\r\n\r\n0\r\n\r\n" * 9000, "WARC/1.1\r\n" * 20, "x" * 99, "x" * 99, "x" * 100, "x" * 100]
    rows = [(100 - k, None if k == 3 else f"http://h/ü {k}\n", h, 1) for k, h in enumerate(html)] + [(None, None, "x" * 100, 2), (None, "u", None, 3), (89, "u", "x" * 100, 4), (88, "v", "x" * 100, 4), (88, "v", "x" * 100, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, number int")
    got = warc.round_trip(pages, segment=segment, chunk=chunk, limit=2000).collect()
    least = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            least[h] = min(least.get(h, i), i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        first = least.get(h) if len(raw) >= 100 and least.get(h) != i else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first else "response", first, "ok"))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.status) for r in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_faults(spark):
    folder = fresh_dir(spark, "faults")
    pages = spark.createDataFrame([(k, "u", f"{k}" * 3000) for k in range(1, 5)], "page_id long, url string, html string")
    path = written(warc.write_archives(pages.coalesce(1), folder, segment=1000, chunk=4 << 10), "archives").first().path.removeprefix("file://")
    import gzip

    all_records = list(warc.records(io.BufferedReader(gzip.open(path))))
    own = {h["page-id"]: h["warc-record-id"] for h, _ in all_records if "page-id" in h}
    drop = lambda h, b: h.get("warc-segment-origin-id") == own["1"] and h["warc-segment-number"] == "2"
    out = []
    for h, b in all_records:
        if drop(h, b):
            continue
        if h.get("warc-segment-origin-id") == own["2"] and h["warc-segment-number"] == "3":
            b = b[:-1]
        if h.get("page-id") == "3":
            b = b.replace(b"bb8\r\n", b"bb9\r\n")
        out.append(warc.record([(k, v) for k, v in h.items() if k != "content-length"], b))
        if h.get("warc-segment-origin-id") == own["4"]:
            out.append(out[-1])  # a segment twice
    broken = f"{folder}/broken.warc"
    with open(broken.removeprefix("file://"), "wb") as f:
        f.write(b"".join(out))
    got = {r.page_id: r for r in warc.read_archives(spark.createDataFrame([(broken,)], "path string"), keep_payload=True).collect()}
    assert {i: r.status for i, r in got.items()} == {"1": "segment missing", "2": "length differs", "3": "bad framing", "4": "ok"}
    assert bytes(got["4"].payload) == b"4" * 3000
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    # cut off, and no archive at all
    whole = open(path, "rb").read()
    at = len(whole) - 40
    for name, data in {"cut.warc.gz": whole[:at], "text.warc": b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", "zip.warc.gz": b"PK" * 100, "empty.warc": b""}.items():
        open(f"{folder}/{name}".removeprefix("file://"), "wb").write(data)
    read = lambda n: sorted(((r.page_id, r.status) for r in warc.read_archives(spark.createDataFrame([(f"{folder}/{n}",)], "path string")).collect()), key=str)
    assert read("cut.warc.gz") == [("1", "ok"), ("2", "ok"), ("3", "ok"), ("4", "segment missing"), (None, "archive broken")]
    assert read("text.warc") == read("zip.warc.gz") == [(None, "archive broken")] and read("empty.warc") == []


def test_warc_revisits(spark):
    """A revisit is resolved by the record it names, or by its digest, and held against it."""
    folder, body = fresh_dir(spark, "revisits").removeprefix("file://"), "x" * 200
    digest = hashlib.sha256(body.encode()).hexdigest()
    one = lambda i, first=None, times=None, d=digest: b"".join(warc.page_records(i, "u", body.encode(), d, first, times, 100, 90, 20))
    other = b"".join(warc.page_records(9, "u", b"y" * 200, hashlib.sha256(b"y" * 200).hexdigest(), None, None, 100, 4096, 64))
    wrong = warc.record([("WARC-Type", "revisit"), ("Page-Id", 5), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Refers-To", warc.record_id(9, hashlib.sha256(b"y" * 200).hexdigest()))], b"")
    import os

    os.makedirs(folder)
    open(f"{folder}/a.warc", "wb").write(one(2, 1) + one(3, 1, 2) + one(4, 7) + one(1) + other + wrong)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.status) for r in warc.read_archives(spark.createDataFrame([(f"{folder}/a.warc",)], "path string")).collect()}
    assert got == {
        "1": ("response", None, 200, "ok"), "2": ("revisit", "1", 200, "ok"), "3": ("revisit", "1", 200, "ok"), "4": ("revisit", None, None, "response missing"), "5": ("revisit", "9", 200, "digest differs"), "9": ("response", None, 200, "ok"),
    }
    assert spark.range(1).select(F.lit(1)).count() == 1
