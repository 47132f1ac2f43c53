"""WARC archives: segmented, chunked records written and reassembled.

Writing: a page is an HTTP response with chunked transfer framing.  Of pages
with equal payloads of at least ``REVISIT_BYTES`` the one with the smallest id
is a response record and the others are revisit records without a body.
Blocks over ``SEGMENT_BYTES`` are cut: the first segment is the response
record, the others are continuation records that name it as their origin, and
the last one states the total length.  Records are gzip members of their own.

A revisit names the response's record by its id, which is made of page and
digest, so both sides know it without meeting.

Reading: whole records are decoded where they are parsed.  Segments are
brought together by origin, ordered by number, checked for gaps and against
the total length, joined, and only then is the chunked framing decoded.  A
revisit is resolved through the record it refers to and held against it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_dir, open_fs, shuffle_width, sized, spread_join, written

#: A block beyond this is cut; about one page in four is.
SEGMENT_BYTES = 4 << 10
CHUNK_BYTES = 1 << 10
ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for s in range(0, len(payload), size) if (c := payload[s : s + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The data of a chunked body; extensions and trailers are passed over, anything broken raises."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without line end")
        n = int(body[at:end].split(b";")[0], 16)
        if n < 0:
            raise ValueError("negative chunk size")
        if n == 0:
            return b"".join(out)
        at = end + 2 + n
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[end + 2 : at])
        at += 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response block, its transfer framing taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    if any(line.lower().split(b":", 1) == [b"transfer-encoding", b" chunked"] for line in head.split(b"\r\n")):
        return dechunked(body)
    return body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive stream; header names in lower case."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        if "content-length" not in headers:
            raise ValueError("record without a length")
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("record shorter than its length")
        yield headers, block


def record_id(page_id, digest: str) -> str:
    """The id of the response record of a page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id} {digest}')}>"


def page_records(page_id, url, payload: bytes, digest: str, first, times, least: int, segment: int, chunk: int) -> Iterator[bytes]:
    """A page's record, or records if its block is cut.

    ``first``: the page whose response this one revisits; ``times``: how many
    rows are that page, null if none has an equal payload.  Where they are
    several no id can name one of them; each has a random one, and revisits
    state the digest alone.
    """
    sole = len(payload) >= least and (times is None or times == 1)
    known = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%")), ("Page-Id", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is not None:
        block = _HTTP.replace(b"Transfer-Encoding: chunked", b"Content-Length: 0")
        refers = ("WARC-Refers-To", record_id(first, digest) if sole else None)
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *known, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), refers], block)
        return
    own = record_id(page_id, digest) if sole else f"<urn:uuid:{uuid.uuid4()}>"
    block = _HTTP + chunked(payload, chunk)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *known], block)
        return
    last = -(-len(block) // segment)
    for k in range(1, last + 1):
        total = ("WARC-Segment-Total-Length", len(block) if k == last else None)
        part = block[(k - 1) * segment : k * segment]
        if k == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *known, ("WARC-Segment-Number", 1)], part)
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), total], part)


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, ``first`` (the id that a revisit refers to, else null) and ``times`` (rows that are ``first``; null for a payload by itself).

    Counts per digest are small rows.  While the digests that repeat are few
    they are broadcast and payloads stay where they are; more meet the payloads
    in one skew-splittable join, where payloads below ``least`` bytes get keys
    of their own, for nothing can match them.
    """
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", raw.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    each = rows.where(F.octet_length("payload") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    of = each.groupBy("digest").agg(first.alias("f"), F.sum("n").alias("n")).where("n > 1")
    firsts = written(of.select(F.col("digest").alias("_key"), F.col("f.page_id").alias("first"), F.coalesce("f.n", "n").alias("times")), "repeated-payloads")
    own = F.concat_ws(" ", F.lit("own"), F.col("page_id").cast("string"), "url")
    key = F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(own)
    both = rows.withColumn("_key", key).join(sized(firsts), "_key", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return both.select("page_id", "url", "payload", "digest", refers.alias("first"), "times")


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` below ``folder``; rows (path, records) of the archives, to be evaluated once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name, done, out, size, n = uuid.uuid4().hex, [], None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{name}-{len(done)}.warc.gz"
                    out, size, n = fs.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                for r in page_records(*row, least, segment, chunk):
                    data = gzip.compress(r, 4, mtime=0)
                    out.write(data)
                    size, n = size + len(data), n + 1
                if size >= limit:
                    out.close()
                    done.append((f"{folder}/{path}", n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return mark_revisits(pages, least).mapInArrow(run, "path string, records long")


_RECORD = [("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("status", pa.string())]
_RECORD_DDL = "record_id string, page_id string, url string, record_type string, refers string, payload_bytes long, payload_digest string, payload binary, status string"
_PARSED = pa.schema([*_RECORD, ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
_PARSED_DDL = f"{_RECORD_DDL}, origin string, number long, total long, block binary"
_HELD_BYTES = 8 << 20


def _decoded(block: bytes, stated: str | None, keep: bool) -> dict:
    try:
        payload = http_payload(block)
    except ValueError:
        return {"status": "bad framing"}
    digest = hashlib.sha256(payload).hexdigest()
    wrong = stated is not None and stated.removeprefix("sha256:") != digest
    return {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload if keep else None, "status": "digest differs" if wrong else "ok"}


class _Sound(io.RawIOBase):
    """What can be decompressed of a stream; ``fault`` tells an end from a break."""

    def __init__(self, source):
        self.source, self.fault = source, False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        try:
            data = self.source.read1(len(into))
        except (EOFError, zlib.error, gzip.BadGzipFile):
            self.fault, data = True, b""
        into[: len(data)] = data
        return len(data)


def parse_archive(source, keep: bool) -> Iterator[dict]:
    """Rows of ``_PARSED``: whole records decoded, segments as they are; after the records that can be read, one row of status "archive broken" if the rest can't."""
    sound = _Sound(source)
    at = records(io.BufferedReader(sound, 1 << 20))
    while True:
        try:
            h, block = next(at, (None, None))
            number, total = (h or {}).get("warc-segment-number"), (h or {}).get("warc-segment-total-length")
            number, total = None if number is None else int(number), None if total is None else int(total)
        except ValueError:
            sound.fault, h = True, None
        if h is None:
            if sound.fault:
                yield {"status": "archive broken", "origin": f"broken {uuid.uuid4()}"}
            return
        kind, own = h.get("warc-type"), h.get("warc-record-id") or f"none {uuid.uuid4()}"
        row = {"record_id": own, "page_id": h.get("page-id"), "url": h.get("warc-target-uri"), "record_type": kind, "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, "origin": own}
        if kind == "revisit":
            yield row | {"refers": h.get("warc-refers-to")}
        elif number is not None:
            yield row | {"origin": h.get("warc-segment-origin-id", own), "number": number, "total": total, "block": block}
        elif kind == "response":
            yield row | _decoded(block, row["payload_digest"], keep)


def _joined(parts: list[dict], keep: bool) -> dict:
    """The record of an origin's segments, in order of their numbers, each number once."""
    first, last = parts[0], parts[-1]
    row = {n: first[n] for n in ("page_id", "url", "payload_digest")} | {"record_id": first["origin"], "record_type": "response" if first["number"] == 1 else "continuation"}
    if first["number"] != 1 or last["number"] != len(parts) or last["total"] is None:
        return row | {"status": "segment missing", "payload_digest": None}
    block = b"".join(p["block"] for p in parts)
    if len(block) != last["total"]:
        return row | {"status": "length differs", "payload_digest": None}
    return row | _decoded(block, first["payload_digest"], keep)


def reassemble(parsed: DataFrame, keep: bool = False) -> DataFrame:
    """Parsed rows with segments put together: one row for each origin.

    ``status``: ok; "segment missing" (no first or last one, or a gap);
    "length differs" (from the stated total); "bad framing"; "digest differs".
    A repeated segment number counts once.  Rows come in order of origin and
    number, so a task holds one record at a time.
    """
    near = parsed.repartition(shuffle_width(parsed.sparkSession), "origin").sortWithinPartitions("origin", "number")
    out_schema = pa.schema(_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, parts = [], 0, []

        def add(row: dict) -> None:
            nonlocal held
            rows.append({n: row.get(n) for n in out_schema.names})
            held += 200 + len(row.get("payload") or b"")

        for batch in batches:
            for row in batch.to_pylist():
                if parts and row["origin"] != parts[0]["origin"]:
                    add(_joined(parts, keep))
                    parts = []
                if row["number"] is None:
                    add(row)
                elif not parts or parts[-1]["number"] != row["number"]:
                    parts.append(row)
                if held > _HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=out_schema)
                    rows, held = [], 0
        if parts:
            add(_joined(parts, keep))
        yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    return near.mapInArrow(run, _RECORD_DDL)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """``found``, a written table, with ``refers_to`` (page) in place of record_id and refers.

    A revisit gets its length from the response it names, or where it names
    none from one of its digest; ``status`` is "response missing" if there is
    no sound one, "digest differs" if its payload is another.
    """
    names = [n for n, _ in _RECORD if n not in ("record_id", "refers")]
    whole = found.where("record_type = 'response' and status = 'ok'")
    key = F.when(F.col("refers").isNull(), F.concat(F.lit("sha256:"), F.coalesce("payload_digest", F.lit("")))).otherwise(F.col("refers"))
    revisits = found.where("record_type = 'revisit'").withColumn("_key", key)
    asked = written(revisits.groupBy("_key").agg(F.count("*").alias("n")), "asked-records").select("_key")
    to = F.struct(F.col("page_id").alias("page"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("digest"))
    named = whole.select(F.col("record_id").alias("_key"), to.alias("to")).unionByName(whole.select(F.concat(F.lit("sha256:"), "payload_digest").alias("_key"), to.alias("to")))
    answers = asked.join(named.join(asked, "_key", "left_semi").groupBy("_key").agg(F.min("to").alias("to")), "_key", "left")
    met = spread_join(revisits, answers, "_key", revisits)
    state = F.when(F.col("to").isNull(), "response missing").when(~F.col("to.digest").eqNullSafe(F.col("payload_digest")), "digest differs").otherwise("ok")
    again = met.withColumns({"payload_bytes": F.col("to.n"), "status": state}).select(*names, F.col("to.page").alias("refers_to"))
    return found.where("record_type is null or record_type <> 'revisit'").select(*names, F.lit(None).cast("string").alias("refers_to")).unionByName(again)


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Records of the archives named in column ``path``, continuation records put together and revisits resolved.

    Rows: page_id (string), url, record_type, payload_bytes, payload_digest,
    payload (null unless kept), status and refers_to (string).  An archive that
    is cut off or no WARC gives the records before the fault, and a row of
    nulls with status "archive broken".
    """
    spark = archives.sparkSession
    each = archives.select("path").repartition(max(shuffle_width(spark), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(name) as raw, gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw as data:
                    for row in parse_archive(data, keep_payload):
                        rows.append(row)
                        held += 200 + len(row.get("block") or b"") + len(row.get("payload") or b"")
                        if held > _HELD_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)

    return resolve_revisits(written(reassemble(each.mapInArrow(run, _PARSED_DDL), keep_payload), "records"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back.

    A null html is an empty payload.  Rows that repeat the smallest page_id of
    equal payloads are responses as well; a null page_id is never the smallest,
    so such a row revisits any equal page that has an id.  Extra columns are
    ignored; no pages, no rows.
    """
    archives = written(write_archives(pages, fresh_dir(pages.sparkSession, "warc"), **options), "archives")
    id_type = pages.schema["page_id"].dataType
    return read_archives(archives).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
