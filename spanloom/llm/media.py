"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as the samples of an 8-bit grey PNG, 576 wide.
Tasks append images to tar shards of bounded size in the shared folder, under
the payload's SHA-256.  A payload that several rows have is stored once: its
copies are brought together first, by a partial aggregation that keeps one a
task, and only they are shuffled.  Rows carry digest, shard, offset and length
only.  Metadata columns are filled by range reads of the header bytes, the
payload by a range read of the whole entry.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_dir, open_fs, shuffle_width, sized, spread_join, written

WIDTH = 576
SHARD_BYTES = 64 << 20
READ_SPAN = 4 << 20
#: Signature, IHDR and its checksum: all that the metadata columns need.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad_payload(raw: bytes, width: int = WIDTH) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ``width``."""
    return raw + b"\xff" * (width - len(raw) if not raw else -len(raw) % width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Metadata of the first ``HEADER_BYTES`` bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not the header of a PNG")
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", head[16:29])
    return {"width": width, "height": height, "bit_depth": depth, "channels": {0: 1, 2: 3, 4: 2, 6: 4}[colour]}


def decode_png(png: bytes) -> np.ndarray:
    """Samples of an 8-bit grey image with unfiltered rows."""
    meta, at, data = png_header(png), 8, b""
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IDAT":
            data += png[at + 8 : at + 8 + n]
        at += n + 12
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are stored here")
    return rows[:, 1:]


class ShardWriter:
    """Appends entries to tar shards ``folder/<name>-<k>.tar``; ``put`` gives (shard, offset, length)."""

    def __init__(self, folder: str, limit: int = SHARD_BYTES):
        self.fs, self.folder = open_fs(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.uri, self.name, self.limit, self.k, self.out = folder, uuid.uuid4().hex, limit, 0, None

    def put(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at >= self.limit:
            self.close()
        if self.out is None:
            self.out, self.at = self.fs.open_output_stream(f"{self.folder}/{self.name}-{self.k}.tar"), 0
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % 512))
        place = f"{self.uri}/{self.name}-{self.k}.tar", self.at + 512, len(data)
        self.at += 512 + len(data) + -len(data) % 512
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out, self.k = None, self.k + 1


def keyed_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, digest, raw) of every text; a null one is empty."""
    raw = docs.select("doc_id", F.coalesce(docs["text"].cast("binary"), F.lit(b"")).alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    padded = f"sha2(rpad(raw, cast(greatest(ceil(n_bytes / {width}), 1) * {width} as int), x'FF'), 256)"
    return raw.select("doc_id", "n_bytes", F.expr(padded).alias("digest"), "raw")


def store(rows: DataFrame, folder: str, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``rows`` (among others digest and raw) with shard, offset and length in place of raw, whose payload is stored below ``folder``.

    Lazy: evaluate once and keep the rows (``written``), for every evaluation
    writes shards of its own.
    """
    names = [c for c in rows.columns if c != "raw"]
    at, raw = names.index("digest"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardWriter(folder, shard_bytes)
        for batch in batches:
            out = [shards.put(digest.as_py(), encode_png(pad_payload(value.as_py(), width), width)) for digest, value in zip(batch.column(at), batch.column(raw), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 3
            kinds = (("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:raw], *(pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True))], names=[*names, *(n for n, _ in kinds)])
        shards.close()

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, "raw").mapInArrow(run, f"{schema}, shard string, offset long, length long")


@dataclass
class Stored:
    """Rows and the places of their payloads: ``alone`` (doc_id, n_bytes, digest, shard, offset, length), the rows whose payload no other row has; ``copies`` (doc_id, n_bytes, digest), the others; ``once`` (digest, shard, offset, length), the places of these."""

    alone: DataFrame
    copies: DataFrame
    once: DataFrame

    def rows(self) -> DataFrame:
        """(doc_id, n_bytes, digest, shard, offset, length) of every row."""
        return self.alone.unionByName(spread_join(self.copies, self.once, "digest", self.copies))

    def filled(self, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``rows`` with the columns that ``read`` adds to places; a place is read once, however many rows share it."""
        shared = written(read(self.once), "media-shared")
        return read(self.alone).unionByName(spread_join(self.copies, shared, "digest", self.copies))


def stored(docs: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> Stored:
    """Every distinct payload of ``docs`` stored once in a fresh folder of the shared one.

    A null text is empty; equal texts have equal places; doc_ids may be null
    or repeat, every row is kept; extra columns are ignored.
    """
    folder, rows = fresh_dir(docs.sparkSession, "media"), keyed_texts(docs, width)
    repeated = sized(written(rows.groupBy("digest").count().where("count > 1").select("digest"), "media-repeated"))
    alone = written(store(rows.join(repeated, "digest", "left_anti").select("doc_id", "n_bytes", "digest", "raw"), folder, width, shard_bytes), "media-rows")
    several = rows.join(repeated, "digest", "left_semi")
    once = written(store(several.groupBy("digest").agg(F.first("raw").alias("raw")), folder, width, shard_bytes), "media-places")
    return Stored(alone, written(several.select("doc_id", "n_bytes", "digest"), "media-copies"), once)


def _range_reads(rows: DataFrame, of, schema: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """``rows``, places that no other row has, with the columns that ``of(file, offset, length)`` gives."""
    near = rows.repartition(shuffle_width(rows.sparkSession), "shard", F.floor(F.col("offset") / READ_SPAN)).sortWithinPartitions("shard", "offset")
    names = near.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        for batch in batches:
            out = []
            for shard, offset, length in zip(*(batch.column(names.index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    fs, path = open_fs(shard)
                    file, name = fs.open_input_file(path), shard
                out.append(of(file, offset, length))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(schema))], names=[*names, *(n for n, _ in schema)])

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema)
    return near.mapInArrow(run, f"{have}, {ddl}")


_HEADER = [(n, pa.int64()) for n in ("width", "height", "bit_depth", "channels")]
_HEADER_DDL = "width long, height long, bit_depth long, channels long"


def _header(file, offset: int, length: int) -> tuple:
    file.seek(offset)
    return tuple(png_header(file.read(min(length, HEADER_BYTES))).values())


def with_metadata(rows: DataFrame) -> DataFrame:
    """``rows`` with width, height, bit_depth and channels, from header-only range reads."""
    return _range_reads(rows, _header, _HEADER, _HEADER_DDL)


def with_payload_features(rows: DataFrame) -> DataFrame:
    """``rows`` with what range reads of the whole stored entries give: sizes, digests and a feature string."""

    def of(file, offset, length):
        file.seek(offset)
        png = file.read(length)
        samples = decode_png(png)
        payload = samples.tobytes()
        feature = f"png {samples.shape[1]}x{samples.shape[0]} grey mean {samples.mean():.3f} deviation {samples.std():.3f}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature

    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    return _range_reads(rows, of, kinds, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
