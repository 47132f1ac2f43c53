"""Sequence packing by best-fit decreasing over a segment tree of capacities.

A document's ids (with one closing id) are cut into full windows and a rest.
A full window is a sequence by itself; the rests are packed: longest first,
each into the open sequence with the least room that still takes it.  Rooms
are small integers, so the open sequences stand in stacks by room, and a
segment tree over the rooms answers "smallest room >= n" in log2(window) steps.

Pieces are dealt to blocks by a hash of the piece and its place, about
``block_pieces`` in each whatever repeats, and blocks are packed apart; a block
leaves a few open sequences at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stable_chars import is_stable
from .storage import written

WINDOW = 2048
BLOCK_PIECES = 40_000


class RoomTree:
    """Segment tree over rooms 0..window; a leaf holds how many open sequences have that room."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        node, count = room + self.size, self.count
        while node:
            count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least room of at least ``need`` that some open sequence has, or -1."""
        node, size, count = need + self.size, self.size, self.count
        if count[node]:
            return need
        while node > 1:  # up, until a right-hand sibling holds something
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - size


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) for each of ``lengths``, which are in decreasing order."""
    tree, stacks, used, out = RoomTree(window), [[] for _ in range(window + 1)], [], []
    for n in lengths:
        room = tree.tightest(n) if n < window else -1
        if room < 0:
            seq, room = len(used), window
            used.append(0)
        else:
            seq = stacks[room].pop()
            tree.add(room, -1)
        out.append((seq, used[seq]))
        used[seq] += n
        if left := room - n:
            stacks[left].append(seq)
            tree.add(left, 1)
    return out


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, ranks: str, pattern: str, special: tuple[tuple[str, int], ...]):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(special))
    library = Tokenizer.from_file(vocabulary)

    def encode(text: str) -> np.ndarray:
        if is_stable(text):
            return np.array(fast.encode(text, allowed_special="all", disallowed_special=()), dtype="<u4")
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def cut_documents(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, special: dict[str, int], end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens): full windows, then the rest.

    ``ranks`` is the same vocabulary as ``vocabulary``, read by a faster
    encoder; texts with characters on which the two may differ go to the
    library itself.
    """
    rows = docs.select("doc_id", docs["text"].alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()
    specials = tuple(sorted(special.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, ranks, pattern, specials)
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for k, value in enumerate(batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), window):
                    piece = ids[s : s + window]
                    at.append(k)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(long(at)), long(start), long(length), long(crc), long(total)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, window: int = WINDOW, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces``, a written table, with ``sequence_id`` and ``offset``; ties go by id, start and checksum.

    The place of a row in the table is part of its block's key, so equal
    pieces are spread over the blocks like others.
    """
    count = pieces.count()
    blocks = max(1, -(-count // block_pieces))
    key = F.xxhash64("doc_id", "start", "ids_crc32", "length", "doc_tokens", F.monotonically_increasing_id())
    dealt = pieces.withColumn("_block", F.pmod(key, F.lit(blocks)))

    def run(part: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        part = part.take(pc.sort_indices(part, sort_keys=order))
        placed = best_fit_decreasing(part["length"].to_pylist(), window)
        base = part["_block"][0].as_py() << 32
        part = part.drop_columns("_block").append_column("sequence_id", pa.array([base + s for s, _ in placed], pa.int64()))
        return part.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("_block").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, special: dict[str, int], end_id: int = 1, window: int = WINDOW, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``window`` ids.

    Null text is empty and yields the closing id alone; null and repeated
    doc_ids are kept, each row's pieces by themselves; extra columns are
    ignored; no documents, no pieces.
    """
    return pack(written(cut_documents(docs, vocabulary, ranks, pattern, special, end_id, window), "pieces"), window, block_pieces)


def padding(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, ids, and the share of places that padding to ``window`` fills."""
    total = packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("ids"))
    return total.withColumn("padding", F.when(F.col("sequences") > 0, 1 - F.col("ids") / (F.col("sequences") * window)).otherwise(0.0))
