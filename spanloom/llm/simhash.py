"""SimHash near-duplicates by deletion-variant signatures.

64-bit fingerprints of word shingles link when at most three bits differ.  The
fingerprint is cut into two halves; three differing bits leave at most one in
one of them.  So each distinct fingerprint is indexed, for each half, under
the half itself and under its 32 variants with one bit struck out: linked
fingerprints meet under an equal key, and what meets is verified on all bits.
Under a variant only pairs that differ in the struck bit matter, since the
others meet under the half itself.

Equal keys are found by one sort.  Inside a bucket the links of a spanning
forest are emitted, not all pairs.  A bucket beyond ``CHUNK`` fingerprints is
cut into chunks, and every two chunks of it are a row of their own, so no task
holds more than two chunks.  Components follow by contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import columns_of, shuffle_width, sized, spread_join, unused, written

SHINGLE = 3
BITS = 3
CHUNK = 8192
_SMALL = 24


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' XXH64 bits (seed 42), as an unsigned integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, 42) for g in grams], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes ``h`` have, as an unsigned integer."""
    total = np.zeros(64, np.int64)
    for s in range(0, len(h), 1 << 15):
        total += np.unpackbits(h[s : s + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    rows = docs.select("doc_id", docs["text"].cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(v.as_py(), shingle) for v in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long")


def variant_keys(fps: DataFrame) -> DataFrame:
    """(key, fp), 66 rows for each fp: key is (half, struck bit or none) above the half's remaining bits."""
    return fps.select(
        F.expr("""explode(transform(sequence(0, 65), v -> shiftleft(cast(v as bigint), 32) |
            (if(v < 33, fp & 4294967295L, shiftrightunsigned(fp, 32)) &
             if(v % 33 = 0, 4294967295L, ~shiftleft(1L, v % 33 - 1)))))""").alias("key"),
        "fp",
    )


def _close(a, b, bits: int):
    return np.bitwise_count(a ^ b) <= bits


def spanning_links(fps: np.ndarray, bits: int, other: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest among ``fps``, or between ``fps`` and ``other``, by breadth-first search."""
    sides = [fps, fps if other is None else other]
    left = [np.arange(len(fps)), np.arange(len(sides[1]))]
    if other is None:
        left[1] = left[0]
    a, b = [], []
    while len(left[0]):
        queue = [(0, left[0][0])]
        left[0] = left[0][1:]
        if other is None:
            left[1] = left[0]
        while queue:
            side, k = queue.pop()
            to = 1 - side if other is not None else 0
            rest = left[to]
            near = _close(sides[to][rest], sides[side][k], bits)
            if near.any():
                hit = rest[near]
                left[to] = rest[~near]
                if other is None:
                    left[1] = left[0]
                a.append(np.full(len(hit), sides[side][k]))
                b.append(sides[to][hit])
                queue += [(to, x) for x in hit]
    return a, b


def _bucket_links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within whole buckets; ``keys`` is sorted."""
    a, b = [], []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    big = sizes > _SMALL
    for s, n in zip(starts[big], sizes[big], strict=True):
        x, y = spanning_links(fps[s : s + n], bits)
        a += x
        b += y
    small = np.repeat(~big & (sizes > 1), sizes)
    keys, fps = keys[small], fps[small]
    struck = (keys >> 32) // 33 * 32 + (keys >> 32) % 33 - 1
    whole = (keys >> 32) % 33 == 0
    one = np.uint64(1)
    for d in range(1, _SMALL):
        same = np.flatnonzero(keys[:-d] == keys[d:])
        if not len(same):
            break
        x, y = fps[same], fps[same + d]
        ok = _close(x, y, bits) & (whole[same] | (((x ^ y) >> np.maximum(struck[same], 0).astype(np.uint64)) & one).astype(bool))
        a.append(x[ok])
        b.append(y[ok])
    return a, b


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("chunk", pa.int64()), ("fps", pa.binary())])
_LINKS_DDL = "a long, b long, key long, chunk long, fps binary"


def _link_rows(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate(v).view(np.int64) if v else np.empty(0, np.int64) for v in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *(pa.nulls(len(x), t) for t in _LINKS.types[2:])], schema=_LINKS)


def _chunk_row(key: int, chunk: int, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"key": key, "chunk": chunk, "fps": fps.tobytes()}], schema=_LINKS)


def links(fps: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b) between distinct fingerprints ``fps`` (column fp): a graph with the components of "at most 3 bits differ"."""
    if bits > 3:
        raise ValueError("two halves with one struck bit find up to three differing bits")
    keyed = variant_keys(fps).repartition(shuffle_width(fps.sparkSession), "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, cut = np.empty(0, np.int64), np.empty(0, np.uint64), 0
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            held = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                if cut:  # the bucket that was cut ends here
                    end = int(np.searchsorted(keys, keys[0], side="right"))
                    yield _link_rows(*spanning_links(held[:end], bits))
                    yield _chunk_row(int(keys[0]), cut, held[:end])
                    keys, held, last, cut = keys[end:], held[end:], last - end, 0
                if last:
                    yield _link_rows(*_bucket_links(keys[:last], held[:last], bits))
                    keys, held = keys[last:], held[last:]
            while len(keys) > chunk:
                yield _link_rows(*spanning_links(held[:chunk], bits))
                yield _chunk_row(int(keys[0]), cut, held[:chunk])
                keys, held, cut = keys[chunk:], held[chunk:], cut + 1
        if len(keys):
            if cut:
                yield _link_rows(*spanning_links(held, bits))
                yield _chunk_row(int(keys[0]), cut, held)
            else:
                yield _link_rows(*_bucket_links(keys, held, bits))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                yield _link_rows(*spanning_links(np.frombuffer(x.as_py(), np.uint64), bits, np.frombuffer(y.as_py(), np.uint64)))

    found = written(keyed.mapInArrow(run, _LINKS_DDL), "links")
    near = found.where("fps is null").select("a", "b")
    cuts = found.where("fps is not null")
    ends = written(cuts.groupBy("key").agg(F.max("chunk").alias("last")), "cut-buckets")
    if ends.isEmpty():
        return near
    # every chunk goes to each of its pairs, whose tasks are dealt by the whole pair
    each = spread_join(cuts.select("key", "chunk", "fps"), ends, "key", cuts).select("key", "chunk", "fps", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    x = each.where("chunk < other").select("key", F.col("chunk").alias("i"), F.col("other").alias("j"), F.col("fps").alias("x"))
    y = each.where("chunk > other").select("key", F.col("other").alias("i"), F.col("chunk").alias("j"), F.col("fps").alias("y"))
    pairs = x.join(y, ["key", "i", "j"]).select("x", "y")
    return near.unionByName(pairs.mapInArrow(across, _LINKS_DDL).select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed long), component_id (smallest doc_id reachable by links).

    Null and word-less texts have fingerprint 0 and link like any other; null
    doc_ids take part but name no component unless it has no other id (then it
    is null); repeated rows are kept; extra columns are ignored.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = written(components(links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp"), "roots")
    named = component_names(roots, nodes, "fp")
    of = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return spread_join(prints, of, "fp", prints).select("doc_id", "fp", "component_id")


def component_names(roots: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, component_id) of ``roots`` (key, root): the least id that ``nodes`` (key, least) have in the component."""
    linked = written(roots.join(nodes, key).select(key, "root", "least"), "linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(linked, named, "root", linked).select(key, "component_id")


def keep_one_of_each(docs: DataFrame, groups: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """``docs`` with one row of each component that ``groups`` finds; same columns.

    A row is its doc_id and its text, so rows that share a doc_id are told
    apart.  The row with the smallest doc_id stays, of these that with the
    least digest, and one of equal rows; rows without a doc_id come last.
    Texts are shuffled only where the rows that go are too many to broadcast,
    or for the copies of a doc_id and text that occur more than once.
    """
    digest = unused("_digest", docs)
    rows = docs.withColumn(digest, F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    of = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(digest).alias("digest"))
    found = written(groups(rows.select(of.alias("doc_id"), "text"), **options).select("doc_id", "component_id"), "near-groups")
    each = written(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id")), "near-rows")
    drop = each.where("n > 1 or doc_id <> component_id").select("doc_id.id", "doc_id.digest")
    same = lambda few: rows["doc_id"].eqNullSafe(few["id"]) & (rows[digest] == few["digest"])
    kept = rows.join(few := sized(drop), same(few), "left_anti")
    twice = each.where("n > 1 and doc_id = component_id").select("doc_id.id", "doc_id.digest")
    if not twice.isEmpty():
        kept = kept.unionByName(rows.join(few := sized(twice), same(few), "left_semi").dropDuplicates(["doc_id", digest]))
    return kept.select(columns_of(docs))
