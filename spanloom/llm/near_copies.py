"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a bound, verified exactly.

Candidates come from two searches, and every one is verified on the whole sets
(as 64-bit hashes of shingles).  The first is that of ``simhash``: fingerprints
of the sets, linked by deletion-variant signatures where at most three bits
differ.  Texts of similarity 0.8 differ in ten bits or more, though, and no cut
of 64 bits leaves a segment with at most one of so many.  So there is a second
one, by bands of min-hashes: a pair of similarity s shares a given band with
probability s**ROWS, so one of 0.8 shares none of the BANDS with
(1 - 0.8**ROWS)**BANDS, about 2 in 10**9, whatever the texts' lengths.

Texts of equal sets are one node.  In a bucket, nodes are first verified
against its smallest node; then those pairs are left that components found so
far do not join already: those of small buckets as rows, those of larger ones
compared where the bucket's sets are, so no group makes a quadratic number of
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import component_names, links, majority
from .storage import salted_join, shuffle_width, sized, spread_join, written

SHINGLE = 5
LEAST = 0.8
BANDS = 50
ROWS = 5
#: Buckets of up to ``_SMALL`` nodes make pairs; larger ones are compared in place, chunk against chunk of about ``CHUNK`` nodes and ``CHUNK_BYTES`` at most.
_SMALL = 8
CHUNK = 1024
CHUNK_BYTES = 16 << 20
_BLOCK = 2048

_draw = np.random.default_rng(42)
_XOR = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_TIMES = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_MIX = _draw.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _draw.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values (seed 42) of the shingles of op5's words; all words are one shingle if there are fewer."""
    words = (text or b"").lower().split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)] if words else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, 42) for g in grams], dtype="<u8"))


def node_of(hashes: np.ndarray) -> int:
    """Signed long that stands for a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64)) if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A signed long for each band of the set's min-hashes; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    low, least = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(low), _BLOCK):
        v = (low[s : s + _BLOCK] ^ _XOR) * _TIMES
        np.minimum(least, v.min(axis=1), out=least)
    return ((least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 1.0


def _nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, fp, size, keys) of every row; size is that of its set."""
    rows = docs.select("doc_id", docs["text"].cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, keys = [], [], [], []
            for v in batch.column(1):
                h = shingle_set(v.as_py(), shingle)
                nodes.append(node_of(h))
                fps.append(majority(h))
                sizes.append(len(h))
                keys.append(band_keys(h))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "node", "fp", "size", "keys"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, node long, fp long, size long, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of every row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 256):
                each = [h for v in batch.column(0)[s : s + 256] if len(h := shingle_set(v.as_py(), shingle))]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in each], pa.int64()), pa.array([h.tobytes() for h in each], pa.binary())], names=["node", "hashes"])

    return docs.select(docs["text"].cast("binary").alias("_text")).mapInArrow(run, "node long, hashes binary")


def _met(nodes: DataFrame) -> DataFrame:
    """(key, node, leader) of every node that is not the smallest, the leader, of its bucket."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node").repartition(shuffle_width(nodes.sparkSession), "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            key, node = (c.to_numpy() for c in batch.columns)
            new = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            leader = np.where(at >= 0, node[at], last[1] if last else 0)
            last = key[-1], leader[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[~new]) for c in (key, node, leader)], names=["key", "node", "leader"])

    return keyed.mapInArrow(run, "key long, node long, leader long")


def _printed(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes whose fingerprints are equal or link, one node standing for each fingerprint."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("one")), "set-prints")
    near = links(prints.select("fp"))
    one = lambda c, n: prints.select(F.col("fp").alias(c), F.col("one").alias(n))
    linked = near.join(one("a", "x"), "a").join(one("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = spread_join(nodes.select("fp", "node"), prints, "fp", nodes).where("one <> node").select(F.col("one").alias("a"), F.col("node").alias("b"))
    return linked.unionByName(same)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b; a written table) that are similar enough; sets of sizes too different are not read."""
    x, y = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("a", "x"), ("b", "y")))
    both = salted_join(pairs.join(y, "b"), x, "a", pairs).where(F.least(F.octet_length("x"), F.octet_length("y")) >= least * F.greatest(F.octet_length("x"), F.octet_length("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _bucket_edges(nodes: list[int], of: list[int], sets: list[np.ndarray], sides: list[int], least: float) -> tuple[list[int], list[int]]:
    """Similar pairs of a bucket between components; ones that found pairs join are not compared again.

    ``sides``: chunk of each node; if there are two, only pairs across them are compared.
    """
    n = np.array([len(h) for h in sets])
    label, side = np.unique(of, return_inverse=True)[1], np.array(sides)
    two, a, b = len(set(sides)) > 1, [], []
    for k in range(len(nodes) - 1):
        fit = (np.minimum(n[k + 1 :], n[k]) >= least * np.maximum(n[k + 1 :], n[k])) & ((side[k + 1 :] != side[k]) | (not two))
        for m in np.flatnonzero(fit & (label[k + 1 :] != label[k])) + k + 1:
            if label[m] != label[k] and similarity(sets[k], sets[m]) >= least:
                a.append(nodes[k])
                b.append(nodes[m])
                label[label == label[m]] = label[k]
    return a, b


def _within(members: DataFrame, sets: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b): similar pairs between components ``of`` inside buckets ``key`` of ``n`` nodes and ``w`` shingles, compared where the bucket's sets are.

    Buckets beyond ``chunk`` nodes or ``CHUNK_BYTES`` are cut, and every two chunks meet in a row group of their own.
    """
    cut = members.withColumn("m", F.expr(f"cast(greatest(ceil(n / {chunk}), ceil(w / {CHUNK_BYTES // 8})) as int)")).withColumn("c", F.expr("cast(pmod(xxhash64(node), m) as int)"))
    met = cut.withColumn("t", F.explode(F.expr("sequence(0, m - 1)"))).select("key", F.least("c", "t").alias("i"), F.greatest("c", "t").alias("j"), "c", "node", "of")
    rows = met.join(sets, "node").select("key", "i", "j", "c", "node", "of", "hashes")
    dealt = rows.repartition(shuffle_width(sets.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def edges(group: list) -> pa.RecordBatch:
        _, _, _, c, node, of, h = zip(*group, strict=True)
        a, b = _bucket_edges(node, of, [np.frombuffer(x, "<u8") for x in h], c, least)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield edges(group)
                    group = []
                group.append(row)
        if group:
            yield edges(group)

    return dealt.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, component_id (smallest doc_id reachable by pairs of similarity ``least`` or more).

    Null and word-less texts are copies of each other. Null doc_ids take part but name
    no component unless it has no other id (then it is null); repeated rows
    are kept; extra columns are ignored.
    """
    prints = written(_nodes(docs, shingle), "nodes")
    distinct = prints.where("node <> 0").select("node", "fp", "size", "keys").dropDuplicates(["node"])
    met = written(_met(distinct), "met")
    printed = _printed(written(distinct.select("fp", "node"), "fingerprinted"))
    first = written(met.select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(printed).distinct(), "pairs")
    # sets of nodes that met another one only, from one document each
    wanted = written(first.select(F.col("a").alias("node")).union(first.select("b")).distinct(), "wanted")
    ids = written(prints.join(sized(wanted), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id")).select("_id").distinct(), "set-ids")
    rows = docs.select("doc_id", "text")
    few = sized(ids)
    sets = written(_sets(rows.join(few, rows["doc_id"].eqNullSafe(few["_id"]), "left_semi"), shingle).join(sized(wanted), "node", "left_semi").dropDuplicates(["node"]), "sets")

    edges = written(_verified(first, sets, least), "similar")
    joined = components(edges).withColumnRenamed("root", "of")
    size = prints.where("node <> 0").groupBy("node").agg(F.first("size").alias("size"))
    members = met.select("key", "node").unionByName(met.select("key", F.col("leader").alias("node"))).distinct()
    held = written(members.join(joined, "node", "left").join(size, "node").select("key", "node", F.coalesce("of", "node").alias("of"), "size"), "held")
    mixed = held.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.min("of").alias("p"), F.max("of").alias("q")).where("p <> q").select("key", "n", "w")
    left = written(spread_join(held, mixed, "key", held), "mixed")
    few = left.where(f"n <= {_SMALL}")
    x, y = few.select("key", F.col("node").alias("a"), F.col("of").alias("p")), few.select("key", F.col("node").alias("b"), F.col("of").alias("q"))
    rest = written(x.join(y, "key").where("a < b and p <> q").select("a", "b").distinct(), "rest")
    more = _verified(rest, sets, least).unionByName(_within(left.where(f"n > {_SMALL}"), sets, least))
    roots = written(components(edges.unionByName(written(more, "similar"))).select("node", "root"), "roots")

    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least")), "set-nodes")
    named = component_names(roots, nodes, "node")
    of = nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return spread_join(prints.select("doc_id", "node"), of, "node", prints).select("doc_id", "component_id")
