"""Exact top-k inner products over vectors in order of their lengths.

Components are floored integers, so scores are exact.  Distinct vectors are
written as one table in descending length; a task takes a block of queries and
walks that table from its longest vectors on.  No pair is formed whose
Cauchy-Schwarz bounds rule it out: a whole rest of the table when length times
length stays below every query's k-th score so far, and a single vector when
the product over the leading components of an SVD rotation, plus the product of
the lengths of what remains, stays below it.  What survives is scored in full.

Vectors are rotated by the eigenvectors of their Gram matrix, summed over the
whole table.  Bounds are floating-point and so are widened by a margin; scores
are sums of integers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fresh_dir, open_fs, shuffle_width, written

SCALE = 64
EVERY = 20
TOP = 20
#: Queries that walk the table together, and vectors read at a time: together they bound a task's matrices.
QUERIES, CHUNK = 2048, 2048
#: Shares of the vectors' energy that may remain behind the first and the second partial sum.
REST = (0.25, 0.1)
#: Share of pairs below which survivors are scored one by one.
SPARSE = 0.2
MARGIN = 1e-9

_LONG = np.iinfo(np.int64)


def _floored(x: str) -> str:
    return f"if(abs({x}) < 4503599627370496D, cast(floor({x}) as double), {x})"


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): floor(scale * x) of every component, as doubles; vectors that are null or have components that are null or not finite are left out."""
    scaled = rows.select(rows["vec_id"].cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> cast(x as double) * {scale}D)").alias("x"))
    whole = scaled.where("x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    return whole.select("vec_id", F.expr(f"transform(x, v -> {_floored('v')})").alias("q"))


def _norm(q: str) -> Column:
    return F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, v: a + v * v))


def _distinct(vectors: DataFrame, most: int) -> DataFrame:
    """(h, q, ids): distinct vectors with the ``most`` smallest of their ids, as no list of results can hold more of them."""
    keyed = vectors.withColumn("h", F.xxhash64("q"))
    nth = F.row_number().over(Window.partitionBy("h", "q").orderBy(F.col("vec_id").asc_nulls_last()))
    few = keyed.withColumn("_n", nth).where(F.col("_n") <= most)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_n", "vec_id"))), lambda s: s["vec_id"])
    return few.groupBy("h", "q").agg(ids.alias("ids"))


def _rotation(vectors: DataFrame, d: int) -> tuple[np.ndarray, list[int]]:
    """Eigenvectors of the sum of q q', by falling eigenvalues, and the numbers of leading ones that partial sums go over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1)  # directions matter, not lengths
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(gram.ravel())], names=["cell", "v"])

    gram = np.zeros(d * d)
    for r in vectors.select("q").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toLocalIterator():
        gram[r.cell] = r.v
    return rotation_of(gram.reshape(d, d))


def rotation_of(gram: np.ndarray) -> tuple[np.ndarray, list[int]]:
    energy, v = np.linalg.eigh(gram)
    rest = 1 - np.cumsum(np.maximum(energy[::-1], 0)) / max(energy.sum(), 1e-300)
    cuts = [int(np.argmax(rest <= share)) + 1 for share in REST]
    return v[:, ::-1].copy(), [c for c in dict.fromkeys(cuts) if c < len(gram)]


def _parts(folder: str) -> list[str]:
    """The table's files in order of their parts, so by falling length."""
    from pyarrow import fs

    files, root = open_fs(folder)
    names = [f.path for f in files.get_file_info(fs.FileSelector(root)) if re.search(r"/part-\d+[^/]*\.parquet$", f.path)]
    return sorted(names, key=lambda p: int(re.search(r"/part-(\d+)", p)[1]))


def _chunks(folder: str, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.ListArray]]:
    """(vectors, lengths, ids) of ``CHUNK`` vectors at a time, longest first."""
    import pyarrow.parquet as pq

    files, _ = open_fs(folder)
    for path in _parts(folder):
        with files.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(CHUNK, columns=["norm", "q", "ids"]):
                at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
                yield at["q"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d), at["norm"].to_numpy(), at["ids"]


def exact_scores(q: np.ndarray, c: np.ndarray, safe: bool) -> np.ndarray:
    """Integer inner products of rows with rows; ``safe``: sums stay below 2**53.  Others are summed as integers and held to 64 bits."""
    if safe:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    sums = (sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(q, c, strict=True))
    return np.array([min(max(s, _LONG.min), _LONG.max) for s in sums], np.int64)


class Walk:
    """The best ``top`` (score, id) of a block of queries, as far as the table has been walked."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: tuple[np.ndarray, list[int]], top: int, safe: bool):
        self.ids, self.q, self.top, self.safe = ids, q, top, safe
        self.v, self.cuts = rotation
        self.rotated = q @ self.v
        self.norm = np.linalg.norm(q, axis=1)
        self.rest = [np.linalg.norm(self.rotated[:, c:], axis=1) for c in self.cuts]
        self.kth = np.full(len(ids), -np.inf)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))]
        self.scored = 0

    def live(self, longest: float) -> np.ndarray:
        """Queries to which a vector of that length can still matter."""
        reach = self.norm * longest
        return np.flatnonzero(~(reach + MARGIN * reach + MARGIN < self.kth))

    def meet(self, c: np.ndarray, norm: np.ndarray, ids: pa.ListArray) -> bool:
        """Take in the next vectors; False if no query needs these or any later ones."""
        live = self.live(norm[0])
        if not len(live):
            return False
        a, b = self._survivors(live, c, norm)
        scores = exact_scores(self.q[a], c[b], self.safe)
        self.scored += len(a)
        good = ~(scores < self.kth[a])
        self._merge(a[good], b[good], scores[good], c, ids)
        return True

    def _survivors(self, live: np.ndarray, c: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slack = MARGIN * self.norm[live][:, None] * norm[None] + MARGIN
        kth = self.kth[live][:, None]
        rotated = c @ self.v
        part, rest = np.zeros((len(live), len(c))), self.norm[live][:, None] * norm[None]
        if self.cuts:
            part = self.rotated[live, : self.cuts[0]] @ rotated[:, : self.cuts[0]].T
            rest = self.rest[0][live][:, None] * np.linalg.norm(rotated[:, self.cuts[0] :], axis=1)[None]
        keep = ~(part + rest + slack < kth)
        if self.safe and keep.mean() > SPARSE:  # too many: their products at once, and of these each query's best
            full = self.q[live] @ c.T
            over = full.shape[1] - self.top - 1  # one more than asked for: a query's own row will go
            least = np.partition(full, over, axis=1)[:, over, None] if over > 0 else -np.inf
            at, b = np.nonzero(keep & (full >= np.maximum(kth, least)))
            return live[at], b
        at, b = np.nonzero(keep)
        for (lo, hi), rest_q in zip(zip(self.cuts, self.cuts[1:], strict=False), self.rest[1:], strict=False):
            more = part[at, b] + np.einsum("ij,ij->i", self.rotated[live[at], lo:hi], rotated[b, lo:hi])
            left = rest_q[live[at]] * np.linalg.norm(rotated[:, hi:], axis=1)[b]
            ok = ~(more + left + slack[at, b] < self.kth[live[at]])
            at, b = at[ok], b[ok]
        return live[at], b

    def _merge(self, a: np.ndarray, b: np.ndarray, scores: np.ndarray, c: np.ndarray, ids: pa.ListArray) -> None:
        if not len(a):
            return
        ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        many = np.diff(ends)[b]
        at = np.arange(many.sum()) + np.repeat(ends[b] - (np.cumsum(many) - many), many)
        flat = ids.flatten()
        known, ids_ = flat.is_valid().to_numpy(zero_copy_only=False)[at], flat.fill_null(0).to_numpy()[at]
        q, pair, s = np.repeat(a, many), np.repeat(np.arange(len(a)), many), np.repeat(scores, many)
        own = np.flatnonzero(known & (ids_ == self.ids[q]))
        own = own[(self.q[q[own]] == c[b[pair[own]]]).all(1)]
        own = own[np.unique(pair[own], return_index=True)[1]]  # the query's own row; its like stay
        keep = np.ones(len(q), bool)
        keep[own] = False
        rows = [np.concatenate(x) for x in zip(*self.best, (q[keep], s[keep], ids_[keep], known[keep]), strict=True)]
        order = np.lexsort((rows[2], ~rows[3], ~rows[1], rows[0]))  # ~x falls as x rises, and never overflows
        rows = [x[order] for x in rows]
        first = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]])) if len(order) else np.empty(0, np.int64)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
        top = place < self.top
        self.best = [tuple(x[top] for x in rows)]
        full = top & (place == self.top - 1)
        self.kth[rows[0][full]] = rows[1][full]

    def rows(self) -> pa.RecordBatch:
        q, score, ids, known = self.best[0]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]]))) + 1
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(rank.astype(np.int32)), pa.array(ids, mask=~known), pa.array(score)], names=["query_id", "rank", "vec_id", "score"])


def exact_topk(vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` the ``top`` other rows of highest inner product.

    Vectors that are null or have null or non-finite components take no part;
    shorter vectors count as followed by zeros.  Equal scores are in order of
    vec_id, rows without one last (these are no queries).  Rows with equal
    vec_ids are vectors of their own, and only a query's own row is left out of
    its list.  Scores beyond 64 bits are held at the ends of that range.  Empty
    tables give no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    valid = quantised(vectors, scale)
    size = valid.agg(F.max(F.size("q")).alias("d"), F.max(F.array_max(F.transform("q", F.abs))).alias("peak"), F.count_if(F.col("vec_id") % every == 0).alias("n")).first()
    schema, d = "query_id long, rank int, vec_id long, score long", max(size.d or 0, 1)
    if not size.n:
        return spark.createDataFrame([], schema)
    safe = (size.peak or 0) ** 2 * d < 2**53
    valid = valid.withColumn("q", F.expr(f"concat(q, array_repeat(0D, {d} - size(q)))"))
    distinct = written(_distinct(valid, top + 1), "topk-distinct")
    rotation = _rotation(distinct, d)
    folder, parts = fresh_dir(spark, "topk-by-norm"), max(1, distinct.count() >> 16)
    distinct.select(_norm("q").alias("norm"), "h", "q", "ids").repartitionByRange(parts, F.col("norm").desc(), "h").sortWithinPartitions(F.col("norm").desc()).drop("h").write.parquet(folder)
    tasks = max(math.ceil(size.n / QUERIES), min(shuffle_width(spark), math.ceil(size.n / 64)))
    queries = valid.where(F.col("vec_id") % every == 0).repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches, d):
            walk = Walk(*block, rotation, top, safe)
            for chunk in _chunks(folder, d):
                if not walk.meet(*chunk):
                    break
            yield walk.rows()

    return queries.mapInArrow(run, schema)


def _blocks_of(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most ``QUERIES`` queries at a time."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, QUERIES):
            part = batch.slice(start, QUERIES)
            if n + part.num_rows > QUERIES:
                yield _joined(held, d)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield _joined(held, d)


def _joined(held: list[pa.RecordBatch], d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([b.column(1).flatten().to_numpy() for b in held]).reshape(-1, d)
