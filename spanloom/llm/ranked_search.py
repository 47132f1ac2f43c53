"""Ranked lexical search by sort-based accumulation.

The terms of a block of items are sent to all tasks; they turn documents into
short rows of matched terms, which are written once and give the statistics
(documents, terms, document frequencies).  A second pass scores them: for a run
of documents, the (item, document, impact) triples of all matched terms are
concatenated as arrays, their packed item-document keys are radix sorted, and
each key's impacts are summed by ``reduceat``.  A task keeps a heap of the best
documents of each item over all its runs, so what is shuffled is at most
``top`` rows for each item and task; these are selected again, first within
ranges of documents and then over all.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontamination import _once, fold_words
from .storage import written

TOP = 10
#: Size of the terms of a block of items, each with 16 bytes of overhead; a block is larger only if it is one item.
BLOCK_BYTES = 4 << 20
#: Triples that a run of documents is cut at, and its most documents.
RUN, RUN_DOCS = 1 << 21, 1 << 14


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative integers, by digits of 16 bits; numpy sorts such digits by radix."""
    order, top, shift = np.arange(len(keys)), int(keys.max(initial=0)), 0
    while top >> shift:
        digit = (keys[order] >> shift).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


def accumulate(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


class Impacts:
    """The items of a block as arrays: for each term its items and their weights."""

    def __init__(self, items: list[int], terms: list[int], weights: list[int], n_items: int, n_terms: int):
        order = np.argsort(np.array(terms, np.int64), kind="stable")
        self.item = np.array(items, np.int64)[order]
        self.weight = np.array(weights, np.int64)[order]
        self.count = np.bincount(np.array(terms, np.int64), minlength=n_terms)
        self.start = np.cumsum(self.count) - self.count
        self.n_items = n_items

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of every pair that the matched terms give."""
        many = self.count[term]
        at = np.arange(many.sum()) + np.repeat(self.start[term] - (np.cumsum(many) - many), many)
        keys, sums = accumulate(self.item[at] * n_docs + np.repeat(doc, many), self.weight[at] * np.repeat(impact, many))
        return keys // n_docs, keys % n_docs, sums


class Best:
    """For each item a heap of its ``top`` best documents: highest score, then smallest doc_id, ids that are null last."""

    def __init__(self, n_items: int, top: int):
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(n_items)]
        self.top = top
        self.least, self.last = np.zeros(n_items, np.int64), np.full(n_items, np.iinfo(np.int64).max)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Items in order.  Most are not pushed: they have less than their item's worst, or than ``top`` others here."""
        wanted = (score > self.least[item]) | ((score == self.least[item]) & (score > 0) & known & (ids <= self.last[item]))
        item, score, ids, known = item[wanted], score[wanted], ids[wanted], known[wanted]
        ends = np.flatnonzero(np.concatenate([item[1:] != item[:-1], [True]])) + 1 if len(item) else []
        begin = 0
        for end in ends:
            part = slice(begin, end)
            order = np.lexsort((ids[part], ~known[part], -score[part]))[: self.top] + begin
            begin, heap = end, self.heaps[item[begin]]
            for j in order:
                entry = (int(score[j]), bool(known[j]), -int(ids[j]))
                if len(heap) < self.top:
                    heappush(heap, entry)
                elif entry > heap[0]:
                    heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[item[end - 1]] = heap[0][0]
                self.last[item[end - 1]] = -heap[0][2] if heap[0][1] else np.iinfo(np.int64).max


def _terms_of(items: DataFrame) -> DataFrame:
    """(item, term, n): how often each term stands in an item's texts."""
    id_type = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                counts = Counter(fold_words(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(counts), batch.schema.field(0).type), pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], names=["item", "term", "n"])

    texts = items.select("item_id", items["text"].cast("binary").alias("text"))
    return texts.mapInArrow(run, f"item {id_type}, term binary, n long").groupBy("item", "term").agg(F.sum("n").alias("n"))


def _blocks(terms: DataFrame, block_bytes: int) -> list[DataFrame]:
    """``terms`` by blocks of whole items; sizes are measured, and there are more blocks until none has over twice ``block_bytes`` beside one item's."""
    size = F.sum(F.octet_length("term") + 16)
    total = terms.agg(size.alias("s")).first().s or 0
    if total <= block_bytes:
        return [terms] if total else []
    of = lambda n: F.pmod(F.xxhash64("item"), F.lit(n))
    n, largest = -(-total // block_bytes), terms.groupBy("item").agg(size.alias("s")).agg(F.max("s")).first()[0]
    while terms.groupBy(of(n)).agg(size.alias("s")).agg(F.max("s")).first()[0] > max(2 * block_bytes, largest):
        n *= 2
    return [terms.where(of(n) == b) for b in range(n)]


def _matched(docs: DataFrame, wanted: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and the wanted ones by their places in ``wanted``."""
    token, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _once(token, lambda: {t: k for k, t in enumerate(sent.value)})
        for batch in batches:
            n, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                words = fold_words(text.as_py())
                n.append(len(words))
                for word, tf in Counter(words).items():
                    if (k := place.get(word)) is not None:
                        terms.append(k)
                        tfs.append(tf)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _runs(batches: Iterator[pa.RecordBatch], many: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the triples of their documents become ``RUN`` or the documents ``RUN_DOCS``."""
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy()
        triples = np.concatenate([[0], np.cumsum(many[batch.column(2).flatten().to_numpy()])])[ends - ends[0]]
        start = 0
        while start < batch.num_rows:
            end = min(int(np.searchsorted(triples, triples[start] + RUN, "right")) - 1, start + RUN_DOCS)
            yield batch.slice(start, max(1, end - start))
            start += max(1, end - start)


def _best_of(matched: DataFrame, items: list, item_type: str, weighed: tuple[list[int], list[int], list[int]], n_terms: int, docs: int, words: int, top: int) -> DataFrame:
    """Each task's best documents of each item."""
    token, sent = uuid.uuid4().hex, matched.sparkSession.sparkContext.broadcast((items, weighed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weighed = sent.value
        impacts = _once(token, lambda: Impacts(*weighed, len(items), n_terms))
        best = Best(len(items), top)
        for batch in _runs(batches, impacts.count):
            ids, n, terms, tfs = batch.columns
            many = np.diff(terms.offsets.to_numpy())
            m = 25 + 75 * n.to_numpy() * docs // words
            doc, tf = np.repeat(np.arange(batch.num_rows), many), tfs.flatten().to_numpy()
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
            item, at, score = impacts.scores(doc, terms.flatten().to_numpy(), impact, batch.num_rows)
            known, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            best.add(item, score, values[at], known[at])
        rows = [(items[k], -e[2] if e[1] else None, e[0]) for k, heap in enumerate(best.heaps) for e in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) if k == 0 else pa.array(c, pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=["item_id", "doc_id", "score"])

    return matched.mapInArrow(run, f"item_id {item_type}, doc_id long, score long")


def _selected(rows: DataFrame, top: int) -> DataFrame:
    """The best of all tasks: first of ranges of document ids, so that no item's rows meet in one task, then of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("item_id", F.pmod(F.col("doc_id"), F.lit(64))).orderBy(*order)
    some = rows.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= top).drop("_r")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0.

    Null texts have no terms.  Rows with equal item_ids are one item that has
    the terms of all of them, those without one too; rows with equal doc_ids
    are documents of their own, those without one come last among equal
    scores.  Items or documents without terms, and empty tables, give no rows;
    extra columns are ignored.  The documents are read once for each block of
    items.
    """
    terms = written(_terms_of(items), "search-terms")
    found = [r for b in _blocks(terms, block_bytes) if (r := _block_best(docs, b, top)) is not None]
    if not found:
        item_type = terms.schema["item"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    return _selected(reduce(DataFrame.unionByName, found), top)


def _block_best(docs: DataFrame, terms: DataFrame, top: int) -> DataFrame | None:
    listed = [(r.item, bytes(r.term), r.n) for r in terms.collect()]
    items, wanted = ([*dict.fromkeys(x[k] for x in listed)] for k in (0, 1))
    if not wanted:
        return None
    matched = written(_matched(docs, wanted), "search-matched")
    n, words = matched.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not words:
        return None
    df = {r.t: r["count"] for r in matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    place, number = {t: k for k, t in enumerate(wanted)}, {i: k for k, i in enumerate(items)}
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * np.array([df.get(k, 0) for k in range(len(wanted))], float) + 1))).astype(np.int64)
    weighed = [number[i] for i, _, _ in listed], [place[t] for _, t, _ in listed], [int(weight[place[t]]) * q for _, t, q in listed]
    return _best_of(matched, items, terms.schema["item"].dataType.simpleString(), weighed, len(wanted), n, words, top)
