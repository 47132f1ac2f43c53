"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item with fewer words is one window).  A window is a set of word shingles; a
document that contains it contains all of them, so the prefix that must be
joined is one shingle, and the cheapest is the one that is rarest over all
documents.  Shingles are therefore ordered by their counts in the whole corpus
(one pass), each window is indexed under its rarest shingle, and documents
look up their own shingles there (a second pass).  The shingle's offset gives
the only place where the window can lie; places outside the document are ruled
out by position and length, and the words there are compared as a whole.

The index covers one block of the benchmark at a time.  Blocks are made of
parts of items and measured, which bounds what is broadcast.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import where_text, written

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 2 << 20

#: Letters A-Z in lower case, other ASCII except digits and a-z as spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, letters a-z (A-Z folded) and non-ASCII characters."""
    return (text or b"").translate(_FOLD).split()


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for s in range(max(1, len(words) - window + 1)):
            yield tuple(words[s : s + window])


def shingles_of(window: tuple[bytes, ...], size: int) -> Iterator[tuple[int, tuple[bytes, ...]]]:
    size = min(size, len(window))
    for o in range(len(window) - size + 1):
        yield o, window[o : o + size]


class ShingleScan:
    """Finds the places of a set of shingles in a list of words."""

    def __init__(self, shingles):
        self.by_size: dict[int, tuple[set[bytes], object]] = {}
        for s in shingles:
            self.by_size.setdefault(len(s), (set(), set()))[1].add(s)
        for first, whole in self.by_size.values():
            first.update(s[0] for s in whole)

    def places(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        for size, (first, whole) in self.by_size.items():
            for p in [i for i, w in enumerate(words) if w in first]:
                if (s := tuple(words[p : p + size])) in whole:
                    yield p, s


class PrefixIndex:
    """Windows of one benchmark block under their rarest shingles."""

    def __init__(self, items: list[tuple[str, bytes]], counts: dict[tuple[bytes, ...], int], window: int, size: int):
        self.items: dict[tuple[bytes, ...], set[str]] = {}
        self.prefix: dict[tuple[bytes, ...], set[tuple[int, int]]] = {}
        for item, text in items:
            for w in windows_of(fold_words(text), window):
                seen = w in self.items
                self.items.setdefault(w, set()).add(item)
                if not seen:
                    n, _, o, s = min((counts.get(s, 0), s, o, s) for o, s in shingles_of(w, size))
                    if n:  # else some shingle is in no document, nor then the window
                        self.prefix.setdefault(s, set()).add((o, len(w)))
        self.scan = ShingleScan(self.prefix)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word spans covered by windows, and the items they belong to."""
        found, items, n = set(), set(), len(words)
        for p, s in self.scan.places(words):
            for o, length in self.prefix[s]:
                start = p - o
                if start < 0 or start + length > n:
                    continue
                if hit := self.items.get(tuple(words[start : start + length])):
                    found.add((start, start + length))
                    items |= hit
        spans: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        return spans, items


_built: dict[str, object] = {}


def _once(key: str, build):
    """One built index per worker."""
    if key not in _built:
        _built.clear()
        _built[key] = build()
    return _built[key]


def _count_shingles(rows: DataFrame, items: list[tuple[str, bytes]], window: int, size: int) -> dict[tuple[bytes, ...], int]:
    """How often each of the block's shingles occurs in all documents."""
    spark = rows.sparkSession
    token, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    def build():
        return ShingleScan({s for _, t in sent.value for w in windows_of(fold_words(t), window) for _, s in shingles_of(w, size)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, seen = _once(token, build), Counter()
        for batch in batches:
            for value in batch.column(1):
                seen.update(s for _, s in scan.places(fold_words(value.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s) for s in seen], pa.binary()), pa.array(seen.values(), pa.int64())], names=["s", "n"])

    counted = rows.mapInArrow(run, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r.s).split()): r.n for r in counted.toLocalIterator()}


def _block_hits(rows: DataFrame, items: list[tuple[str, bytes]], window: int, size: int) -> DataFrame:
    spark = rows.sparkSession
    counts = _count_shingles(rows, items, window, size)
    token, sent = uuid.uuid4().hex, spark.sparkContext.broadcast((items, counts))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _once(token, lambda: PrefixIndex(*sent.value, window, size))
        for batch in batches:
            n, spans, items = [], [], []
            for value in batch.column(1):
                words = fold_words(value.as_py())
                hit, of = index.find(words)
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in hit])
                items.append(sorted(of))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "spans", "item_ids"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>")


def _merge_blocks(blocks: list[DataFrame]) -> DataFrame:
    """One row per document again: span lists and items of all blocks put together."""
    both = blocks[0]
    for b in blocks[1:]:
        both = both.unionByName(b)
    merged = (
        both.groupBy("doc_id", "_digest")
        .agg(F.count("*").alias("_n"), F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
        .withColumn(
            "spans",
            F.expr("""aggregate(array_sort(spans), cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
                if(size(a) > 0 and x.start <= a[size(a) - 1].end,
                   concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end)))),
                   concat(a, array(x))))"""),
        )
    )
    copies = F.explode(F.sequence(F.lit(1), (F.col("_n") / len(blocks)).cast("int")))
    return merged.select("doc_id", "n_words", "spans", "item_ids", copies.alias("_copy")).drop("_copy")


def cut_item(words: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """Parts of an item that hold each of its windows; a part has at most ``most`` bytes, or is one window."""
    start, end, size = 0, 0, 0
    while end < len(words):
        size += len(words[end]) + 1
        end += 1
        if end - start > window and size > most:
            end -= 1
            yield words[start:end]
            start = end - window + 1
            size = sum(len(w) + 1 for w in words[start:end])
    if words:
        yield words[start:]


def _parts(items: DataFrame, window: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*batch.columns, strict=True):
                for part in cut_item(fold_words(text.as_py()), window, most):
                    yield pa.RecordBatch.from_pydict({"item": [item.as_py()], "words": [b" ".join(part)]})

    return items.mapInArrow(run, "item string, words binary")


def _blocks_of(benchmark: DataFrame, window: int, block_bytes: int):
    """(number of blocks, function that fetches block b's items from the cluster).

    Beyond one block, items are cut into parts, and the blocks' sizes are
    measured: there are more of them until none has over twice ``block_bytes``
    (or the bytes of one window, if that is more).
    """
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), benchmark["text"].cast("binary").alias("words")).where("item is not null and words is not null")
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if size <= block_bytes:
        return 1, lambda b: [(r.item, bytes(r.words)) for r in items.collect()]
    parts = written(_parts(items, window, max(1, block_bytes // 8)).distinct(), "benchmark-parts")
    n, largest = -(-size // block_bytes), parts.agg(F.max(F.octet_length("words"))).first()[0] or 0
    of = lambda n: F.pmod(F.xxhash64("item", "words"), F.lit(n))
    while (parts.groupBy(of(n)).agg(F.sum(F.octet_length("words")).alias("s")).agg(F.max("s")).first()[0] or 0) > max(2 * block_bytes, largest):
        n *= 2
    return n, lambda b: [(r.item, bytes(r.words)) for r in parts.where(of(n) == b).collect()]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, covered word ``spans`` and ``item_ids`` found.

    Null texts have no words; items without words or without an id match
    nothing; repeated items count once by id; repeated documents are separate
    rows; an empty benchmark hits nothing; extra columns are ignored.
    """
    n_blocks, take = _blocks_of(benchmark, window, block_bytes)
    if n_blocks == 1:
        return _block_hits(docs.select("doc_id", docs["text"].cast("binary").alias("_text")), take(0), window, shingle)
    return _merge_blocks([_keyed_hits(docs, take(b), window, shingle) for b in range(n_blocks)])


def _keyed_hits(docs: DataFrame, items: list[tuple[str, bytes]], window: int, shingle: int) -> DataFrame:
    """``_block_hits`` with the text's digest, so that rows can be met again."""
    key = F.struct("doc_id", _digest(docs["text"]).alias("d")).alias("doc_id")
    hits = _block_hits(docs.select(key, docs["text"].cast("binary").alias("_text")), items, window, shingle)
    return hits.select("doc_id.doc_id", F.col("doc_id.d").alias("_digest"), "n_words", "spans", "item_ids")


def _digest(text):
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents in which any benchmark window occurs; same columns.

    A benchmark of one block filters in one pass over the documents; one of
    more blocks unites what its blocks hit and drops those rows in a join.
    """
    n_blocks, take = _blocks_of(benchmark, window, block_bytes)
    if n_blocks > 1:
        found = [_keyed_hits(docs, take(b), window, shingle).where("size(spans) > 0").select(F.col("doc_id").alias("_i"), "_digest") for b in range(n_blocks)]
        hits = reduce(DataFrame.unionByName, found).distinct()
        return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_i"]) & (_digest(docs["text"]) == hits["_digest"]), "left_anti")
    items = take(0)
    counts = _count_shingles(docs.select("doc_id", docs["text"].cast("binary").alias("_text")), items, window, shingle)
    token, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((items, counts))

    def accept():
        index = _once(token, lambda: PrefixIndex(*sent.value, window, shingle))
        return lambda text: not index.find(fold_words(text.encode()))[0]

    return where_text(docs, accept)
