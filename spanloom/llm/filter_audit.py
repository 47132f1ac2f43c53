"""Filter interaction audit by incidence matrix products.

Every document is one of 32 sets of failed filters, so what any order of the
five filters does to a corpus follows from three histograms over these sets:
all documents, those of good quality, and toxic ones.  The histograms of all
parts are stacked as rows and multiplied by integer 32 x 600 matrices, one
column for each step of each of the 120 orders: kept, removed, redundant and
unique failures.

Texts are read once.  What is shuffled afterwards are short rows: the digests
of texts (for the filter of identical ones) and the ids that labels name.
Both joins bring in signed counts: a document found to repeat an earlier one
moves from its set to the one with that filter, and nothing is joined outer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import spread_join, written

FILTERS = "ABCDE"
REPEATS = 1 << FILTERS.index("E")
MIN_WORDS = 100
MIN_DISTINCT = 80
MAX_UPPER = 10
MARKUP = b"#$%&*|"

_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(0x80, 0xC0))


def failed(text: bytes) -> int:
    """The set of filters A to D that a UTF-8 text fails, as bits."""
    words = text.split()  # at ASCII white space, which is 20 and 09-0D
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _FOLLOWING))
    markup = len(text) != len(text.translate(None, MARKUP))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1 | (100 * upper > MAX_UPPER * points) << 2 | markup << 3


@cache
def steps() -> list[tuple[str, int]]:
    """(order, step from 1) of each of the 600 columns."""
    return [("".join(p), s) for p in permutations(FILTERS) for s in range(1, len(FILTERS) + 1)]


@cache
def outcomes() -> dict[str, np.ndarray]:
    """Integer matrices, sets of failed filters by columns of ``steps``."""
    sets = np.arange(1 << len(FILTERS))[:, None]
    own = np.array([1 << FILTERS.index(order[s - 1]) for order, s in steps()])
    earlier = np.array([sum(1 << FILTERS.index(f) for f in order[: s - 1]) for order, s in steps()])
    fails, gone = (sets & own) != 0, (sets & earlier) != 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": np.broadcast_to(sets == own, fails.shape)}
    return {k: v.astype(np.int64) for k, v in found.items()}


@cache
def _shares() -> np.ndarray:
    """Sets by columns: how many of all orders remove the set's documents by the column's filter."""
    letters = np.array([order[s - 1] for order, s in steps()])
    by_filter = {f: outcomes()["removed"][:, letters == f].sum(1) for f in FILTERS}
    return np.stack([by_filter[f] for f in letters], 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [v.as_py() or b"" for v in batch.column(2)]
        masks = pa.array(map(failed, texts), pa.int32())
        digests = pa.array((hashlib.blake2b(t, digest_size=16).hexdigest() for t in texts), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, digests], names=["doc_id", "part", "mask", "digest"])


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), docs["text"].cast("binary").alias("text"))
    rows = written(read.mapInArrow(_features, f"doc_id {id_type}, part string, mask int, digest string"), "audit-rows")
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = spread_join(rows, firsts, "digest", rows.select("digest")).where("doc_id > first").select("doc_id", "part", "mask")
    moved = later.select("doc_id", "part", F.explode(F.array(F.struct("mask", F.lit(-1).alias("sign")), F.struct((F.col("mask") + REPEATS).alias("mask"), F.lit(1).alias("sign")))).alias("m"))
    signed = rows.select("doc_id", "part", "mask", F.lit(1).alias("sign")).unionByName(moved.select("doc_id", "part", "m.*"))
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 or toxic = 1")
    lost = spread_join(signed, marked, "doc_id", rows.select("doc_id"))
    whole = signed.groupBy("part", "mask").agg(F.sum("sign").alias("n"))
    some = lost.groupBy("part", "mask").agg(F.sum(F.col("sign") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("sign") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    both = whole.unionByName(some, allowMissingColumns=True).groupBy("part", "mask")
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")))


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m, orders = outcomes(), [o for o, _ in steps()]
    numbers = np.array([s for _, s in steps()], np.int32)
    for batch in batches:
        for part, cells in zip(*batch.columns, strict=True):
            hist = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for c in cells.as_py():
                hist[:, c["mask"]] = c["n"], c["good"], c["toxic"]
            removed = hist @ m["removed"]
            columns = [hist[0] @ m["kept"], removed[0], hist[0] @ m["redundant"], hist[0] @ m["unique_fails"], removed[1], removed[2], hist[0] @ _shares()]
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(orders)), pa.array(orders), pa.array(numbers), *map(pa.array, columns)], names=[f.split()[0] for f in RESULT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (``lang``; null: empty), order of the five filters and step: what becomes of the part's documents.

    Null texts are empty.  Rows with equal doc_ids are documents of their own;
    a document repeats another only if that has a smaller doc_id, so rows
    without one never do, nor are they what others repeat.  A document is good
    or toxic if any of its labels says so; labels without a doc_id, and null
    labels, say nothing.  Empty tables give no rows; extra columns are ignored.
    """
    stacked = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return stacked.mapInArrow(_products, RESULT)
