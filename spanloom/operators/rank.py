"""Fusing, merging, scoring and cutting candidate spans, keyed by query.

A span has: query_id, ord (order of arrival), path, start_line, end_line,
symbol, kind, why (array), fts_norm, neighbor_high, neighbor_low, prequoted.
Spans of one ord may have a place ``at`` too, which says which of them is first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

# What each reason for a span adds to its score.
WEIGHTS = {"exact_symbol": 5.0, "prefix_symbol": 3.0, "path_basename": 3.0, "commit_path": 1.0}
FTS_WEIGHT, OUTLINE_WEIGHT, HIGH_WEIGHT, LOW_WEIGHT, HINT_WEIGHT, SAME_FILE_WEIGHT = 2.0, 2.0, 1.5, 0.5, 1.0, 1.0
PER_PATH = 2
#: Items that one task puts in order.
ITEMS_A_TASK = 100_000


def _together(order: Column) -> list[Column]:
    """Aggregates that fuse spans; what comes first in ``order`` names the symbol (with its kind) and the quoted text."""
    named = F.min_by(F.struct("symbol", "kind"), F.when(F.col("symbol").isNotNull(), order))
    return [
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("why")))).alias("why"),
        named["symbol"].alias("symbol"),
        named["kind"].alias("kind"),
        F.max("fts_norm").alias("fts_norm"),
        F.bool_or("neighbor_high").alias("neighbor_high"),
        F.bool_or("neighbor_low").alias("neighbor_low"),
        F.min_by("prequoted", F.when(F.col("prequoted").isNotNull(), order)).alias("prequoted"),
    ]


def fuse(spans: DataFrame) -> DataFrame:
    """One span for each query, path and line range; where neither ``ord`` nor ``at`` decides, the symbol's name and kind do."""
    order = F.struct("ord", *(["at"] if "at" in spans.columns else []), "symbol", "kind", "prequoted")
    return spans.groupBy("query_id", "path", "start_line", "end_line").agg(F.min("ord").alias("ord"), *_together(order))


def score(why: Column, fts_norm: Column, high: Column, low: Column, hinted: Column, same_file: Column) -> Column:
    has = lambda w: F.array_contains(why, w)
    total = F.lit(0.0)
    for reason, weight in WEIGHTS.items():
        total = total + F.when(has(reason), weight).otherwise(0.0)
    total = total + F.when(has("fts"), fts_norm * FTS_WEIGHT).otherwise(0.0) + F.when(has("commit_fts"), fts_norm * FTS_WEIGHT).otherwise(0.0)
    total = total + F.when(has("heading") | has("selector"), OUTLINE_WEIGHT).otherwise(0.0)
    total = total + F.when(high, HIGH_WEIGHT).when(low, LOW_WEIGHT).otherwise(0.0)
    return total + F.when(hinted, HINT_WEIGHT).otherwise(0.0) + F.when(same_file, SAME_FILE_WEIGHT).otherwise(0.0)


def drop_covered_snippets(spans: DataFrame) -> DataFrame:
    """Without spans that only full-text search gave and that hold a symbol's span of their file.

    A snippet is judged by windows over its file: the least end among symbols
    that start at or after it.
    """
    w = Window.partitionBy("query_id", "path").orderBy("start_line").rangeBetween(0, Window.unboundedFollowing)
    end = F.min(F.when(F.col("symbol").isNotNull(), F.col("end_line"))).over(w)
    covered = F.col("symbol").isNull() & F.array_contains("why", "fts") & (end <= F.col("end_line"))
    return spans.withColumn("_covered", F.coalesce(covered, F.lit(False))).where("not _covered").drop("_covered")


def merge_overlaps(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a path as one: a span opens an island where it starts beyond all ends before it."""
    order = Window.partitionBy("query_id", "path").orderBy("start_line", "end_line", F.desc("score"), "ord")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", (reach.isNull() | (F.col("start_line") > reach)).cast("int"))
    placed = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.row_number().over(order))
    merged = placed.groupBy("query_id", "path", "_island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("ord").alias("ord"), *_together(F.col("_at")))
    return merged.drop("_island")


def first_pass(spans: DataFrame, per_path: int = PER_PATH) -> DataFrame:
    """Adds ``overflow``: false for the best ``per_path`` spans of each path."""
    w = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "start_line", "end_line")
    return spans.withColumn("overflow", F.row_number().over(w) > per_path)


def dealt(items: DataFrame, order: list[Column | str]) -> tuple[DataFrame, int]:
    """``items`` with the ``_range`` of the order that each is in, and how many there are; as they are, unless some query has more than a task should hold."""
    largest, n = items.groupBy("query_id").count().agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) <= ITEMS_A_TASK:
        return items, 1
    parts = max(items.sparkSession.sparkContext.defaultParallelism, -(-n // ITEMS_A_TASK))
    # written, for a second drawing of the ranges' borders might give others
    return written(items.repartitionByRange(parts, "query_id", *order).withColumn("_range", F.spark_partition_id()), "ranges"), parts


def within_budget(items: DataFrame, order: list[Column | str], parts: int = 1) -> DataFrame:
    """Adds ``pos``, ``used``, the cost so far, and ``admitted``: items up to the first that would go over ``budget``.

    Costs are not negative, so the running sum passes the budget once and for
    all; comparing it is the same as stopping there.

    Items that are ``dealt`` by ranges of the order are summed range by range,
    and what the ranges before one come to is added, so no task holds all items
    of a query.
    """
    of = ["query_id"] if parts == 1 else ["query_id", "_range"]
    w = Window.partitionBy(*of).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = (items if parts == 1 else items.repartition(parts, *of)).withColumns({"used": F.sum("cost").over(w), "pos": F.row_number().over(w)})
    if parts > 1:
        summed = written(summed, "sums")
        before = Window.partitionBy("query_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        totals = summed.groupBy(*of).agg(F.max("used").alias("_cost"), F.max("pos").alias("_n"))
        totals = totals.sparkSession.createDataFrame(totals.toArrow(), totals.schema)  # bounded: a row for each range and each query
        offsets = totals.select(*of, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_cost", "_n")))
        summed = summed.join(F.broadcast(offsets), of).withColumns({"used": F.col("used") + F.col("_cost"), "pos": (F.col("pos") + F.col("_n")).cast("int")}).drop("_range", "_cost", "_n")
    return summed.withColumn("admitted", F.col("used") <= F.col("budget"))
