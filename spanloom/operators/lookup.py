"""Symbol lookups for whole sets of terms.

Names are folded once, in ``name_lc``; equality on it is an equi-join and
reaches the scan.  A prefix lookup is one as well: names are cut to each of the
few lengths that the terms have.  What an interactive search takes "first" is
an ordinal here, so results are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """Symbols whose name is a term (column term), case aside."""
    return symbols.join(terms.withColumn("name_lc", F.lower("term")), "name_lc")


def prefix(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """Symbols whose name starts with a term, case aside; nothing in a term is a wildcard."""
    keyed = terms.withColumn("_p", F.lower("term"))
    sizes = sorted({r[0] for r in keyed.select(F.length("_p")).collect()})  # bounded: the terms asked for
    cut = symbols.withColumn("_size", F.explode(F.filter(F.lit(sizes).cast("array<int>"), lambda n: n <= F.length("name_lc")))).withColumn("_p", F.expr("left(name_lc, _size)"))
    return cut.join(keyed, "_p").drop("_p", "_size")


def of_kind(hits: DataFrame, kind: str) -> DataFrame:
    return hits.where(F.col("kind") == kind)


def in_path(symbols: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """The first ``most`` symbols of each path, by line, then order of extraction."""
    w = Window.partitionBy("path").orderBy("start_line", "ord")
    return symbols.join(paths.select("path"), "path", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def tagged(symbols: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """For each query its first ``most`` symbols: by term, exact ones before prefixes, each symbol once.

    ``terms``: query_id, term_ord, term, and perhaps exact_only for terms that
    are no prefixes.  Adds hit_ord and exact.  A name that is the term begins
    with it, so one lookup finds both.
    """
    begins = prefix(symbols, terms.where("term <> ''")).withColumn("_phase", F.when(F.col("name_lc") == F.lower("term"), 0).otherwise(1))
    if "exact_only" in terms.columns:
        begins = begins.where("_phase = 0 or not exact_only").drop("exact_only")
    once = Window.partitionBy("query_id", "symbol_id").orderBy("term_ord", "_phase")
    by = Window.partitionBy("query_id").orderBy("term_ord", "_phase", "path", "ord")
    found = begins.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("hit_ord", F.row_number().over(by)).where(F.col("hit_ord") <= most)
    return found.withColumn("exact", F.col("_phase") == 0).drop("_n", "_phase", "term", "term_ord")
