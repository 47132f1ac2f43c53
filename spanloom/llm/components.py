"""Connected components by repeated contraction, all of it distributed.

Each round every node takes the neighbour (or itself) that comes first in a
random order drawn for the round, edges are rewritten to what their ends took,
and loops and repeats go.  The graph shrinks by a constant share a round
whatever its shape; rounds are written to the shared folder, so lineage stays
short.  A node that many edges or nodes point to is joined apart, so a star
costs no task more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, of one type); nodes of one component share a root."""
    e = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), F.col(c)).alias("o"), F.col(c).alias("v"))  # noqa: B023, E731
        took = written(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a"))["v"].alias("took")), "took")
        rounds.append(took)
        a, b = took.select(F.col("node").alias("a"), F.col("took").alias("x")), took.select(F.col("node").alias("b"), F.col("took").alias("y"))
        e = written(spread_join(spread_join(e, a, "a", e), b, "b", e).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last round back: what a node took has a root already, or is one
    out = rounds.pop().withColumnRenamed("took", "root")
    while rounds:
        took = rounds.pop()
        named = took.select("took").distinct().join(out.withColumnRenamed("node", "took"), "took", "left").select("took", F.coalesce("root", "took").alias("root"))
        out = written(spread_join(took, named, "took", took).select("node", "root"), "roots")
    return out
