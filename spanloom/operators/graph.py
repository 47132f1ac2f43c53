"""One-hop expansion of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A Spark plan for "src = x or dst = x" would compare all pairs; both ends are therefore joined apart.


def touching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) with an end among ``seeds`` (query_id, id, seed_ord); an edge comes once for each seed."""
    out = edges.join(seeds.withColumnRenamed("id", "src"), "src")
    into = edges.join(seeds.withColumnRenamed("id", "dst"), "dst").where("src <> dst")
    return out.unionByName(into)


def by_node(edges: DataFrame) -> DataFrame:
    """Edges beside each of their ends (column node); one from a node to itself once."""
    return edges.withColumn("node", F.explode(F.array_distinct(F.array("src", "dst"))))


def heads(edges: DataFrame, most: int) -> DataFrame:
    """The first ``most`` edges of each node, in order, and whether it has ``more``; a hub's others go before they are shuffled."""
    w = Window.partitionBy("node")
    first = by_node(edges).withColumn("_n", F.row_number().over(w.orderBy("ord", "src", "dst", "kind"))).where(F.col("_n") <= most + 1)
    return first.withColumn("more", F.max("_n").over(w) > most).where(F.col("_n") <= most).drop("_n")


def nearest(touched: DataFrame, per_seed: int) -> DataFrame:
    """The first ``per_seed`` of the edges that touch a seed (query_id, seed_ord, src, dst, kind, confidence, ord)."""
    w = Window.partitionBy("query_id", "seed_ord").orderBy("ord", "src", "dst", "kind")
    return touched.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_seed).drop("_n")


def neighbors(edges: DataFrame, seeds: DataFrame, per_seed: int, most: int, kind: str | None = None) -> DataFrame:
    """``chosen`` of each seed's first ``per_seed`` edges.  ``edges``: src, dst, kind, confidence, ord."""
    return chosen(nearest(touching(edges, seeds), per_seed), seeds, most, kind)


def chosen(near: DataFrame, seeds: DataFrame, most: int, kind: str | None = None) -> DataFrame:
    """Each query's neighbours: (query_id, other, and the edge that led there), surer edges first, each once, at most ``most``.

    Edges between two seeds lead nowhere new.  ``kind``: only edges of this.
    """
    if kind is not None:
        near = near.where(F.col("kind") == kind)
    known = seeds.select("query_id", F.col("id"))
    src, dst = known.withColumnsRenamed({"id": "src"}).withColumn("_s", F.lit(True)), known.withColumnsRenamed({"id": "dst"}).withColumn("_d", F.lit(True))
    sided = near.join(src, ["query_id", "src"], "left").join(dst, ["query_id", "dst"], "left")
    new = sided.where("(_s is null) <> (_d is null)").withColumn("other", F.when(F.col("_s").isNull(), F.col("src")).otherwise(F.col("dst"))).drop("_s", "_d")
    order = [F.when(F.col("confidence") == "high", 0).otherwise(1), "seed_ord", "ord", "src", "dst", "kind"]
    once = Window.partitionBy("query_id", "other").orderBy(*order)
    rank = Window.partitionBy("query_id").orderBy(*order)
    return new.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most).drop("_n")


def incoming(edges: DataFrame, symbols: DataFrame, path: Column) -> DataFrame:
    """Edges into symbols of ``path`` (a condition on dst_path) from other files."""
    side = lambda s: symbols.select(F.col("symbol_id").alias(s), F.col("name").alias(f"{s}_name"), F.col("path").alias(f"{s}_path"))
    return edges.join(side("dst").where(path), "dst").join(side("src"), "src").where("src_path <> dst_path")
