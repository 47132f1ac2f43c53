"""Bringing the tables of an index up to date, in proportion to what changed.

Files that changed are extracted and become a segment.  Edges depend on symbols
of other files, so those that a change can reach are resolved again: ``defs``
has every name and path that an edge can mean, ``refs`` every one that a file's
raw edges ask for, both by key.  Keys that gained or lost a symbol lead to the
files that ask for them, and only the edges of these files, and of the changed
ones, are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import fulltext, graph, mutate
from .operators.resolve import definition_keys, reference_keys, resolved
from .plans.context import CAP_NEIGHBORS, subject_grams
from .segments import Segments, Table
from .sources import tree
from .storage import saved, together

#: Tables of files.
FILE_TABLES = {
    "files": Table("path string, language string, hash string, size long, mtime long, parse_status string", "path", "path"),
    "symbols": Table("symbol_id long, path string, ord int, name string, name_lc string, kind string, start_line int, end_line int, start_byte int, end_byte int, signature string", "path", "path"),
    "raw_edges": Table("path string, ord int, src_name string, dst_name string, kind string, confidence string", "path", "path"),
    "edges": Table("path string, src long, dst long, kind string, confidence string, ord int", "path", "path", "edges"),
    "heads": Table("path string, node long, src long, dst long, kind string, confidence string, ord int, more boolean", "path", "node", "edges", sorted_by="node", of=("edges", lambda edges: graph.heads(edges, CAP_NEIGHBORS))),
    "defs": Table("key string, symbol_id long, path string, ord int, name string, name_lc string, kind string", "path", "key"),
    "refs": Table("key string, path string", "path", "key"),
    "lengths": Table("path string, dl int", "path", "path"),
    "postings": Table("path string, term string, places array<bigint>, dl int", "path", "term", sorted_by="term"),
    "terms": Table("term string", "", "term", sorted_by="term"),
}
#: Tables of commits, which only ever come in.
COMMIT_TABLES = {
    "commits": Table("sha string, author string, authored_at string, subject string, body string, files array<string>, ord int", "sha", "sha"),
    "commit_lengths": Table("sha string, dl int", "sha", "sha"),
    "commit_postings": Table("sha string, term string, places array<bigint>, dl int", "sha", "term", sorted_by="term"),
    "commit_terms": Table("term string", "", "term", sorted_by="term"),
    "commit_grams": Table("gram string, sha string", "sha", "gram", sorted_by="gram"),
}
COMMIT_TEXT = ("sha", "subject", "body")


@dataclass(frozen=True)
class Counts:
    """What an index has: files, symbols, edges, and tokens of files; as sums, so that changes can be added."""

    files: int = 0
    symbols: int = 0
    edges: int = 0
    tokens: int = 0
    errors: int = 0

    def __add__(self, other: Counts) -> Counts:
        return Counts(*(a + b for a, b in zip(vars(self).values(), vars(other).values(), strict=True)))


def _symbols(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("path", F.explode("symbols").alias("s")).select(F.xxhash64("path", "s.ord").alias("symbol_id"), "path", "s.*")
    return rows.withColumn("name_lc", F.lower("name"))


def with_files(store: Segments, source: DataFrame, gone: DataFrame, work: str) -> tuple[Segments, Counts]:
    """The state after ``source`` (path, content, language, hash, size, mtime) came in and all else of the paths ``gone`` went, and what that adds to the counts.

    ``gone`` names paths that the index has.  ``work``: a folder for
    intermediate tables.
    """
    parsed = saved(tree.extracted(source), f"{work}/parsed")
    symbols, raw, postings, lengths = together(
        lambda: saved(_symbols(parsed), f"{work}/symbols"),
        lambda: saved(parsed.select("path", F.explode("raw_edges").alias("e")).select("path", "e.*"), f"{work}/raw"),
        lambda: saved(fulltext.index(source), f"{work}/postings"),
        lambda: saved(fulltext.lengths_of(source), f"{work}/lengths"),
    )
    files = source.join(parsed.select("path", "parse_status"), "path")
    what = reached = None
    if store.listed:
        before, n_gone = together(lambda: saved(store.read("symbols", gone), f"{work}/before"), gone.count)
        keys = saved(definition_keys(symbols).unionByName(definition_keys(before)).select("key").distinct(), f"{work}/keys")
        reached = store.read("refs", keys).select("path").distinct().join(gone, "path", "left_anti")
        reached = saved(reached.join(source.select("path"), "path", "left_anti"), f"{work}/reached")
        raw_there = saved(raw.unionByName(store.read("raw_edges", reached)), f"{work}/raw-there")
        asked = saved(reference_keys(raw_there).select("key").distinct(), f"{work}/asked")
        known = store.read("defs", asked).join(gone, "path", "left_anti").unionByName(definition_keys(symbols).join(asked, "key", "left_semi"))
        columns = ["symbol_id", "path", "ord", "name", "name_lc", "kind"]
        there = symbols.select(columns).unionByName(store.read("symbols", reached).select(columns)).unionByName(known.select(columns)).dropDuplicates(["symbol_id"])
        edges = saved(resolved(raw_there, saved(there, f"{work}/there")), f"{work}/edges")
        what = gone.select(F.col("path").alias("key"), F.lit("all").alias("what")).unionByName(reached.select(F.col("path").alias("key"), F.lit("edges").alias("what")))
        n_gone += reached.count()
    else:
        edges, n_gone = saved(resolved(raw, symbols), f"{work}/edges"), 0
    tables = {
        "files": files, "symbols": symbols, "raw_edges": raw, "edges": edges, "defs": definition_keys(symbols), "refs": reference_keys(raw).select("key", "path").distinct(),
        "lengths": lengths, "postings": postings, "terms": postings.select("term"),
    }
    tokens = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    n, errors, n_symbols, n_edges, (_, n_tokens) = together(parsed.count, parsed.where("parse_status = 'error'").count, symbols.count, edges.count, lambda: tokens(lengths))
    change = Counts(n, n_symbols, n_edges, n_tokens, errors)
    if store.listed and n_gone:
        lost, (old, old_tokens), old_symbols = together(store.read("edges", what.select(F.col("key").alias("path"))).count, lambda: tokens(store.read("lengths", gone)), before.count)
        change += Counts(-old, -old_symbols, -lost, -old_tokens)
    return store.with_segment(store.write(tables, what, n, n_gone)), change


#: Seeds up to which the scan of their edges is told which they are.
FEW_SEEDS = 20_000


def touching_heads(store: Segments, seeds: DataFrame, per_seed: int) -> DataFrame:
    """The edges that touch ``seeds`` (query_id, id, seed_ord), of each seed at least its first ``per_seed`` (``CAP_NEIGHBORS`` at most).

    A segment has the first edges of each of its nodes in order of nodes, so a
    hub's others are not read.  Where files that went have taken so many of them
    that they do not suffice, that node's edges are read whole.
    """
    found = store.read("heads", marked=True)
    ids = [r[0] for r in seeds.select("id").distinct().limit(FEW_SEEDS + 1).collect()]
    if len(ids) <= FEW_SEEDS:
        found = found.where(F.col("node").isin(ids))
    columns = ["src", "dst", "kind", "confidence", "ord"]
    mine = found.select("node", *columns, "more", "_segment", "_alive").join(seeds.withColumnRenamed("id", "node"), "node")
    alive = mine.where("_alive").drop("more", "_segment", "_alive").withColumnRenamed("node", "id")
    if not any(s.gone for s in store.listed):
        return alive
    short = found.groupBy("node", "_segment").agg(F.max("more").alias("more"), F.count_if("_alive").alias("n")).where(F.col("more") & (F.col("n") < per_seed)).select(F.col("node").alias("id")).distinct()
    few = [r[0] for r in short.join(seeds.select("id").distinct(), "id", "left_semi").limit(FEW_SEEDS + 1).collect()]
    if not few:
        return alive
    short = F.col("id").isin(few)
    if len(few) > FEW_SEEDS:  # so many that all edges are met
        short = F.lit(True)
    whole = graph.touching(store.read("edges").select(*columns), seeds.where(short).withColumn("_id", F.col("id"))).withColumnRenamed("_id", "id")
    return alive.where(~short).unionByName(whole.select(alive.columns))


def with_commits(store: Segments, got: DataFrame, work: str) -> tuple[Segments, int, int]:
    """The state after the commits of ``got`` came in whose hash it lacks (of equal ones the first), their number and that of their tokens."""
    first = mutate.first_of(got, ["sha"], ["ord"])
    fresh = saved(first.join(store.read("commits", first).select("sha"), "sha", "left_anti").select(*got.columns), f"{work}/commits")
    n = fresh.count()
    if not n:
        return store, 0, 0
    lengths = saved(fulltext.lengths_of(fresh, "sha", COMMIT_TEXT), f"{work}/commit-lengths")
    postings = saved(fulltext.index(fresh, "sha", COMMIT_TEXT), f"{work}/commit-postings")
    segment = store.write({"commits": fresh, "commit_lengths": lengths, "commit_postings": postings, "commit_terms": postings.select("term"), "commit_grams": subject_grams(fresh)}, None, n, 0)
    return store.with_segment(segment), n, lengths.agg(F.sum("dl")).first()[0]


def emptied(store: Segments) -> Segments:
    """A state without segments; those of ``store`` are retired."""
    return replace(store, listed=(), retired=(*store.retired, *(s.name for s in store.listed)))
