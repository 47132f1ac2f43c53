"""Compiling questions into budgeted packages of source spans: one plan for any number of questions.

Every step is keyed by query_id, and every "first" of an interactive search is
an ordinal, so a thousand questions are the same plan as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import fulltext, graph, lookup, rank
from ..operators.fulltext import TextIndex, local
from ..storage import written
from .query_plan import COMMIT_SEARCH, Phrase, QueryPlan, commit_search, plan_query, searches

# How many of each a question may gather.
CAP_SYMBOLS, CAP_FTS, CAP_NEIGHBORS, CAP_COMMITS, CAP_DECISIONS, CAP_SUPERSEDES = 50, 30, 40, 20, 10, 10
SNIPPET_LINES = 40
DEFAULT_BUDGET = 3000


#: Questions up to which intermediate results go through the driver; more leave them in the shared folder.
FEW = 64


@dataclass
class Index:
    """files(path, hash), symbols, edges(src, dst, kind, confidence, ord), commits(sha, subject, body, files, ord), and texts and commit_texts to search.

    ``live`` gives (path, hash, content), as they are now, of a table of paths.
    """

    files: DataFrame
    live: Callable[[DataFrame], DataFrame]
    symbols: DataFrame
    edges: DataFrame
    texts: TextIndex
    commits: DataFrame
    commit_texts: TextIndex
    #: (gram, sha) of the commits' subjects, and what gives the commits of a table of hashes; without them subjects are searched one by one.
    grams: DataFrame | None = None
    commits_of: Callable[[DataFrame], DataFrame] | None = None
    #: Gives, for seeds (query_id, id, seed_ord) and a number, the edges that touch them, of each seed at least so many of the first; without it all edges are met.
    touching: Callable[[DataFrame, int], DataFrame] | None = None

    def nearest(self, seeds: DataFrame, per_seed: int) -> DataFrame:
        touched = graph.touching(self.edges, seeds) if self.touching is None else self.touching(seeds, per_seed)
        return graph.nearest(touched, per_seed).select("query_id", "seed_ord", "src", "dst", "kind", "confidence", "ord")


Keep = Callable[[DataFrame], DataFrame]


def kept(df: DataFrame) -> DataFrame:
    """A small intermediate result as data of its own, through the driver."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def keeper(questions: int) -> Keep:
    """How intermediate results are held: later steps use them many times, and without a cut their plans would be copies of everything before.

    The caps bound the rows for each question, so those of a ``FEW`` fit the
    driver; those of more questions are written to the shared folder.
    """
    return kept if questions <= FEW else lambda df: written(df, "context")


PLANNED = "query_id int, query string, budget int, symbol_terms array<string>, path_hints array<string>, words array<string>, terms array<string>"
PHRASE = "search_ord int, phrase_ord int, text string, prefix boolean, group int, negated boolean, atom int, distance int, columns array<int>, first boolean"


def _phrase_rows(plan: QueryPlan) -> list[tuple]:
    return [_phrase(order, e) for order, es in (*commit_search(plan), *searches(plan)) for e in es]


def _phrase(order: int, e: Phrase) -> tuple:
    return order, e.leaf, e.text, e.prefix, e.group, e.negated, e.atom, e.distance, None if e.columns is None else [*e.columns], e.first


def planned(spark: SparkSession, questions: list[tuple[int, str, int]]) -> tuple[DataFrame, DataFrame]:
    """(questions, phrases) as tables: questions with their terms, phrases of each text search."""
    plans = [(q, text, budget, plan_query(text)) for q, text, budget in questions]
    q = local(spark, PLANNED, [(i, t, b, p.symbol_terms, p.path_hints, p.words, p.terms) for i, t, b, p in plans])
    return q, _with_tokens(local(spark, f"query_id int, {PHRASE}", [(i, *row) for i, _, _, p in plans for row in _phrase_rows(p)]))


def planned_table(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``planned`` of a table (query_id int, query, budget); questions are planned where they lie."""
    names = [f.split()[0] for f in PHRASE.split(", ")]
    ddl = f"{PLANNED}, phrases array<struct<{', '.join(f.replace(' ', ':', 1) for f in PHRASE.split(', '))}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, budget in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = plan_query(text)
                rows.append({"query_id": i, "query": text, "budget": budget, "symbol_terms": p.symbol_terms, "path_hints": p.path_hints, "words": p.words, "terms": p.terms, "phrases": [dict(zip(names, r, strict=True)) for r in _phrase_rows(p)]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    asked = questions.select(F.col("query_id").cast("int"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce(F.col("budget").cast("int"), F.lit(DEFAULT_BUDGET)).alias("budget"))
    plans = written(asked.mapInArrow(run, schema), "plans")
    return plans.drop("phrases"), _with_tokens(plans.select("query_id", F.inline("phrases")))


def phrase_table(spark: SparkSession, rows: list[tuple[int, int, Phrase]]) -> DataFrame:
    """Phrases (query_id, search_ord, phrase) of text searches with their tokens."""
    return _with_tokens(local(spark, f"query_id int, {PHRASE}", [(q, *_phrase(order, e)) for q, order, e in rows]))


def _with_tokens(phrases: DataFrame) -> DataFrame:
    return phrases.withColumn("toks", T.tokens(F.col("text"))).drop("text")


def text_hits(index: Index, phrases: DataFrame) -> DataFrame:
    """(query_id, path, rank): hits of a question's searches one after the other, each file once."""
    keyed = phrases.where(F.col("search_ord") != COMMIT_SEARCH).withColumn("query_id", F.struct("query_id", "search_ord"))
    hits = fulltext.search_expressions(index.texts, keyed, CAP_FTS)
    flat = hits.select("query_id.query_id", "query_id.search_ord", "path", "rank")
    return fulltext.first_seen(flat.withColumnRenamed("rank", "_rank"), ["search_ord", "_rank"], CAP_FTS)


#: Length of the pieces that subjects are indexed by.
GRAM = 3


def subject_grams(commits: DataFrame) -> DataFrame:
    """(gram, sha): the distinct pieces of ``GRAM`` characters of each subject, lower case."""
    folded = F.lower("subject")
    pieces = F.transform(F.sequence(F.lit(1), F.length(folded) - GRAM + 1), lambda i: F.substring(folded, i, GRAM))
    return commits.where(F.length(folded) >= GRAM).select(F.explode(F.array_distinct(pieces)).alias("gram"), "sha")


def subject_hits(commits: DataFrame, q: DataFrame, grams: DataFrame | None = None, commits_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, sha, ord) of commits whose subject has a symbol term of the question, case aside; each once."""
    return _subject_matches(commits, q, grams, commits_of).distinct()


def _subject_matches(commits: DataFrame, q: DataFrame, grams: DataFrame | None = None, commits_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``subject_hits``, of which one may be there several times.

    With ``grams`` a term's commits are those that have all its pieces, and
    only these are read and held against it.  Terms too short for that, or all
    where there are no grams, go to every task, and every commit is held
    against them where it lies; only what matches is shuffled.
    """
    asked = [(r[0], t) for r in q.select("query_id", F.transform("symbol_terms", F.lower)).collect() for t in r[1] if t]  # bounded: the questions
    out = commits.select(F.lit(0).alias("query_id"), "sha", "ord").limit(0)
    if grams is not None and (long := [(i, t) for i, t in asked if len(t) >= GRAM]):
        asked = [(i, t) for i, t in asked if len(t) < GRAM]
        cut = {t: sorted({t[k : k + GRAM] for k in range(len(t) - GRAM + 1)}) for _, t in long}
        wanted = local(commits.sparkSession, "term string, gram string, need int", [(t, g, len(gs)) for t, gs in cut.items() for g in gs])
        some = grams.where(F.col("gram").isin(sorted({g for gs in cut.values() for g in gs}))).join(F.broadcast(wanted), "gram").groupBy("term", "sha").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select("term", "sha")
        named = local(commits.sparkSession, "query_id int, term string", long)
        read = commits if commits_of is None else commits_of(some.select("sha"))
        out = some.join(read.select("sha", "subject", "ord"), "sha").where(F.contains(F.lower("subject"), F.col("term"))).join(F.broadcast(named), "term").select("query_id", "sha", "ord")
    if asked:
        named = local(commits.sparkSession, "query_id int, term string", asked)
        folded = commits.select("sha", "ord", F.lower("subject").alias("_folded"))
        out = out.unionByName(folded.join(F.broadcast(named), F.contains("_folded", F.col("term"))).select("query_id", "sha", "ord"))
    return out


def commit_hits(index: Index, q: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, sha, norm, rank): subject matches, then text matches; the former keep the latter's norm, or have 1."""
    keyed = phrases.where(F.col("search_ord") == COMMIT_SEARCH)
    fts = fulltext.search_expressions(index.commit_texts, keyed, CAP_COMMITS).select("query_id", "sha", F.col("rank").alias("fts_rank"))
    # equal matches have one rank, so a task leaves out what is beyond the cap before they are told apart
    matched = _subject_matches(index.commits, q, index.grams, index.commits_of)
    w = Window.partitionBy("query_id").orderBy("ord", "sha")
    subject = matched.withColumn("subject_rank", F.dense_rank().over(w)).where(F.col("subject_rank") <= CAP_COMMITS).distinct().drop("ord")
    both = subject.join(fts, ["query_id", "sha"], "full_outer")
    by = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("subject_rank"), "fts_rank")
    norm = F.coalesce(1.0 / F.col("fts_rank"), F.lit(1.0))
    return both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= CAP_COMMITS).select("query_id", "sha", norm.alias("norm"), "rank")


def _span(ord_: F.Column, why: F.Column, **more) -> list:
    """Columns of a span of a symbol row."""
    columns = {
        "ord": ord_, "path": F.col("path"), "start_line": F.col("start_line"), "end_line": F.greatest("start_line", "end_line"), "symbol": F.col("name"), "kind": F.col("kind"), "why": F.array_compact(why),
        "fts_norm": F.lit(0.0), "neighbor_high": F.lit(False), "neighbor_low": F.lit(False), "prequoted": F.lit(None).cast("string"),
    }
    return [F.col("query_id"), *(c.alias(n) for n, c in (columns | more).items())]


def _outline_why() -> list:
    return [F.when(F.col("kind") == k, k) for k in ("heading", "selector")]


def _symbol_why(exact: F.Column, *more) -> F.Column:
    return F.array(F.when(exact, "exact_symbol").otherwise("prefix_symbol"), *_outline_why(), F.when(F.col("kind") == "decision", "decision"), *more)


def _at(stage: int, *ords) -> F.Column:
    """An ordinal that keeps the order of the stages."""
    out = F.lit(stage).cast("long")
    for o in ords:
        out = out * 1_000_000 + o
    return out


def _names(name: F.Column, terms: F.Column) -> F.Column:
    return F.exists(terms, lambda t: F.contains(F.lower(name), F.lower(t)))


def candidate_spans(index: Index, q: DataFrame, phrases: DataFrame, keep: Keep = kept) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(spans, edges, symbol counts, commits): all that a question gathers before it is fused and scored.

    Texts and commits are searched while symbols are looked up.
    """
    pool = ThreadPoolExecutor(2)
    searched = pool.submit(lambda: keep(text_hits(index, phrases)))
    logged = pool.submit(lambda: keep(commit_hits(index, q, phrases).join(index.commits, "sha")))
    pool.shutdown(wait=False)
    terms = q.select("query_id", F.posexplode("symbol_terms").alias("term_ord", "term"))
    accepted = keep(lookup.tagged(index.symbols, terms, CAP_SYMBOLS))
    seeds = accepted.select("query_id", F.col("symbol_id").alias("id"), F.col("hit_ord").alias("seed_ord"))
    first = keep(index.nearest(seeds, CAP_NEIGHBORS))
    near = keep(graph.chosen(first, seeds, CAP_NEIGHBORS))
    hits = searched.result()

    spans = accepted.select(*_span(_at(1, F.lit(0), F.col("hit_ord")), _symbol_why(F.col("exact"))))
    edge = near.select("query_id", F.col("other").alias("symbol_id"), F.col("kind").alias("edge_kind"), "confidence", "rank")
    reached = edge.join(index.symbols, "symbol_id")
    sure = {"neighbor_high": F.col("confidence") == "high", "neighbor_low": F.col("confidence") == "low"}
    spans = spans.unionByName(reached.select(*_span(_at(2, F.lit(0), F.col("rank")), F.array(F.concat("edge_kind", F.lit("_neighbor")), *_outline_why()), **sure)))

    # symbols of files that text search found: those that the question names, else a heading, else the first lines
    asked = hits.join(q.select("query_id", "symbol_terms", "terms"), "query_id").withColumn("fts_norm", 1.0 / F.col("rank"))
    within = lookup.in_path(index.symbols, hits.select("path").distinct(), CAP_SYMBOLS)
    inside = keep(asked.join(within, "path"))
    named = inside.where(~F.col("kind").isin("heading", "selector") & _names(F.col("name"), F.col("terms")))
    exact = F.exists("symbol_terms", lambda t: F.lower(t) == F.col("name_lc"))
    fts = {"fts_norm": F.col("fts_norm")}
    spans = spans.unionByName(named.select(*_span(_at(3, F.col("rank"), F.col("ord")), _symbol_why(exact, F.lit("fts")), **fts)))
    bare = keep(asked.join(named.select("query_id", "path").distinct(), ["query_id", "path"], "left_anti"))
    known = bare.join(accepted.select("query_id", "path", "symbol_id", "name", "kind", "start_line", "end_line", "hit_ord"), ["query_id", "path"]).where((F.col("kind") == "heading") & _names(F.col("name"), F.col("terms"))).withColumn("_o", _at(0, F.lit(0), F.col("hit_ord")))
    listed = bare.join(index.symbols.where("kind = 'heading'"), "path").withColumn("_t", F.array_position(F.transform("terms", lambda t: F.lower(t)), F.col("name_lc"))).where("_t > 0").withColumn("_o", _at(1, F.col("_t"), F.col("ord")))
    columns = ["query_id", "path", "rank", "fts_norm", "name", "kind", "start_line", "end_line", "_o"]
    head = known.select(columns).unionByName(listed.select(columns))
    head = keep(head.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "path").orderBy("_o"))).where("_n = 1"))
    spans = spans.unionByName(head.select(*_span(_at(3, F.col("rank"), F.lit(0)), F.array(F.lit("heading"), F.lit("fts")), **fts)))
    rest = bare.join(head.select("query_id", "path"), ["query_id", "path"], "left_anti").withColumns({"name": F.lit(None).cast("string"), "kind": F.lit(None).cast("string"), "start_line": F.lit(1), "end_line": F.lit(SNIPPET_LINES)})
    spans = spans.unionByName(rest.select(*_span(_at(3, F.col("rank"), F.lit(0)), F.array(F.lit("fts")), **fts)))

    spans = keep(spans)
    # decisions: by symbol terms, then by names of headings that are among the spans or match in files found
    decisions = index.symbols.where("kind = 'decision'")
    heads = spans.where("kind = 'heading'").select("query_id", F.col("symbol").alias("term"), F.col("ord").alias("_o"))
    more = inside.where((F.col("kind") == "heading") & _names(F.col("name"), F.col("terms"))).select("query_id", F.col("name").alias("term"), _at(9, F.col("rank"), F.col("ord")).alias("_o"))
    extra = heads.unionByName(more).groupBy("query_id", "term").agg(F.min("_o").alias("_o"))
    extra = extra.withColumn("term_ord", (F.row_number().over(Window.partitionBy("query_id").orderBy("_o")) + 1000).cast("int"))
    wanted = terms.withColumn("exact_only", F.lit(False)).unionByName(extra.select("query_id", "term_ord", "term", F.lit(True).alias("exact_only")))
    decided = keep(lookup.tagged(decisions, wanted, CAP_DECISIONS))
    spans = spans.unionByName(decided.select(*_span(_at(4, F.lit(0), F.col("hit_ord")), _symbol_why(F.col("exact"), F.lit("decision")))))
    by = decided.select("query_id", F.col("symbol_id").alias("id"), F.col("hit_ord").alias("seed_ord"))
    before = keep(index.nearest(by, CAP_SUPERSEDES))
    older = graph.chosen(before, by, CAP_SUPERSEDES, "supersedes")
    replaced = older.select("query_id", F.col("other").alias("symbol_id"), "confidence", "rank").join(index.symbols, "symbol_id")
    spans = spans.unionByName(replaced.select(*_span(_at(5, F.lit(0), F.col("rank")), F.array(F.lit("decision"), F.lit("supersedes_neighbor")), **sure)))

    commits = logged.result()
    as_span = commits.withColumns({"path": F.concat(F.lit("git://"), "sha"), "start_line": F.lit(1), "end_line": F.lit(1), "name": F.left("sha", F.lit(7)), "kind": F.lit("commit")})
    spans = spans.unionByName(as_span.select(*_span(_at(6, F.lit(0), F.col("rank")), F.array(F.lit("commit"), F.lit("commit_fts")), fts_norm=F.col("norm"), prequoted=T.commit_text(F.col("subject"), F.col("body")))))

    followed = first.select("query_id", "src", "dst", "kind", "confidence", _at(1, F.col("seed_ord"), F.col("ord")).alias("ord"))
    followed = followed.unionByName(before.where("kind = 'supersedes'").select("query_id", "src", "dst", "kind", "confidence", _at(2, F.col("seed_ord"), F.col("ord")).alias("ord")))
    counts = accepted.select("query_id").unionByName(near.select("query_id")).groupBy("query_id").agg(F.count("*").alias("symbols_considered"))
    return spans, followed, counts, commits.select("query_id", "sha", "files")


def commits_on_path(commits: DataFrame, code: DataFrame, q: DataFrame) -> DataFrame:
    """(query_id, sha) of the commits (query_id, sha, files) that touch a file of ``code`` (query_id, file) or one that a path hint of the question names."""
    files = commits.select("query_id", "sha", F.explode("files").alias("file")).join(q.select("query_id", "path_hints"), "query_id").join(code.withColumn("_code", F.lit(True)), ["query_id", "file"], "left")
    hint = F.exists("path_hints", lambda h: F.contains("file", h))
    return files.where(hint | F.col("_code")).select("query_id", "sha").distinct()


def ranked(spans: DataFrame, commits: DataFrame, q: DataFrame, keep: Keep = kept) -> DataFrame:
    """Spans fused, tagged, merged and scored; with the first-pass mark."""
    fused = keep(rank.fuse(spans))
    code = fused.where("path not like 'git://%'").select("query_id", F.col("path").alias("file")).distinct()
    on_path = commits_on_path(commits, code, q).select("query_id", F.concat(F.lit("git://"), "sha").alias("path"), F.lit("commit_path").alias("_tag"))
    top = fused.where(F.array_contains("why", "exact_symbol")).select("query_id", "path", F.lit(True).alias("_top")).distinct()
    fused = fused.join(on_path, ["query_id", "path"], "left").withColumn("why", F.array_compact(F.array_append("why", F.col("_tag")))).drop("_tag")

    def scored(df: DataFrame) -> DataFrame:
        with_q = df.join(q.select("query_id", "terms", "path_hints"), "query_id").join(top, ["query_id", "path"], "left")
        hinted = F.exists("path_hints", lambda h: F.contains("path", h))
        base = F.exists("terms", lambda t: T.stem_matches(F.col("path"), t))
        tags = F.array_sort(F.array_distinct(F.concat("why", F.array_compact(F.array(F.when(base, "path_basename"), F.when(hinted, "path_hint"))))))
        out = with_q.withColumn("why", tags).withColumn("_hinted", hinted)
        return out.withColumn("score", rank.score(F.col("why"), F.col("fts_norm"), F.col("neighbor_high"), F.col("neighbor_low"), F.col("_hinted"), F.coalesce("_top", F.lit(False)))).drop("terms", "path_hints", "_top", "_hinted")

    return rank.first_pass(scored(rank.merge_overlaps(rank.drop_covered_snippets(scored(fused)))))


def filled(found: DataFrame, index: Index, q: DataFrame) -> DataFrame:
    """Spans in order of admission with text, cost, state (item, empty or stale), running cost and whether they are in.

    Of the files only those that the spans are in are read again.

    Costs grow along the order, so comparing the running sum with the budget is
    the same as stopping at the first span that does not fit.
    """
    order = [F.col("overflow").asc(), F.desc("score"), F.asc("path"), F.asc("start_line")]
    found, parts = rank.dealt(found, order)
    at_git = F.coalesce(F.startswith("path", F.lit("git://")), F.lit(False))
    spans, commits = found.where(~at_git), found.where(at_git)
    live = index.live(spans.select("path").distinct()).select("path", F.col("hash").alias("live_hash"), "content")
    stored = index.files.select("path", F.col("hash").alias("stored_hash"))
    rows = spans.join(stored, "path", "left").join(live, "path", "left")
    fresh = F.coalesce(F.col("stored_hash") == F.col("live_hash"), F.lit(False)) & F.col("content").isNotNull()
    text = F.when(fresh, T.line_slice(F.col("content"), F.col("start_line"), F.col("end_line")))
    rows = rows.withColumn("text", text).drop("content", "live_hash", "stored_hash", "prequoted")
    rows = rows.unionByName(commits.withColumn("text", F.coalesce("prequoted", F.lit(""))).drop("prequoted")).join(q.select("query_id", "budget"), "query_id")
    rows = rows.withColumn("state", F.when(F.col("text").isNull(), "stale").when(F.col("text") == "", "empty").otherwise("item"))
    rows = rows.withColumn("cost", F.when(F.col("state") == "item", T.token_cost(F.col("text"))).otherwise(0))
    first = F.sum(F.when(F.col("overflow"), 0).otherwise(F.col("cost")))
    out = rank.within_budget(rows, order, parts)
    # what overflows is last in the order, so without it the sums of the others are the same
    if parts == 1:
        out = out.withColumn("_first", first.over(Window.partitionBy("query_id")))
    else:
        out = out.join(F.broadcast(out.groupBy("query_id").agg(first.alias("_first"))), "query_id")
    out = out.where("not overflow or _first <> budget").drop("_first")
    last = F.least(F.col("end_line"), F.greatest("start_line", F.lit(1)) + F.size(T.lines(F.col("text"))) - 1)
    return out.withColumn("end_line", F.when((F.col("state") == "item") & ~at_git, last).otherwise(F.col("end_line")))
