"""Whole packages as a table: from a table of questions to one row a question, with its items, edges, counts and JSON.

Nothing of a question comes to the driver but its words and the hints made of
them; quoted texts, edges and the size limit are array expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import pack
from ..operators.fulltext import small
from ..storage import written
from . import context
from .context import Index, Keep, kept

#: Questions that are one plan.  Their words are gathered on the driver, so a table of more is worked off in parts.
QUESTIONS_A_PASS = 10_000
NO_EDGES = "cast(array() as array<struct<`from`:string,`to`:string,kind:string,confidence:string>>)"


def edges_shown(rows: DataFrame, followed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, shown): edges, in order and each once, among the symbols that a question's admitted ``rows`` quote."""
    items = rows.where("admitted and state = 'item' and symbol is not null").select("query_id", F.concat("path", F.lit(":"), "symbol").alias("item")).distinct()
    named = symbols.select("symbol_id", F.concat("path", F.lit(":"), "name").alias("item")).join(items.select("item").distinct(), "item", "left_semi")
    named = small(written(named, "named"))  # what is quoted: few, so edges are met where they lie
    side = lambda i, c: named.select(F.col("symbol_id").alias(i), F.col("item").alias(c))
    among = pack.edges_among(items, followed.join(side("src", "from"), "src").join(side("dst", "to"), "dst"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "from", "to", "kind", "confidence")))
    return among.groupBy("query_id").agg(F.transform(listed, lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to"), e["kind"].alias("kind"), e["confidence"].alias("confidence"))).alias("shown"))


def quoted(rows: DataFrame) -> DataFrame:
    """What packages are made of: of spans that are not quoted only what is counted."""
    item = F.col("admitted") & (F.col("state") == "item")
    return rows.select("query_id", "pos", "path", "state", "cost", "admitted", *(F.when(item, F.col(c)).alias(c) for c in ("start_line", "end_line", "symbol", "kind", "why", "text")))


def assembled(q: DataFrame, rows: DataFrame, shown: DataFrame, considered: DataFrame, git_status: Column | str = "absent") -> DataFrame:
    """One package for each question of ``q`` (query_id, query, budget).

    ``rows``: what ``context.filled`` gives, ``quoted``.  ``shown``: (query_id, shown).
    ``considered``: (query_id, symbols, commits), counts to be summed.  Questions
    that nothing was found for have packages without items.
    """
    item = F.struct(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"), F.col("kind"), F.col("text"), F.col("why"))
    taken = F.array_sort(F.collect_list(F.when(F.col("admitted") & (F.col("state") == "item"), F.struct("pos", "cost", item.alias("item")))))
    found = rows.groupBy("query_id").agg(
        taken.alias("taken"), F.max((~F.col("admitted")).cast("int")).alias("dropped_for_budget"),
        F.count_if(F.col("admitted") & (F.col("state") == "stale")).alias("stale_omitted"),
    )
    files = rows.select("query_id", "path").distinct().groupBy("query_id").agg(F.count("*").alias("files_considered"))
    counts = considered.groupBy("query_id").agg(F.sum("symbols").alias("symbols_considered"), F.sum("commits").alias("commits_considered"))
    whole = q.select("query_id", "query", F.col("budget").alias("budget_tokens")).join(found, "query_id", "left").join(files, "query_id", "left").join(shown, "query_id", "left").join(counts, "query_id", "left")
    none = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("files_considered", "symbols_considered", "commits_considered", "dropped_for_budget", "stale_omitted")}
    taken_type = dict(found.dtypes)["taken"]
    whole = whole.withColumns(none | {"taken": F.coalesce("taken", F.expr(f"cast(array() as {taken_type})")), "shown": F.coalesce("shown", F.expr(NO_EDGES)), "git_status": F.lit(git_status) if isinstance(git_status, str) else git_status})
    return pack.fitted(whole)


def packages(index: Index, q: DataFrame, phrases: DataFrame, git_status: str = "absent", keep: Keep = kept) -> DataFrame:
    """The packages of planned questions, all of them one plan."""
    spans, followed, counts, commits = context.candidate_spans(index, q, phrases, keep)
    found = keep(context.ranked(spans, commits, q, keep))
    rows = keep(quoted(context.filled(found, index, q)))
    zero = F.lit(0).cast("long")
    considered = counts.select("query_id", F.col("symbols_considered").alias("symbols"), zero.alias("commits")).unionByName(commits.groupBy("query_id").agg(F.count("*").alias("commits")).withColumn("symbols", zero))
    return assembled(q, rows, edges_shown(rows, followed, index.symbols), considered, git_status)


def packages_of(index: Index, questions: DataFrame, git_status: str = "absent") -> DataFrame:
    """The packages of a table of questions: query_id (int, each once), query and budget.

    Null queries are empty ones, null budgets the default.  Other columns are left out.
    """
    parts = -(-questions.count() // QUESTIONS_A_PASS)
    keep: Callable[[DataFrame], DataFrame] = context.keeper(context.FEW + 1)
    out = None
    for k in range(max(parts, 1)):
        some = questions if parts <= 1 else questions.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)
        q, phrases = context.planned_table(some)
        part = written(packages(index, q, phrases, git_status, keep), "packages")
        out = part if out is None else out.unionByName(part)
    return out
