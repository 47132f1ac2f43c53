"""Putting a package together: edges among its items, size limit, JSON, digest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutate import first_of

MAX_JSON_BYTES = 16_384


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def edges_among(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (from, to, kind, confidence, ord; perhaps of a query_id) whose ends are both items (query_id, item) of a query; of equal ones the first."""
    a, b = items.withColumnRenamed("item", "from"), items.withColumnRenamed("item", "to")
    of = ["query_id", "from"] if "query_id" in edges.columns else ["from"]
    return first_of(edges.join(a, of).join(b, ["query_id", "to"]), ["query_id", "from", "to", "kind"], ["ord"])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    each = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        each = one if each is None else each.unionByName(one)
    return each.agg(*(F.sum(F.when(F.col("table") == name, F.col("n"))).alias(name) for name in tables))


def token_cost(text: str) -> int:
    return len(text.split()) + 2


def is_stale(omitted, items):
    """More than half of what was looked at had changed on disk."""
    return 2 * omitted > items + omitted


def as_json(package: dict) -> str:
    """Compact JSON; an absent drawer section is left out, other nulls stay."""
    stats = {k: v for k, v in package["stats"].items() if not (k == "palace" and v is None)}
    return json.dumps(package | {"stats": stats}, ensure_ascii=False, separators=(",", ":"))


def fit_json(package: dict, edges: list[dict], most: int = MAX_JSON_BYTES) -> dict:
    """Drop items from the end until the JSON fits; tokens, edges and staleness follow."""
    while len(as_json(package).encode()) > most:
        package["stats"]["truncated"] = True
        if not package["items"]:
            break
        package["items"].pop()
        package["used_tokens"] = sum(token_cost(i["text"]) for i in package["items"])
        names = {f"{i['path']}:{i['symbol']}" for i in package["items"] if i["symbol"] is not None}
        package["edges"] = [e for e in edges if e["from"] in names and e["to"] in names]
        package["stats"]["stale_index"] = is_stale(package["stats"]["stale_omitted"], len(package["items"]))
    return package


def fitted(packages: DataFrame, most: int = MAX_JSON_BYTES) -> DataFrame:
    """Packages whose JSON has at most ``most`` bytes: items go from the end until it fits; tokens, edges and staleness follow.

    ``packages``: query_id, query, budget_tokens, taken (an array of pos, cost
    and item, in order), shown (edges that it may have), counts and git_status.
    Sizes are sums over items, so that no text is written twice.  A package
    whose question alone is too long is left without items and marked.  Gives
    query_id, the parts of the package, json and shown.
    """
    n, sizes, all_items = F.size("taken"), F.transform("taken", lambda t: F.octet_length(_json(t["item"]))), F.transform("taken", lambda t: t["item"])

    def package(k: Column, cut: Column, quoted: Column) -> list[Column]:
        kept = F.slice("taken", F.lit(1), k)
        names = F.transform(kept, lambda t: F.concat(t["item"]["path"], F.lit(":"), t["item"]["symbol"]))
        edges = F.filter("shown", lambda e: F.coalesce(F.array_contains(names, e["from"]) & F.array_contains(names, e["to"]), F.lit(False)))
        git = F.struct(F.col("git_status").alias("status"), "commits_considered", F.size(F.filter(kept, lambda t: t["item"]["kind"] == "commit")).cast("long").alias("included"))
        stats = ["files_considered", "symbols_considered", "dropped_for_budget", "stale_omitted", is_stale(F.col("stale_omitted"), k).alias("stale_index"), cut.alias("truncated"), git.alias("git")]
        used = F.aggregate(kept, F.lit(0).cast("long"), lambda a, t: a + t["cost"])
        return [F.col("query"), F.col("budget_tokens"), used.alias("used_tokens"), quoted.alias("items"), edges.alias("edges"), F.struct(*stats).alias("stats")]

    items_size = lambda k: F.aggregate(F.slice("_sizes", F.lit(1), k), F.lit(0), lambda a, s: a + s)
    size = lambda k, cut: F.octet_length(_json(F.struct(*package(k, cut, F.slice("_items", 1, 0))))) + items_size(k) + F.greatest(k - 1, F.lit(0))
    fits = F.filter(F.sequence(F.lit(0), n), lambda k: (k < n) & (items_size(k) <= most) & (size(k, F.lit(True)) <= most))
    sized = packages.withColumns({"_sizes": sizes, "_items": all_items}).withColumn("_whole", size(n, F.lit(False)) <= most)
    chosen = sized.withColumn("_k", F.when(F.col("_whole"), n).otherwise(F.coalesce(F.array_max(fits), F.lit(0))))
    out = chosen.select("query_id", *package(F.col("_k"), ~F.col("_whole"), F.slice("_items", F.lit(1), F.col("_k"))), "shown")
    return out.withColumn("json", _json(F.struct("query", "budget_tokens", "used_tokens", "items", "edges", "stats")))


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def digest(package: dict) -> str:
    """The package as text: a heading and a fenced quotation for each item."""
    out = [f"# {package['query']}", f"budget {package['budget_tokens']} used {package['used_tokens']}"]
    for i in package["items"]:
        symbol = f" ({i['symbol']})" if i["symbol"] is not None else ""
        why = f" [{', '.join(i['why'])}]" if i["why"] else ""
        body = i["text"] if i["text"].endswith("\n") else i["text"] + "\n"
        out.append(f"\n## {i['path']}:{i['start_line']}-{i['end_line']}{symbol}{why}\n```\n{body}```")
    return "\n".join(out) + "\n"
