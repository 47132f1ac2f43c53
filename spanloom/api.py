"""The engine as an application uses it: build an index, ask it, look at its state.

An index is a folder of segments (see ``segments``) and a pointer to the current
list of them.  A build adds what changed and then moves the pointer, so readers
never see half of it and need no locks.  What the new state has no use for is
deleted by the build after, so a reader may go on with the state it has opened.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build, segments
from .build import COMMIT_TABLES, FILE_TABLES, Counts
from .functions import text as T
from .operators import fulltext, graph, lookup, mutate
from .operators.fulltext import TextIndex
from .plans import context, packages
from .plans.context import DEFAULT_BUDGET, Index
from .segments import Segments
from .sources import drawers, gitlog, tree
from .storage import saved

FOLDER = ".spanloom"
SCHEMA = 5
SEARCH_LIMIT, STALE_SAMPLE = 20, 20
#: Columns that commits of older layouts lack, with their defaults.
LATER = {"body": "''", "files": "cast(array() as array<string>)"}


class NotInitialized(Exception):
    """No index where one was asked for."""


@dataclass
class IndexStats:
    scanned: int = 0
    indexed: int = 0
    unchanged: int = 0
    deleted: int = 0
    skipped_secret: int = 0
    skipped_large: int = 0
    skipped_ignore: int = 0
    errors: int = 0


def _home(root: str | Path) -> Path:
    return Path(root).resolve() / FOLDER


def init(root: str | Path) -> None:
    """Make an empty index, or leave the one that is there."""
    home = _home(root)
    home.mkdir(exist_ok=True)
    if not (home / "CURRENT").exists():
        _point(home, {"schema_version": SCHEMA, "segments": [], "commit_segments": [], "retired": [], "built": None, "git_status": "absent", "git_head": None, "file_count": 0, "symbol_count": 0, "edge_count": 0, "commit_count": 0})


def find_root(start: str | Path) -> Path:
    """The nearest folder upwards that has an index; else the nearest of a repository; else ``start``."""
    start = Path(start).resolve()
    for mark in (f"{FOLDER}/CURRENT", ".git"):
        for p in (start, *start.parents):
            if (p / mark).exists():
                return p
    return start


def meta(root: str | Path) -> dict:
    try:
        out = json.loads((_home(root) / "CURRENT").read_text())
    except FileNotFoundError:
        raise NotInitialized(str(root)) from None
    if out.get("segments") and out["schema_version"] != SCHEMA:  # files of an older layout are read anew by the next build
        out |= {"retired": [*out.get("retired", []), *(s["name"] for s in out["segments"])], "segments": [], "built": None, "file_count": 0, "symbol_count": 0, "edge_count": 0, "token_count": 0}
    return {"git_status": "absent", "git_head": None, "commit_count": 0} | out  # what a snapshot of the first layout lacks


def _point(home: Path, content: dict) -> None:
    new = home / f"CURRENT.{uuid.uuid4().hex}"
    new.write_text(json.dumps(content, indent=1))
    os.replace(new, home / "CURRENT")


def _files(spark: SparkSession, root: str | Path, known: dict | None = None) -> Segments:
    known = meta(root) if known is None else known
    return segments.listed(spark, _home(root), FILE_TABLES, known.get("segments", []))


def _commits(spark: SparkSession, root: str | Path, known: dict | None = None) -> Segments:
    known = meta(root) if known is None else known
    return segments.listed(spark, _home(root), COMMIT_TABLES, known.get("commit_segments", []))


def _table(spark: SparkSession, root: str | Path, name: str) -> DataFrame | None:
    """A table of files as it is now; None before the first build."""
    store = _files(spark, root)
    return store.read(name) if meta(root).get("built") else None


def _texts(spark: SparkSession, root: str | Path, known: dict | None = None, commits: bool = False) -> TextIndex:
    """What searches read."""
    known = meta(root) if known is None else known
    if commits:
        store, n, total = _commits(spark, root, known), known.get("commit_docs", 0), known.get("commit_tokens", 0)
        return TextIndex(store.read("commit_lengths"), store.read("commit_postings"), "sha", (float(n), total / n if n else 1.0), store.read("commit_terms"))
    store, n, total = _files(spark, root, known), known["file_count"], known.get("token_count", 0)
    return TextIndex(store.read("lengths"), store.read("postings"), "path", (float(n), total / n if n else 1.0), store.read("terms"))


def index_tree(spark: SparkSession, root: str | Path, force: bool = False, below: str | Path | None = None, git=None) -> IndexStats:
    """Bring the index of ``root`` up to date; what is written is in proportion to what changed, and nothing is where nothing did.

    ``below``: only that folder of it; paths get its name as a prefix, other
    files of the index stay, and where the log has been read to is not moved.
    """
    root = Path(root).resolve()
    known = meta(root)
    walk = Path(below).resolve() if below is not None else root
    prefix = "" if walk == root else f"{walk.relative_to(root)}/"
    home = _home(root)
    left_over = _left_over(home, known)
    work = home / f"build-{uuid.uuid4().hex}"
    store = _files(spark, root, known)
    paths, n_paths = tree.list_files(spark, walk, root, str(work))
    # only names, sizes and hashes are kept of files that did not change
    scan = saved(tree.with_skip_kind(tree.read_paths(tree.dealt(paths, n_paths), walk, prefix)).select("path", "hash", "skip_kind"), str(work / "scan"))
    diff = mutate.scoped_diff(store.read("files"), scan.where("skip_kind = 'keep'"), prefix)
    counted = scan.groupBy(F.concat(F.lit("skip "), "skip_kind").alias("k")).count().unionByName(diff.groupBy(F.col("status").alias("k")).count())
    counts = Counter({r.k: r["count"] for r in counted.collect()})
    now = Counts(known["file_count"], known["symbol_count"], known["edge_count"], known.get("token_count", 0))
    whole = not known.get("built") or (force and not prefix)
    if whole:
        store, now = build.emptied(store), Counts()
    if whole or force or counts["added"] + counts["changed"] + counts["deleted"]:
        wanted = "status <> 'deleted'" if whole or force else "status in ('added', 'changed')"
        changed = diff.where(wanted).select(F.substring("path", len(prefix) + 1, 1 << 20).alias("path"))
        gone = saved(diff.where("status <> 'added'" if force else "status in ('changed', 'deleted')").select("path"), str(work / "gone"))
        n_changed = sum(counts[k] for k in ("added", "changed", *(["unchanged"] if whole or force else [])))
        again = tree.with_skip_kind(tree.read_paths(tree.dealt(changed, n_changed), walk, prefix)).where("skip_kind = 'keep'")
        source = saved(again.select("path", "content", "language", "hash", "size", "mtime"), str(work / "source"))
        store, change = build.with_files(store, source, gone, str(work))
        now = now + change
    history = _with_history(spark, root, known, git if git is not None else gitlog.GitLog(walk), prefix, force, work)
    content = {k: v for k, v in known.items() if k != "snapshot"} | history
    retired = [*store.retired, *history.pop("newly_retired"), *([known["snapshot"]] if known.get("snapshot") else [])]
    content = content | history | {
        "schema_version": SCHEMA, "root": str(root), "indexed_at": datetime.now(timezone.utc).isoformat(), "segments": store.as_json(), "retired": retired, "built": uuid.uuid4().hex,
        "file_count": now.files, "symbol_count": now.symbols, "edge_count": now.edges, "token_count": now.tokens,
    }
    content.pop("newly_retired", None)
    if not retired and content["segments"] == known.get("segments") and content["commit_segments"] == known.get("commit_segments") and known.get("built"):
        content["built"] = known["built"]  # what readers have opened is the same
    _point(home, content)
    segments.drop(home, [work.name, *left_over, *known.get("retired", [])])
    return IndexStats(
        n_paths, counts["added"] + counts["changed"] + (counts["unchanged"] if force else 0), 0 if force else counts["unchanged"], counts["deleted"],
        counts["skip secret_name"] + counts["skip secret_content"], counts["skip large"], counts["skip ignore"] + counts["skip binary"], counts["skip unreadable"] + now.errors,
    )


def _left_over(home: Path, known: dict) -> list[str]:
    """Folders of builds that did not come to their end."""
    named = {*known.get("retired", []), *(s["name"] for k in ("segments", "commit_segments") for s in known.get(k, []))}
    return [p.name for p in home.iterdir() if p.name.startswith(("segment-", "build-")) and p.name not in named]


def apply_changes(spark: SparkSession, root: str | Path, changes: DataFrame, stream: tuple[str, int] | None = None) -> bool:
    """Bring the index of ``root`` up to date with ``changes`` (path, content, deleted, at), one row a path, instead of a tree on disk.

    Skip rules hold as for files; an unchanged content changes nothing.
    ``stream``: name and number of a batch; one that has been applied is not
    applied again, and the pointer that says so moves with the tables.
    """
    root = Path(root).resolve()
    known = meta(root)
    if stream is not None and known.get("streams", {}).get(stream[0], -1) >= stream[1]:
        return False
    home, store = _home(root), _files(spark, root, known)
    work = home / f"build-{uuid.uuid4().hex}"
    text = F.coalesce("content", F.lit(""))
    read = changes.select("path", text.alias("content"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.octet_length(text).cast("long").alias("size"), F.coalesce(F.unix_timestamp("at"), F.lit(0)).alias("mtime"), T.content_hash(text).alias("hash"))
    judged = tree.with_skip_kind(read.withColumns({"readable": F.lit(True), "binary": F.contains("content", F.lit("\0"))}))
    last = saved(judged.withColumn("keep", (F.col("skip_kind") == "keep") & ~F.col("deleted")).drop("readable", "binary", "skip_kind", "deleted"), str(work / "last"))
    old = store.read("files", last.select("path")).select("path", F.col("hash").alias("old"))
    both = saved(last.join(old, "path", "left").where(~(F.col("keep") & F.col("hash").eqNullSafe(F.col("old"))) & (F.col("keep") | F.col("old").isNotNull())), str(work / "both"))
    source, gone = both.where("keep").select("path", "content", "language", "hash", "size", "mtime"), both.where("old is not null").select("path")
    content = known | {"streams": known.get("streams", {}) | ({stream[0]: stream[1]} if stream else {}), "indexed_at": datetime.now(timezone.utc).isoformat(), "root": str(root), "built": known.get("built") or uuid.uuid4().hex}
    if not both.isEmpty():
        store, change = build.with_files(store, source, gone, str(work))
        now = Counts(known["file_count"], known["symbol_count"], known["edge_count"], known.get("token_count", 0)) + change
        content |= {"segments": store.as_json(), "retired": list(store.retired), "built": uuid.uuid4().hex, "file_count": now.files, "symbol_count": now.symbols, "edge_count": now.edges, "token_count": now.tokens}
        segments.drop(home, known.get("retired", []))
    _point(home, content)
    segments.drop(home, [work.name])
    return True


def _with_history(spark: SparkSession, root: Path, known: dict, source, prefix: str, force: bool, work: Path) -> dict:
    """The commits' part of the pointer: from where the last build stopped, unless that is no ancestor any more."""
    status, text, head, _ = _history(source, known, prefix, force)
    store, n, total = _commits(spark, root, known), known.get("commit_docs", 0), known.get("commit_tokens", 0)
    if force and not prefix:
        store, n, total = build.emptied(store), 0, 0
    elif known.get("snapshot"):  # an older layout: files are read anew, commits are carried over
        old = mutate.with_missing_columns(spark.read.parquet(str(_home(root) / known["snapshot"] / "commits")), LATER)
        store, n, total = build.with_commits(store, old.select(*spark.createDataFrame([], COMMIT_TABLES["commits"].ddl).columns), str(work / "old"))
    if text:
        got = gitlog.parse_log(gitlog.records(spark, text), at="at").withColumn("body", T.cut(F.col("body"), gitlog.BODY_CHARS))
        got = got.withColumn("ord", (F.col("ord") + n).cast("int")).withColumn("files", F.transform("files", lambda f: F.concat(F.lit(prefix), f)))
        if got.isEmpty():
            status = "unparseable"
        store, more, tokens = build.with_commits(store, got.select(*(c.split()[0] for c in COMMIT_TABLES["commits"].ddl.split(", "))), str(work))
        n, total = n + more, total + tokens
    out = {"commit_segments": store.as_json(), "newly_retired": list(store.retired), "commit_docs": n, "commit_tokens": total}
    return out | ({"commit_count": known["commit_count"], "git_head": known["git_head"], "git_status": known["git_status"]} if prefix else {"commit_count": n, "git_head": head or known["git_head"], "git_status": status})


def _history(source, known: dict, prefix: str, force: bool) -> tuple[str, str, str | None, str | None]:
    """(status, log text, head, since); failures give a status and no text."""
    since = None if force or prefix else known["git_head"]
    try:
        head = source.head()
        if since and not source.is_ancestor(since):
            since = None
        return "ok", "" if since == head else source.log(since), head, since
    except FileNotFoundError:
        return "not_installed", "", None, None
    except Exception as e:  # history never fails an index
        return ("timeout" if type(e).__name__ == "TimeoutExpired" else "absent"), "", None, None


_opened: dict[tuple, Index | None] = {}


def open_index(spark: SparkSession, root: str | Path) -> Index | None:
    """The current state, and a way to read its files as they are on disk now; None before the first build."""
    state = (spark.sparkContext.applicationId, str(_home(root)), meta(root).get("built"))
    if state not in _opened:
        _opened.clear()
        _opened[state] = _open(spark, root)
    return _opened[state]


def _open(spark: SparkSession, root: str | Path) -> Index | None:
    known = meta(root)
    if not known.get("built"):
        return None
    store = _files(spark, root, known)

    def live(paths: DataFrame) -> DataFrame:
        spread = paths.repartition(spark.sparkContext.defaultParallelism)
        return tree.read_paths(spread, Path(root).resolve()).where("readable and strict").select("path", "hash", "content")

    log = _commits(spark, root, known)
    commits = log.read("commits").select("sha", "subject", "body", "files", "ord")
    of = lambda hashes: log.read("commits", hashes).select("sha", "subject", "ord")
    return Index(store.read("files"), live, store.read("symbols"), store.read("edges").drop("path"), _texts(spark, root, known), commits, _texts(spark, root, known, True), log.read("commit_grams"), of, lambda seeds, n: build.touching_heads(store, seeds, n))


def _no_index(spark: SparkSession) -> Index:
    empty = lambda ddl: fulltext.local(spark, ddl, [])
    text = lambda key: TextIndex(empty(f"{key} string, dl int"), empty(f"{key} string, term string, places array<bigint>, dl int"), key, (0.0, 1.0))
    live = lambda paths: empty("path string, hash string, content string")
    symbols = empty("symbol_id long, path string, ord int, name string, name_lc string, kind string, start_line int, end_line int")
    return Index(empty("path string, hash string"), live, symbols, empty("src long, dst long, kind string, confidence string, ord int"), text("path"), empty("sha string, subject string, body string, files array<string>, ord int"), text("sha"))


def compile_packages(spark: SparkSession, index: Index, questions: list[tuple[str, int]], git_status: str = "absent") -> list[tuple[dict, list[dict]]]:
    """A (package, edges it may show) for each (question, budget), all of them in one plan."""
    keyed = [(k, text, budget) for k, (text, budget) in enumerate(questions)]
    q, phrases = context.planned(spark, keyed)
    rows = {r.query_id: r.asDict(True) for r in packages.packages(index, q, phrases, git_status, context.keeper(len(keyed))).drop("json").collect()}  # bounded: a package has at most pack.MAX_JSON_BYTES
    out = []
    for k, _, _ in keyed:
        r = rows[k]
        stats = r["stats"]
        package = {n: r[n] for n in ("query", "budget_tokens", "used_tokens", "items", "edges")}
        out.append((package | {"stats": {n: v for n, v in stats.items() if n != "git"} | {"palace": None, "git": stats["git"]}}, r["shown"]))
    return out


def context_table(spark: SparkSession, root: str | Path, questions: DataFrame) -> DataFrame:
    """Packages of a table of questions (query_id int, query, budget) about the tree at ``root``, one row a question, with their JSON."""
    known = meta(root)
    index = open_index(spark, root) or _no_index(spark)
    return packages.packages_of(index, questions, "ok" if known["commit_count"] > 0 else "absent").drop("shown")


def get_contexts(spark: SparkSession, root: str | Path, questions: list[str], budget: int = DEFAULT_BUDGET, drawer_search=None, include_drawers: bool | None = None) -> list[dict]:
    """Packages of verbatim spans for questions about the tree at ``root``."""
    known = meta(root)
    index = open_index(spark, root)
    if index is None:
        index = _no_index(spark)
    status = "ok" if known["commit_count"] > 0 else "absent"
    try:
        settings = drawers.parse_settings((_home(root) / "config.toml").read_text())
    except OSError:
        settings = drawers.Settings()
    search = drawer_search or drawers.command_search(os.environ.get("SPANLOOM_PALACE_BIN", "mempalace"), str(root))
    out = []
    for text, (package, edges) in zip(questions, compile_packages(spark, index, [(t, budget) for t in questions], status), strict=True):
        out.append(drawers.attach(package, edges, text, search, settings, include_drawers))
    return out


def get_context(spark: SparkSession, root: str | Path, question: str, budget: int = DEFAULT_BUDGET, **options) -> dict:
    return get_contexts(spark, root, [question], budget, **options)[0]


def search_symbols(spark: SparkSession, root: str | Path, name: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Symbols named so, then those whose name begins so."""
    symbols = _table(spark, root, "symbols")
    if symbols is None:
        return spark.createDataFrame([], "path string, start_line int, end_line int, kind string, name string, signature string, hit_ord int")
    found = lookup.tagged(symbols, spark.createDataFrame([(0, 0, name)], "query_id int, term_ord int, term string"), limit)
    return found.select("path", "start_line", "end_line", "kind", "name", "signature", "hit_ord").orderBy("hit_ord")


def references(spark: SparkSession, root: str | Path, path: str) -> DataFrame:
    """Who uses a file: edges into its symbols from other files."""
    edges, symbols = _table(spark, root, "edges"), _table(spark, root, "symbols")
    if edges is None:
        return spark.createDataFrame([], "src_path string, src_name string, dst_name string, kind string, confidence string")
    found = graph.incoming(edges.drop("path"), symbols, F.col("dst_path") == path)
    return found.select("src_path", "src_name", "dst_name", "kind", "confidence").orderBy("src_path", "src_name", "dst_name", "kind")


def search_code(spark: SparkSession, root: str | Path, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Files by text: the expression, or else the phrase, and then the parts of hyphenated words."""
    from .plans.query_plan import fallback, ladder

    if not meta(root).get("built") or not query.strip():
        return spark.createDataFrame([], "path string, rank int")
    keyed = context.phrase_table(spark, [(0, order, e) for order, es in enumerate((ladder(query), fallback(query))) for e in es]).withColumn("query_id", F.col("search_ord"))
    hits = fulltext.search_expressions(_texts(spark, root), keyed, limit)
    parts = [hits.where(F.col("query_id") == k).withColumn("query_id", F.lit(0)) for k in (0, 1)]
    return fulltext.ordered_union(parts, limit).select("path", "rank").orderBy("rank")


def status(root: str | Path) -> dict:
    return {k: v for k, v in meta(root).items() if k not in ("snapshot", "segments", "commit_segments", "retired", "built", "streams", "token_count", "commit_docs", "commit_tokens")}


def doctor(spark: SparkSession, root: str | Path) -> dict:
    """Counts, and how many of the first indexed files have changed on disk."""
    index = open_index(spark, root)
    if index is None:
        return status(root) | {"sampled": 0, "stale": 0}
    some = index.files.orderBy("path").limit(STALE_SAMPLE)
    s = some.join(index.live(some.select("path")).select("path", F.col("hash").alias("now")), "path", "left").agg(F.count("*").alias("n"), F.count_if(~F.col("hash").eqNullSafe(F.col("now"))).alias("stale")).first()
    return status(root) | {"sampled": s.n, "stale": s.stale}


def as_dict(stats: IndexStats) -> dict:
    return asdict(stats)
