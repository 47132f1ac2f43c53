"""What shows only on large or odd tables: ties, long files, hubs, frequent words."""

import ast
import re
from dataclasses import asdict

from pyspark.sql import functions as F

from spanloom.bridge import Tables
from spanloom.functions.text import tokens
from spanloom.operators import fulltext, rank
from spanloom.plans import context
from spanloom.source_queries import _python
from spanloom.sources import tree
from spanloom.sources.extract import extract, python


def test_fuse_ties(spark):
    """Spans of one ord: their place says which names the symbol; without places the names do, whatever the order of rows."""
    ddl = "query_id int, ord long, path string, start_line int, end_line int, symbol string, kind string, why array<string>, fts_norm double, neighbor_high boolean, neighbor_low boolean, prequoted string"
    row = lambda path, symbol: (1, 7, path, 1, 2, symbol, "k", ["fts"], 1.0, False, False, None)
    rows = [(*row("a", "x"), 1), (*row("a", "y"), 0), (*row("b", "x"), 0), (*row("b", "y"), 1)]
    spans = spark.createDataFrame(rows, f"{ddl}, at int").coalesce(1)
    assert {r.path: r.symbol for r in rank.fuse(spans).collect()} == {"a": "y", "b": "x"}
    assert {r.path: r.symbol for r in rank.fuse(spans.drop("at")).collect()} == {"a": "x", "b": "x"}


def _asked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, phrase_ord int, toks array<string>, prefix boolean")


def test_search_is_dealt_by_document(spark):
    """Hits of many queries are no rows that are shuffled by query and document, and documents of one key are one."""
    files = spark.createDataFrame([(k % 9, f"the w{k % 4} w{k % 7}, the end") for k in range(40)], "id long, text string")
    wanted = _asked(spark, [(q, k, [w], False) for q in range(30) for k, w in enumerate(["the", f"w{q % 7}", "nothing"])])
    ix = fulltext.scanned(files, wanted, "id", ("text",))
    assert ix.lengths.count() == 9
    assert {(r.id, r.n) for r in ix.postings.where("term = 'the'").selectExpr("id", "size(places) n").collect()} == {(k, 10 if k < 4 else 8) for k in range(9)}
    found = fulltext.search(ix, wanted, True, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, (?:phrase_ord|id)", plan)
    assert {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()} == dict.fromkeys(range(30), 5)


def test_long_python_is_read_by_pieces(monkeypatch):
    """A class of many members is never one tree, and pieces give what the whole gives; where they can't be told apart the whole is read."""
    member = "    def f{0}(self, x='é'):\n        return g{0}(x)\n    @d\n    async def h{0}(self): pass\n"
    long = "import a\nclass B(base()):\n" + "".join(member.format(k) for k in range(300)) + "def last(): return B()\n"
    odd = "class B:\n" + "".join(f"    s{k} = '''\n    def no(): pass\n'''\n    def f{k}(self): g()\n" for k in range(300))
    whole = [python.extract(x) for x in (long, odd)]
    parse, sizes = ast.parse, []
    monkeypatch.setattr(python, "PIECE", 1000)
    monkeypatch.setattr(ast, "parse", lambda x: sizes.append(len(x)) or parse(x))
    assert python.extract(long) == whole[0] and max(sizes) < 2500
    assert python.extract(odd) == whole[1]


def test_long_files_are_dealt(spark):
    """Files made of rows lie in many tasks, and extraction gives a batch for each file."""
    files = _python(Tables(spark, "/root/testdata/sf0.001"))
    held = files.rdd.glom().map(len).collect()
    assert sum(held) == 25 and len(held) == 4 * spark.sparkContext.defaultParallelism and max(held) <= 6
    for r in tree.extracted(files).collect():
        x = extract(r.path, next(f.content for f in files.where(files.path == r.path).collect())) if r.path == "src/b1.py" else None
        if x:
            assert [s.asDict() for s in r.symbols] == [{"ord": k} | asdict(s) for k, s in enumerate(x.symbols)]
            assert [e.asDict() for e in r.raw_edges] == [{"ord": k} | asdict(e) for k, e in enumerate(x.edges)]


def test_distinct_edges_are_dealt_once(spark):
    """Edges are dealt by src for what makes them distinct, and not again for a join on src."""
    from spanloom.queries import _distinct_edges

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = _distinct_edges(t).join(t.part.selectExpr("p_partkey src").hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(src#\d+L?, dst", plan) and plan.count("Exchange hashpartitioning") == 2


def test_commit_hits_are_dealt_by_document(spark):
    """Words that several questions ask for are shuffled once a commit, and subject matches not before they are cut to the cap."""
    commits = spark.createDataFrame([(k, f"c{k:04d}", f"urgent change of {k}", "status F" if k % 3 else "") for k in range(300)], "ord long, sha string, subject string, body string")
    q, phrases = context.planned(spark, [(0, "urgent change", 0), (1, "status change", 0), (2, "URGENT status nosuchword", 0)])
    ix = fulltext.scanned(commits, phrases, "sha", ("sha", "subject", "body"))
    found = context.commit_hits(context.Index(None, None, None, None, None, commits, ix), q, phrases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit \[query_id[^\n]*dense_rank\(ord", plan)
    assert {r.query_id for r in fulltext.search_expressions(ix, phrases, 5).collect()} == {0, 1}
    hits = {n: [r.sha for r in found.where(found.query_id == n).orderBy("rank").collect()] for n in range(3)}
    short, said = [f"c{k:04d}" for k in range(0, 60, 3)], [f"c{k:04d}" for k in range(300) if k % 3][:20]
    assert hits == {0: short, 1: said, 2: [f"c{k:04d}" for k in range(20)]}


def test_many_phrases(spark):
    """More phrases than one number has bits for: a document must have all, and none of a negated one."""
    words = [f"w{k:03d}" for k in range(fulltext.BITS * 2 + 3)]
    files = spark.createDataFrame([("all", " ".join(words)), ("less", " ".join(words[:-1])), ("more", " ".join([*words, "bad"]))], "path string, content string")
    row = lambda w, negated: (0, w, [w], False, 0, negated, w, None)
    wanted = spark.createDataFrame([*(row(w, False) for w in words), row("bad", True)], "query_id int, phrase_ord string, toks array<string>, prefix boolean, group int, negated boolean, atom string, distance int").withColumns({"columns": F.lit(None).cast("array<int>"), "first": F.lit(False)})
    ix = fulltext.scanned(files, wanted)
    assert [r.path for r in fulltext.search_expressions(ix, wanted, 5).collect()] == ["all"]
    assert {r.path for r in fulltext.search_expressions(ix, wanted.where("phrase_ord <> 'bad'"), 5).collect()} == {"all", "more"}


def test_tokens_of_plain_texts(spark):
    """Texts without accents take the shorter way to the same tokens."""
    texts = ["Plain A1_b", "É plain", "e\u0301a Ʋ", "", "İx", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(tokens(F.col("x"))).collect()]
    assert got == [["plain", "a1", "b"], ["e", "plain"], ["ea", "ʋ"], [], ["ix"], None]


def test_budget_by_ranges(spark, monkeypatch):
    """Items of one query in many ranges have the places and sums that one task gives them, and no task holds them all."""
    items = spark.range(3000).selectExpr("cast(id % 2 as int) as query_id", "id * 7919 % 3001 as k", "id % 5 = 0 as low", "cast(id % 7 as int) as cost", "2000 as budget")
    order = [F.asc("low"), F.desc("k")]
    whole = rank.within_budget(items, order)
    assert rank.dealt(items, order)[1] == 1
    monkeypatch.setattr(rank, "ITEMS_A_TASK", 100)
    ranges, parts = rank.dealt(items, order)
    assert parts == 30 and ranges.groupBy("query_id", "_range").count().agg(F.max("count")).first()[0] < 300
    dealt = rank.within_budget(ranges, order, parts)
    assert set(dealt.dtypes) == set(whole.dtypes)
    columns = ["query_id", "pos", "k", "used", "admitted"]
    assert sorted(dealt.select(columns).collect()) == sorted(whole.select(columns).collect())


def test_packages_by_ranges(spark, monkeypatch):
    """Packages from spans that are dealt are those that one task for each question makes."""
    from spanloom.queries import QUERIES

    small = {name: sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) for name in ("package_assembly", "filled_budget")}
    monkeypatch.setattr(rank, "ITEMS_A_TASK", 50)
    for name, rows in small.items():
        assert sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == rows
