"""Packages as a table: the same as those of single questions, and a size limit that is the loop's."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom import api
from spanloom.operators import pack
from spanloom.plans import packages
from tests.engine.test_engine import FakeGit, built

TREE = {
    "lib/ledger.py": "class Ledger:\n    def post_entry(self):\n        return open_book()\n\ndef open_book():\n    return 1\n",
    "lib/audit.py": "from ledger import open_book\n\ndef audit_all():\n    return open_book()\n",
    "docs/book.md": "# Ledger\n\n## Posting\nentries are posted once\n",
}
ITEM = "pos int, cost int, item struct<path:string,start_line:int,end_line:int,symbol:string,kind:string,text:string,why:array<string>>"


def test_table_of_questions(spark, tmp_path, monkeypatch):
    built(spark, tmp_path, TREE, FakeGit([("d" * 40, "Posting of entries", "once", ["lib/ledger.py"])]))
    asked = ["open_book", "posting of entries?", "Ledger audit_all", "", None]
    monkeypatch.setattr(packages, "QUESTIONS_A_PASS", 2)  # several passes
    table = spark.createDataFrame([(k, "clash", t, b) for k, (t, b) in enumerate(zip(asked, [3000, None, 12, 3000, 3000], strict=True))], "query_id int, path string, query string, budget int")
    got = {r.query_id: r for r in api.context_table(spark, tmp_path, table).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    single = api.get_contexts(spark, tmp_path, [t or "" for t in asked])
    single[2] = api.get_context(spark, tmp_path, asked[2], 12)
    for k, one in enumerate(single):
        assert got[k].json == pack.as_json(one) and len(got[k].json.encode()) <= pack.MAX_JSON_BYTES
    assert got[0]["edges"] and got[0]["items"][0]["symbol"] == "open_book" and got[3]["items"] == [] and got[1].stats["git"]["included"] == 1
    assert got[2].stats["dropped_for_budget"] == 1 and got[2].used_tokens <= 12
    none = api.context_table(spark, tmp_path, table.limit(0))
    assert none.count() == 0 and "json" in none.columns


@pytest.mark.parametrize("texts, most", [
    (["word " * 300] * 30, pack.MAX_JSON_BYTES), (["é\"\\\n \x01😀" * 40] * 9, 2000), ([], 10), (["a"], 10), (["a b"] * 6, 900), (["x" * 700, "y", "z"], 700),
])
def test_size_limit(spark, texts, most):
    """As many items as the loop over packages leaves."""
    items = [{"path": f"p{k}", "start_line": 1, "end_line": 2, "symbol": None if k % 3 == 2 else f"s{k}", "kind": "commit" if k % 4 == 3 else None, "text": t, "why": ["fts"]} for k, t in enumerate(texts)]
    edges = [{"from": f"p{a}:s{a}", "to": f"p{b}:s{b}", "kind": "call", "confidence": "high"} for a, b in ((0, 1), (1, 0), (0, 4), (3, 3)) if max(a, b) < len(items)]
    stats = {"files_considered": 3, "symbols_considered": 4, "dropped_for_budget": 0, "stale_omitted": 4}
    ddl = f"query_id int, query string, budget_tokens int, git_status string, commits_considered long, {', '.join(f'{c} long' for c in stats)}, taken array<struct<{ITEM.replace('pos int', 'pos:int').replace('cost int', 'cost:int').replace('item struct', 'item:struct')}>>, shown array<struct<`from`:string,`to`:string,kind:string,confidence:string>>"
    row = (1, "q é", 99, "ok", 2, *stats.values(), [(k, pack.token_cost(i["text"]), tuple(i.values())) for k, i in enumerate(items)], [tuple(e.values()) for e in edges])
    got = pack.fitted(spark.createDataFrame([row], ddl), most).first()
    want = {"query": "q é", "budget_tokens": 99, "used_tokens": sum(pack.token_cost(i["text"]) for i in items), "items": list(items), "edges": list(edges), "stats": stats | {"stale_index": pack.is_stale(4, len(items)), "truncated": False, "palace": None, "git": {"status": "ok", "commits_considered": 2, "included": 0}}}
    pack.fit_json(want, edges, most)
    want["stats"]["git"]["included"] = sum(i["kind"] == "commit" for i in want["items"])
    plain = {k: v for k, v in want["stats"].items() if k != "palace"}
    assert json.loads(got.json) == want | {"stats": plain}
    assert len(got.json.encode()) <= most or not got["items"]


def test_no_rows(spark):
    """Questions that nothing was found for, and no questions at all."""
    rows = spark.createDataFrame([], "query_id int, pos int, path string, start_line int, end_line int, symbol string, kind string, text string, why array<string>, state string, cost int, admitted boolean")
    shown = spark.createDataFrame([], "query_id int, shown array<struct<`from`:string,`to`:string,kind:string,confidence:string>>")
    counts = spark.createDataFrame([], "query_id int, symbols long, commits long")
    q = spark.createDataFrame([(7, "x", 10)], "query_id int, query string, budget int")
    (one,) = packages.assembled(q, rows, shown, counts).collect()
    assert (one.used_tokens, one["items"], one.edges, one.stats.truncated, one.stats.files_considered) == (0, [], [], False, 0)
    assert packages.assembled(q.where(F.lit(False)), rows, shown, counts).count() == 0
