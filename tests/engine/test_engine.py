"""Whole scenarios: building, asking, changing, asking again."""

import json
import subprocess
from dataclasses import replace

import pytest

from spanloom import api
from spanloom.cli import handle_line
from spanloom.operators import pack
from spanloom.plans import context
from spanloom.plans.query_plan import MatchError, fallback, ladder, parse_match, plan_query
from spanloom.sources import drawers, gitlog, tree
from spanloom.sources.drawers import Drawer, Settings


class FakeGit:
    def __init__(self, commits=(), head="h1", ancestors=()):
        self.commits, self.at, self.ancestors, self.asked = list(commits), head, set(ancestors), []

    def head(self):
        return self.at

    def is_ancestor(self, sha):
        return sha in self.ancestors

    def log(self, since=None):
        self.asked.append(since)
        return "".join(f"\x1e{s}\x1fann\x1f2024-01-01T00:00:00Z\x1f{subj}\x1f{body}\n\n" + "".join(f + "\n" for f in files) for s, subj, body, files in self.commits)


class NoGit:
    def head(self):
        raise FileNotFoundError


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


SESSION = "export function createSession() {\n  return 1\n}\n"
BANNER = "import { createSession } from './session'\nexport function LoginBanner() {\n  return createSession()\n}\n"


def built(spark, root, files, git=None, **options):
    write(root, files)
    api.init(root)
    return api.index_tree(spark, root, git=git or NoGit(), **options)


def test_plan():
    p = plan_query('where is "log in" createSession src/auth.ts .env does a.b work? TRASH_DAYS README "open')
    assert p.symbol_terms == ["log in", "createSession", "a.b", "TRASH_DAYS", "README"]
    assert p.path_hints == ["src/auth.ts", ".env"] and p.words == ["does", "work", "open"]
    assert plan_query("how does trash soft-delete work?").fts_query == "does trash soft-delete work"


@pytest.mark.parametrize("bad", ["soft-delete", "x:y", "where?", "f()", "it's", "C++", "a AND", "OR a", "NOT a", ".auth", "NEAR(a b", "(a OR b) c", "{ } : a", "^(a)"])
def test_match_errors(bad):
    with pytest.raises(MatchError):
        parse_match(bad)
    assert [e.text for e in ladder(bad)] == [bad]


def test_match():
    assert [(e.text, e.group, e.negated, e.prefix) for e in parse_match('a "b c" OR d* NOT e')] == [("a", 0, False, False), ("b c", 0, False, False), ("d", 1, False, True), ("e", 1, True, False)]
    assert [e.text for e in fallback("soft-delete it")] == ["soft", "delete", "it"] and fallback("plain words") == [] and fallback("a_") == []


def test_incremental(spark, tmp_path):
    files = {"src/auth/session.ts": SESSION, "src/auth/LoginBanner.tsx": BANNER, ".env": "SECRET=nope", "README.md": "# App\n## WebSockets\nwe use them\n", "key.pem": "x", "big.txt": "a" * 1_048_577, "s.txt": "AKIA" + "ABCDEFGH12345678", "node_modules/m.js": "x", "b.bin": "a\0b", "skip/x.py": "y = 1", ".gitignore": "skip/\n*.log\n!keep.log\n", "a.log": "", "keep.log": "k"}
    s = built(spark, tmp_path, files)
    assert (s.scanned, s.indexed, s.unchanged, s.skipped_secret, s.skipped_large, s.skipped_ignore) == (8, 4, 0, 2, 1, 1)
    edges = {(r["a"], r["b"], r["kind"], r["confidence"]) for r in _edges(spark, tmp_path)}
    assert ("LoginBanner", "createSession", "call", "high") in edges and ("<file>", "<file>", "import", "high") in edges
    again = api.index_tree(spark, tmp_path, git=NoGit())
    assert (again.indexed, again.unchanged, again.deleted) == (0, 4, 0) and {(r["a"], r["b"], r["kind"], r["confidence"]) for r in _edges(spark, tmp_path)} == edges
    # a decoy of the same name, and a caller that imports nothing
    write(tmp_path, {"src/a/decoy.ts": SESSION, "src/other.ts": "export function go() { return createSession() }\n"})
    (tmp_path / "README.md").unlink()
    s = api.index_tree(spark, tmp_path, git=NoGit())
    assert (s.indexed, s.unchanged, s.deleted) == (2, 3, 1)
    rows = _edges(spark, tmp_path)
    banner = [r for r in rows if r["a"] == "LoginBanner"]
    assert [(r["b_path"], r["confidence"]) for r in banner] == [("src/auth/session.ts", "high")]
    assert [(r["b_path"], r["confidence"]) for r in rows if r["a"] == "go"] == [("src/a/decoy.ts", "low")]
    forced = api.index_tree(spark, tmp_path, force=True, git=NoGit())
    assert (forced.indexed, forced.unchanged) == (5, 0)


def _edges(spark, root):
    i = api.open_index(spark, root)
    from pyspark.sql import functions as F

    side = lambda k, c: i.symbols.select(F.col("symbol_id").alias(k), F.col("name").alias(c), F.col("path").alias(f"{c}_path"))
    return i.edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst").collect()


def test_packages(spark, tmp_path, monkeypatch):
    files = {"src/auth/session.ts": SESSION, "src/auth/LoginBanner.tsx": BANNER, "README.md": "# App\n\n## WebSockets\nwe use them\n", "styles/auth.css": ".auth-panel { color: red }\n"}
    built(spark, tmp_path, files)
    questions = ["createSession", "WebSockets", "createSession WebSockets auth-panel", "zzzxnotarealsymbolzzz"]
    one, sockets, big, none = api.get_contexts(spark, tmp_path, questions)
    small = api.get_context(spark, tmp_path, questions[2], 9)
    assert one["items"][0]["symbol"] == "createSession" and one["items"][0]["text"] == SESSION.rstrip("\n") and "exact_symbol" in one["items"][0]["why"]
    assert any(e["from"].startswith("src/auth/LoginBanner.tsx:") and e["to"] == "src/auth/session.ts:createSession" and e["confidence"] == "high" for e in one["edges"])
    assert any(i["kind"] == "heading" and i["symbol"] == "WebSockets" for i in sockets["items"])
    assert small["used_tokens"] <= 9 and small["stats"]["dropped_for_budget"] == 1 and len(big["items"]) > len(small["items"])
    assert any(i["path"] == "styles/auth.css" for i in big["items"]) and none["items"] == [] and none["used_tokens"] == 0
    # only the files that candidates are in are read, and more questions than a few take the other way round the driver
    index, asked = api.open_index(spark, tmp_path), []
    seen = lambda paths: (asked.extend(r.path for r in paths.collect()), index.live(paths))[1]
    (again, _), = api.compile_packages(spark, replace(index, live=seen), [("WebSockets", 3000)])
    assert set(asked) == {"README.md"} and [i["text"] for i in again["items"]] == [i["text"] for i in sockets["items"]]
    monkeypatch.setattr(context, "FEW", 0)
    assert json.dumps(api.get_context(spark, tmp_path, questions[2]), sort_keys=True) == json.dumps(big, sort_keys=True)
    monkeypatch.undo()
    assert [(r.src_name, r.kind) for r in api.references(spark, tmp_path, "src/auth/session.ts").collect()] == [("<file>", "import"), ("<file>", "import"), ("LoginBanner", "call")]
    # a changed file is not quoted until it is indexed again
    write(tmp_path, {"src/auth/session.ts": "// new\n" + SESSION})
    stale = api.get_context(spark, tmp_path, "createSession")
    assert stale["stats"]["stale_omitted"] >= 1 and not any(i["path"] == "src/auth/session.ts" for i in stale["items"])
    assert api.doctor(spark, tmp_path)["stale"] == 1
    text = pack.as_json(one)
    assert '"palace"' not in text and len(text.encode()) <= pack.MAX_JSON_BYTES and "```" in pack.digest(one)


def test_ranking(spark, tmp_path):
    files = {
        "services/trash.ts": "export const TRASH_RETENTION_DAYS = 30\nexport interface TrashItemRow { id: string }\nexport function purgeTrash() { return TRASH_RETENTION_DAYS }\n",
        "config.ts": "// trash settings\nexport const TRASH_RETENTION_DAYS_COPY = 1\nimport { TRASH_RETENTION_DAYS } from './services/trash'\n",
        "RemoveTagsDialog.tsx": "// soft delete of tags, does work\nexport function RemoveTagsDialog() { return null }\n",
        "pdf_thumbnail.ts": "export function thumb() { return 1 }\n",
        "docs/adrs/ADR-001-trash.md": "# ADR-001 Trash\n## Decision\nWe soft delete into the trash.\n",
    }
    built(spark, tmp_path, files)
    a, b, c = api.get_contexts(spark, tmp_path, ["how does trash soft-delete work?", "trash retention", "TRASH_RETENTION_DAYS"])
    paths = [i["path"] for i in a["items"]]
    assert paths[0] == "docs/adrs/ADR-001-trash.md" and a["items"][0]["kind"] == "decision" and "services/trash.ts" in paths and "pdf_thumbnail.ts" not in paths
    assert a["used_tokens"] <= 3000 and {"TrashItemRow", "purgeTrash"} & {i["symbol"] for i in b["items"] if i["path"] == "services/trash.ts"}
    assert {"services/trash.ts", "config.ts"} <= {i["path"] for i in c["items"]}


def test_history(spark, tmp_path):
    git = FakeGit([("a" * 40, "Use WebSockets", "because polling is slow " * 60, ["src/auth/session.ts"]), *((f"{k:040d}", f"why change {k}", "", ["x.py", "y.py"]) for k in range(20))])
    built(spark, tmp_path, {"src/auth/session.ts": "// WebSockets\n" + SESSION, "docs/adr/007-websockets.md": "# Use WebSockets\n## Decision\nyes\nSupersedes ADR-6\n", "docs/adr/006.md": "# ADR-6\nold\n"}, git)
    assert api.meta(tmp_path)["commit_count"] == 21 and api.meta(tmp_path)["git_status"] == "ok"
    p, q = api.get_contexts(spark, tmp_path, ["why WebSockets", "createSession"])
    commit = next(i for i in p["items"] if i["kind"] == "commit" and i["symbol"] == "aaaaaaa")
    assert "commit_path" in commit["why"] and commit["text"].endswith("…") and commit["path"] == f"git://{'a' * 40}"
    assert any(i["kind"] == "decision" for i in p["items"]) and any(i["path"] == "src/auth/session.ts" and "fts" in i["why"] for i in p["items"])
    assert [(r["a"], r["b"], r["confidence"]) for r in _edges(spark, tmp_path) if r["kind"] == "supersedes"] == [("Use WebSockets", "ADR-6", "high")]
    assert q["items"][0]["symbol"] == "createSession" and p["stats"]["git"]["status"] == "ok" and p["stats"]["git"]["included"] >= 1
    later = FakeGit([("b" * 40, "later", "one word\n", [])], "h2", ["h1"])
    api.index_tree(spark, tmp_path, git=later)
    assert later.asked == ["h1"] and api.meta(tmp_path)["commit_count"] == 22
    api.index_tree(spark, tmp_path, git=NoGit())
    assert api.meta(tmp_path)["git_status"] == "not_installed" and api.meta(tmp_path)["commit_count"] == 22


def test_real_git(spark, tmp_path):
    write(tmp_path, {"a.py": "def f():\n    pass\n"})
    run = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "first words\n\nbody of it\nlast")
    got = gitlog.parse_log(spark.createDataFrame([(gitlog.GitLog(tmp_path).log(),)], "value string")).first()
    assert (got.subject, got.author, got.files, got.body) == ("first words", "n", ["a.py"], "body of it\nlast")
    assert gitlog.read_log(gitlog.GitLog(tmp_path))[0] == "ok"


def test_nested(spark, tmp_path):
    git = FakeGit([("c" * 40, "web", "", ["src/a.ts"])])
    built(spark, tmp_path, {"apps/web/src/a.ts": "export function ping() {}\n", "apps/api/src/b.ts": "export function pong() {}\n"})
    before = api.meta(tmp_path)
    (tmp_path / "apps/web/src/a.ts").unlink()
    write(tmp_path, {"apps/web/src/c.ts": "export function peng() {}\n"})
    (tmp_path / "apps/api/src/b.ts").unlink()
    s = api.index_tree(spark, tmp_path, below=tmp_path / "apps/web", git=git)
    assert (s.indexed, s.deleted) == (1, 1)
    assert {r.path for r in api.open_index(spark, tmp_path).files.collect()} == {"apps/web/src/c.ts", "apps/api/src/b.ts"}
    assert api.open_index(spark, tmp_path).commits.first().files == ["apps/web/src/a.ts"] and api.meta(tmp_path)["commit_count"] == before["commit_count"] == 0


def test_searches(spark, tmp_path):
    built(spark, tmp_path, {"src/auth/session.ts": SESSION, "a/create_session.py": "def create_session():\n    pass\ndef createSessionNow():\n    pass\n"})
    assert [r.name for r in api.search_symbols(spark, tmp_path, "CREATESESSION").collect()] == ["createSession", "createSessionNow"]
    assert [r.path for r in api.search_code(spark, tmp_path, "create-session").collect()] == ["a/create_session.py", "src/auth/session.ts"]
    ask = lambda m, p=None, **k: json.loads(handle_line(spark, str(tmp_path), json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": p or {}} | k)))
    assert ask("initialize")["result"]["serverInfo"]["name"] == "spanloom" and len(ask("tools/list")["result"]["tools"]) == 4
    assert json.loads(ask("tools/call", {"name": "search_symbols", "arguments": {"name": "createSession"}})["result"]["content"][0]["text"])[0]["path"] == "src/auth/session.ts"
    assert ask("nope")["error"]["code"] == -32601 and ask("tools/call", {"name": "search_code", "arguments": {}})["error"]["code"] == -32602
    assert json.loads(handle_line(spark, ".", "{"))["error"]["code"] == -32700 and json.loads(handle_line(spark, ".", "[]"))["error"]["code"] == -32600
    assert handle_line(spark, ".", '{"jsonrpc": "2.0", "method": "x"}') is None
    bad = json.loads(handle_line(spark, str(tmp_path / "src"), json.dumps({"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "index_status"}})))
    assert bad["result"]["isError"] and bad["result"]["content"][0]["text"] == "not_initialized"


def test_json_limit():
    item = {"path": "a", "start_line": 1, "end_line": 1, "symbol": "s", "kind": None, "text": "word " * 500, "why": []}
    package = {"query": "q", "budget_tokens": 9999, "used_tokens": 0, "items": [dict(item, path=f"p{k}") for k in range(20)], "edges": [], "stats": {"stale_omitted": 0, "stale_index": False, "truncated": False, "palace": None}}
    edges = [{"from": "p0:s", "to": "p1:s"}, {"from": "p0:s", "to": "p19:s"}]
    got = pack.fit_json(package, edges)
    assert len(pack.as_json(got).encode()) <= pack.MAX_JSON_BYTES and got["stats"]["truncated"] and got["used_tokens"] == 502 * len(got["items"]) and got["edges"] == edges[:1]


OUTPUT = "=====\n  Results\n\n  [1] sessions / technical\n      Source: a.json\n      Match:  cosine=0.686  bm25=1.6\n\n      first line\n      }\n\n  ────\n  [2] w / r\n      Match: bm25=2\n  → arrow body\n  ────\n  [x] no / header\n"


def test_drawers():
    a, b = drawers.parse_output(OUTPUT)
    assert (a.wing, a.room, a.source, a.cosine, a.text) == ("sessions", "technical", "a.json", 0.686, "first line\n}") and (b.cosine, b.text) == (None, "arrow body")
    s = drawers.parse_settings('palace = true # yes\npalace_wing = "w"\npalace_room=r\npalace_min_cosine = 3\npalace_min_cosine = 0.7\n')
    assert (s.enabled, s.wing, s.room, s.min_cosine) == (True, "w", "r", 0.7)
    assert [drawers.may_ask(*x, Settings(enabled=c)) for *x, c in ((False, "1", True), (True, "no", True), (True, None, False), (None, "yes", False), (None, None, True), (None, None, None))] == [False, False, True, True, True, False]


@pytest.mark.parametrize("drawer, status, included", [
    (Drawer("w", "r", "s", "word " * 80, 0.8), "ok", 2), (Drawer("w", "r", "s", "x", 0.34), "below_threshold", 0), (Drawer("w", "r", "s", "x", None), "below_threshold", 0), ("timeout", "timeout", 0), ("not_installed", "not_installed", 0),
])
def test_attach(drawer, status, included):
    def search(query, limit, wing, room):
        if isinstance(drawer, str):
            raise drawers.SearchError(drawer)
        return [drawer] * 5

    package = lambda used: {"query": "q", "budget_tokens": 300, "used_tokens": used, "items": [], "edges": [], "stats": {"stale_omitted": 0, "stale_index": False, "truncated": False, "palace": None}}
    got = drawers.attach(package(100), [], "q", search, Settings(True, "w"))
    assert got["stats"]["palace"]["status"] == status and got["stats"]["palace"]["included"] == included == len(got["items"])
    assert drawers.attach(package(101), [], "q", search, Settings(True, "w"))["stats"]["palace"] == {"status": "ok", "attempted": 0, "included": 0, "dropped_for_budget": 0}
    assert drawers.attach(package(0), [], "q", search, Settings(True))["stats"]["palace"]["status"] == "unscoped_disabled"
    assert drawers.attach(package(0), [], "q", search, Settings())["stats"]["palace"] is None


def test_ignore_rules(tmp_path):
    write(tmp_path, {p: "" for p in ("a/b/c.txt", "a/x.log", "d/keep.log", "d/e/f.py", "__init__.py", ".hidden", "build/z.py", "d/only/here.md", "q1.txt", "q2.txt")} | {".gitignore": "*.log\n/d/e/**\n# c\nq[1].txt\n", "d/.gitignore": "!keep.log\nonly/\n", ".spanloomignore": "a/**/c.txt\n"})
    assert tree.list_tree(tmp_path) == ["__init__.py", "d/keep.log", "q2.txt"]


def test_stream(spark, tmp_path):
    from spanloom.streaming.incremental import follow

    src = tmp_path / "in"
    src.mkdir()
    row = lambda p, c, d, t: json.dumps({"path": p, "content": c, "deleted": d, "at": f"2024-01-01T00:00:{t:02d}Z"})
    (src / "1.json").write_text("\n".join([row("a.py", "x", False, 1), row("a.py", "y", False, 3), row("b.md", "z", False, 2)]))
    run = lambda: follow(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "2.json").write_text("\n".join([row("b.md", "", True, 5), row("c.ts", "w", False, 5)]))
    run()
    got = {r.path: r for r in spark.read.parquet(str(tmp_path / "out/batch=1")).collect()}
    import hashlib

    assert set(got) == {"a.py", "c.ts"} and got["a.py"].hash == hashlib.sha256(b"y").hexdigest() and got["c.ts"].language == "typescript"
