"""Segments: what is alive after changes, what is written and read, and that an index kept up to date is one built anew."""

import json
import random
import shutil
from dataclasses import replace

from pyspark.sql import functions as F

from spanloom import api, build, segments
from spanloom.operators import graph
from spanloom.segments import Segments, Table

from .test_engine import FakeGit, NoGit, write

TABLES = {"rows": Table("path string, v long", "path", "path"), "links": Table("path string, w long", "path", "path", "links"), "words": Table("path string, term string", "path", "term", sorted_by="term")}


def test_random_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "KEYS_A_BUCKET", 4)
    rng = random.Random(1)
    store, rows, links, sizes = Segments(spark, str(tmp_path), TABLES), {}, {}, []
    for step in range(12):
        keys = rng.sample([f"p{k}" for k in range(40)], 30 if not step else rng.randint(1, 6))
        new = {k: step * 100 + j for j, k in enumerate(keys) if rng.random() < 0.8}
        relinked = [k for k in rows if k not in keys and rng.random() < 0.1]
        gone = [(k, "all") for k in keys if k in rows] + [(k, "links") for k in relinked]
        for k in keys:
            rows.pop(k, None), links.pop(k, None)
        rows |= new
        links |= {k: -step for k in [*new, *relinked]}
        frame = spark.createDataFrame([*new.items()], "path string, v long")
        tables = {"rows": frame, "links": spark.createDataFrame([(k, -step) for k in [*new, *relinked]], "path string, w long"), "words": frame.select("path", F.concat(F.lit("t"), F.col("v") % 3).alias("term"))}
        before = store
        store = store.with_segment(store.write(tables, spark.createDataFrame(gone, "key string, what string"), len(new), len(gone)))
        assert dict(store.read("rows").collect()) == rows and dict(store.read("links").collect()) == links
        assert sorted(tuple(r) for r in store.read("words").collect()) == sorted((k, f"t{v % 3}") for k, v in rows.items())
        some = spark.createDataFrame([(k,) for k in [*rows][:3]] + [("none",)], "path string")
        assert dict(store.read("rows", some).collect()) == {k: rows[k] for k in [*rows][:3]}
        assert set(before.retired) <= set(store.retired) and before.read("rows").count() >= 0
        sizes.append([s.size for s in store.listed])
    assert all(a >= 2 * b for s in sizes for a, b in zip(s, s[1:], strict=False)) and max(map(len, sizes)) > 1


def test_reads_only_buckets_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "KEYS_A_BUCKET", 10)
    frame = spark.createDataFrame([(f"p{k}", k) for k in range(1000)], "path string, v long")
    store = Segments(spark, str(tmp_path), TABLES)
    store = store.with_segment(store.write({"rows": frame, "links": frame.withColumnRenamed("v", "w"), "words": frame.select("path", F.lit("t").alias("term"))}, None, 1000, 0))
    assert store.listed[0].buckets == 100
    one = store.read("rows", spark.createDataFrame([("p7",)], "path string"))
    files = {f for f in one.inputFiles()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.collect()[0].v == 7 and "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and files
    assert store.read("rows", spark.createDataFrame([], "path string")).count() == 0


NAMES = ["alpha", "beta", "gamma", "delta", "handle", "ADR-7"]


def random_file(rng, path):
    n = rng.randint(0, 3)
    if path.endswith(".py"):
        body = "".join(f"def {rng.choice(NAMES[:5])}():\n    return {rng.choice(NAMES[:5])}()\n" for _ in range(n))
        return "".join(f"import {rng.choice(['b', 'd.e', 'nothing'])}\n" for _ in range(rng.randint(0, 2))) + body
    if path.endswith(".ts"):
        imports = "".join(f"import {{ x }} from '{rng.choice(['./a', '../b', './d/e', 'a', './c.ts', 'q/a'])}'\n" for _ in range(rng.randint(0, 2)))
        return imports + "".join(f"export function {rng.choice(NAMES[:5])}() {{ return {rng.choice(NAMES[:5])}() }}\n" for _ in range(n))
    return f"# {rng.choice(NAMES)}\n## Decision\nyes\nSupersedes ADR-{rng.choice('78')}\n"


PATHS = ["a.py", "b.py", "d/e.py", "a.ts", "c.ts", "q/a.ts", "q/b.ts", "d/e.ts", "docs/adr/007.md", "docs/adr/008.md", "b.ts", "x/handle.py"]


def tables_of(spark, root):
    """Everything an index says, without what may differ between equal ones."""
    files, commits = api._files(spark, root), api._commits(spark, root)
    out = {n: sorted((tuple(map(str, r)) for r in files.read(n).drop("mtime").collect())) for n in files.tables if n != "terms"}
    assert {r.term for r in files.read("terms").collect()} >= {r.term for r in files.read("postings").select("term").distinct().collect()}
    known = api.meta(root)
    return out | {n: sorted(tuple(map(str, r)) for r in commits.read(n).collect()) for n in commits.tables if n != "commit_terms"} | {c: known.get(c, 0) for c in ("file_count", "symbol_count", "edge_count", "token_count", "commit_count", "commit_tokens")}


def test_kept_up_to_date_is_built_anew(spark, tmp_path, seed=1):
    """After any changes an index equals one that is built from the same tree at once."""
    rng = random.Random(seed)
    root, fresh = tmp_path / "kept", tmp_path / "fresh"
    root.mkdir()
    write(root, {p: random_file(rng, p) for p in PATHS})
    api.init(root)
    git = FakeGit([("a" * 40, "first", "", ["a.py"])])
    api.index_tree(spark, root, git=git)
    for step in range(3):
        for p in rng.sample(PATHS, rng.randint(1, 3)):
            if rng.random() < 0.35:
                (root / p).unlink(missing_ok=True)
            else:
                write(root, {p: random_file(rng, p)})
        git = FakeGit([(f"{step:040d}", f"step {step}", "body", ["b.py"])], f"h{step + 2}", [f"h{step + 1}"])
        api.index_tree(spark, root, git=git)
    shutil.copytree(root, fresh, ignore=shutil.ignore_patterns(api.FOLDER))
    api.init(fresh)
    log = [("a" * 40, "first", "", ["a.py"]), *((f"{k:040d}", f"step {k}", "body", ["b.py"]) for k in range(3))]
    api.index_tree(spark, fresh, git=FakeGit(log))
    kept, anew = tables_of(spark, root), tables_of(spark, fresh)
    assert [r.path for r in api.search_code(spark, root, "impo*", 50).collect()] == [r.path for r in api.search_code(spark, fresh, "impo*", 50).collect()] != []
    assert kept.keys() == anew.keys() and [k for k in kept if kept[k] != anew[k]] == []
    assert len(api._files(spark, root).listed) < 4


def test_nothing_changed_writes_nothing(spark, tmp_path):
    write(tmp_path, {p: "def f():\n    pass\n" for p in ("a.py", "b.py", "c/d.py", "e.py", "f.py")})
    api.init(tmp_path)
    api.index_tree(spark, tmp_path, git=NoGit())
    written = lambda: sorted(str(p) for p in (tmp_path / api.FOLDER).rglob("*.parquet"))
    before, known = written(), api.meta(tmp_path)
    index = api.open_index(spark, tmp_path)
    s = api.index_tree(spark, tmp_path, git=NoGit())
    assert (s.indexed, s.unchanged) == (0, 5) and written() == before and api.open_index(spark, tmp_path) is index
    write(tmp_path, {"a.py": "def g():\n    return f()\n"})
    (tmp_path / api.FOLDER / "segment-of-a-build-that-broke-off").mkdir()
    s = api.index_tree(spark, tmp_path, git=NoGit())
    assert (s.indexed, s.unchanged) == (1, 4) and set(before) < set(written())
    assert {p.name for p in (tmp_path / api.FOLDER).iterdir()} == {"CURRENT", *(x["name"] for x in api.meta(tmp_path)["segments"])}
    assert len(api.meta(tmp_path)["segments"]) == 2 and api.meta(tmp_path)["segments"][0] == known["segments"][0]


def test_states_outlive_the_next_build(spark, tmp_path):
    """What was opened before a build can be read after it, whatever that merged or replaced."""
    write(tmp_path, {"a.py": "def f():\n    pass\n", "b.py": "def g():\n    return f()\n"})
    api.init(tmp_path)
    api.index_tree(spark, tmp_path, git=FakeGit([("a" * 40, "first", "", [])]))
    index = api.open_index(spark, tmp_path)
    write(tmp_path, {"a.py": "def h():\n    pass\n", "b.py": "x = 1\n"})
    api.index_tree(spark, tmp_path, force=True, git=FakeGit([("b" * 40, "second", "", [])], "h2"))
    assert sorted(r.name for r in index.symbols.where("kind = 'function'").collect()) == ["f", "g"] and index.edges.count() > 0
    assert index.commits.first().subject == "first" and index.texts.postings.where("term = 'pass'").count() == 1
    assert [r.name for r in api.open_index(spark, tmp_path).symbols.where("kind = 'function'").collect()] == ["h"]
    api.index_tree(spark, tmp_path, git=NoGit())
    assert {p.name for p in (tmp_path / api.FOLDER).iterdir()} == {"CURRENT", *(x["name"] for k in ("segments", "commit_segments") for x in api.meta(tmp_path)[k])}


def test_older_layout(spark, tmp_path):
    """Files are read anew, commits are carried over."""
    write(tmp_path, {"a.py": "def f():\n    pass\n"})
    api.init(tmp_path)
    old = tmp_path / api.FOLDER / "snapshot-1"
    spark.createDataFrame([("s1", "ann", "2024", "old one", 0)], "sha string, author string, authored_at string, subject string, ord int").write.parquet(str(old / "commits"))
    api._point(tmp_path / api.FOLDER, {"schema_version": 3, "snapshot": "snapshot-1", "git_status": "ok", "git_head": "h1", "file_count": 9, "symbol_count": 9, "edge_count": 9, "commit_count": 1})
    assert api.open_index(spark, tmp_path) is None
    api.index_tree(spark, tmp_path, git=FakeGit([("b" * 40, "new", "", [])], "h2", ["h1"]))
    assert [r.subject for r in api.open_index(spark, tmp_path).commits.orderBy("ord").collect()] == ["old one", "new"]
    assert api.meta(tmp_path)["file_count"] == 1 and api.meta(tmp_path)["commit_count"] == 2 and build.FILE_TABLES.keys() >= {"files"}


def test_stream_keeps_an_index(spark, tmp_path):
    """After any batches the index equals one built from the files that are left, and a batch that is run again changes nothing."""
    from spanloom.streaming.incremental import follow_index, last_of

    root, src, fresh = tmp_path / "kept", tmp_path / "in", tmp_path / "fresh"
    for p in (root, src, fresh):
        p.mkdir()
    rng, files = random.Random(4), {}
    for n in range(3):
        rows = []
        for p in PATHS if not n else rng.sample(PATHS, 4):
            gone = bool(n) and rng.random() < 0.4
            text = "" if gone else random_file(rng, p)
            rows += [{"path": p, "content": "old = 1\n", "deleted": False, "at": f"2024-01-0{n + 1}T00:00:00Z"}, {"path": p, "content": text, "deleted": gone, "at": f"2024-01-0{n + 1}T00:00:05Z"}]
            files.pop(p, None)
            if not gone:
                files[p] = text
        rows.append({"path": ".env", "content": "SECRET=1", "deleted": False, "at": "2024-01-01T00:00:00Z"})
        (src / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        follow_index(spark, str(src), str(root), str(tmp_path / "cp")).awaitTermination()
    write(fresh, files)
    api.init(fresh)
    api.index_tree(spark, fresh, git=NoGit())
    kept, anew = tables_of(spark, root), tables_of(spark, fresh)
    assert [k for k in kept if kept[k] != anew[k]] == [] and kept["file_count"] == len(files)
    again = last_of(spark.createDataFrame([("a.py", "def late(): pass\n", False, None)], "path string, content string, deleted boolean, at timestamp"))
    assert not api.apply_changes(spark, root, again, (str(tmp_path / "cp"), 2)) and tables_of(spark, root)["files"] == kept["files"]
    assert api.apply_changes(spark, root, again, (str(tmp_path / "cp"), 3)) and [r.path for r in api.search_symbols(spark, root, "late").collect()] == ["a.py"]


def test_heads(spark, tmp_path):
    """First edges of nodes: a hub's others are not read, and what went does not hide what comes next."""
    rng = random.Random(5)
    some = {n: build.FILE_TABLES[n] for n in ("edges", "heads")}
    seeds = spark.createDataFrame([(1, 0, 0), (1, 7, 1), (2, 0, 3), (2, 99_999, 4)], "query_id int, id long, seed_ord int")
    store, alive = Segments(spark, str(tmp_path), some), {}
    columns = "path string, src long, dst long, kind string, confidence string, ord int"
    plain = lambda df: sorted(map(tuple, df.select("query_id", "seed_ord", "src", "dst", "kind", "confidence", "ord").collect()))
    for step, paths in enumerate((["a", "b", "c", "d", "e", "f"], ["a", "b"], ["c", "d", "e"])):
        # the first segment's hub loses the files that all its first edges are of
        new = {p: [(p, rng.choice([0, 7, 100 + k]), rng.choice([0, 0, 7, 500 + k]), "call", "high", 1000 * "abcdef".index(p) + k) for k in range(200 if not step else 3)] for p in paths}
        gone = spark.createDataFrame([(p, "edges") for p in paths if p in alive], "key string, what string")
        alive |= new
        n = gone.count()
        segment = store.write({"edges": spark.createDataFrame([e for es in new.values() for e in es], columns)}, gone, len(paths), n)
        store = replace(store, listed=(*store.listed, segment)) if step < 2 else store.with_segment(segment)
        edges = spark.createDataFrame([e for es in alive.values() for e in es], columns)
        for most in (40, 10):
            met = build.touching_heads(store, seeds, most)
            want = graph.nearest(graph.touching(edges.drop("path"), seeds), most)
            assert plain(graph.nearest(met, most)) == plain(want) and want.count() == 3 * most
            if not step:
                assert met.count() == 3 * 40 < graph.touching(edges.drop("path"), seeds).count() / 4
    merged = store._merged(0)
    assert len(merged.listed) == 1 and plain(graph.nearest(build.touching_heads(merged, seeds, 40), 40)) == plain(graph.nearest(build.touching_heads(store, seeds, 40), 40))
    empty = Segments(spark, str(tmp_path), some)
    assert build.touching_heads(empty, seeds, 40).count() == 0 == build.touching_heads(store, seeds.limit(0), 40).count()
