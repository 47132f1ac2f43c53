"""Listing on executors equals listing on the driver, whatever part of the tree a task comes to."""

import random

import pytest

from spanloom import api
from spanloom.sources import tree

from .test_engine import NoGit, write

RULES = ["*.log", "/x1", "b*/", "!keep.log", "**/deep/*.txt", "n?.md", "x[12]/", "# none", "", "c/**", "!c/n1.md"]


def random_tree(root, seed):
    rng = random.Random(seed)
    folders = [""]
    for _ in range(60):
        folders.append(f"{rng.choice(folders)}/{rng.choice(['a', 'b1', 'b2', 'c', 'x1', 'x2', 'deep', '.hid', 'node_modules'])}".lstrip("/"))
    files = {f"{rng.choice(folders)}/{rng.choice(['n1.md', 'n2.md', 'k.log', 'keep.log', 't.txt', 'm.py', '.env'])}".lstrip("/"): "x" for _ in range(150)}
    for f in rng.sample(folders, 12):
        files[f"{f}/.gitignore".lstrip("/")] = "\n".join(rng.sample(RULES, 3))
    write(root, files | {".spanloomignore": "t.txt\n"})
    (root / "a").mkdir(exist_ok=True)
    (root / "a" / "loop").symlink_to(root)


@pytest.mark.parametrize("seed", range(4))
def test_same_as_driver(spark, tmp_path, monkeypatch, seed):
    root = tmp_path / "tree"
    root.mkdir()
    random_tree(root, seed)
    want = tree.list_tree(root)
    assert len(want) > 10 and "a/loop" not in want
    monkeypatch.setattr(tree, "DRIVER_ENTRIES", [0, 15, 15, 10_000][seed])
    monkeypatch.setattr(tree, "TASK_ENTRIES", [3, 10, 10_000, 3][seed])
    paths, n = tree.list_files(spark, root, None, str(tmp_path / "work"))
    assert sorted(r.path for r in paths.collect()) == want and n == len(want)
    below = sorted(p for p in (d.name for d in root.iterdir() if d.is_dir()) if p in ("a", "b1", "c"))[0]
    paths, n = tree.list_files(spark, root / below, root, str(tmp_path / "work-below"))
    assert sorted(r.path for r in paths.collect()) == tree.list_tree(root / below, root) and n == paths.count()


def test_empty_and_missing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "DRIVER_ENTRIES", -1)
    (tmp_path / "t").mkdir()
    paths, n = tree.list_files(spark, tmp_path / "t", None, str(tmp_path / "w"))
    assert n == 0 == paths.count()
    with pytest.raises(OSError):
        tree.list_tree(tmp_path / "none")


def test_index_of_a_large_tree(spark, tmp_path, monkeypatch):
    """A build whose tree executors have listed, and one of the same tree without them."""
    monkeypatch.setattr(tree, "DRIVER_ENTRIES", 2)
    write(tmp_path, {f"p{k}/q/m{j}.py": f"def f{k}_{j}():\n    pass\n" for k in range(3) for j in range(2)} | {"p1/.gitignore": "m1.py\n"})
    api.init(tmp_path)
    first = api.index_tree(spark, tmp_path, git=NoGit())
    monkeypatch.undo()
    second = api.index_tree(spark, tmp_path, git=NoGit())
    assert (first.scanned, first.indexed, second.unchanged, second.indexed, second.deleted) == (5, 5, 5, 0, 0)
