"""Source trees: listing with ignore rules, on the executors where a tree is large, and reading there."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import saved

IGNORE_FILES = (".gitignore", ".spanloomignore")


def ignore_pattern(line: str, folder: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over paths relative to the root, negated, folders only) of one line of an ignore file in ``folder``."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\")
    dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, k = [], 0
    line = line.lstrip("/")
    while k < len(line):
        if line.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif line.startswith("/**", k) and k + 3 == len(line):
            out.append("/.+")
            k += 3
        elif line[k] == "*":
            out.append("[^/]*")
            k += 2 if line.startswith("**", k) else 1
        elif line[k] == "?":
            out.append("[^/]")
            k += 1
        elif line[k] == "[" and (end := line.find("]", k + 2)) > 0:
            out.append("[" + ("^" if line[k + 1] in "!^" else "") + re.escape(line[k + 1 + (line[k + 1] in "!^") : end]).replace(r"\-", "-") + "]")
            k = end + 1
        else:
            k += line[k] == "\\" and k + 1 < len(line)
            out.append(re.escape(line[k]))
            k += 1
    above = re.escape(folder + "/") if folder else ""
    return re.compile(above + ("" if anchored else "(?:.*/)?") + "".join(out)), negated, dirs


Source = tuple[str, str]  # an ignore file, and the folder that its rules begin at


class _Walk:
    """Steps over the folders below ``root``; a folder comes with the ignore files that count in it, outer ones first.

    The last rule that matches a path decides.  An ignore file that can't be
    read ignores all below it; a folder that can't be read has nothing.
    """

    def __init__(self, root: str | Path):
        self.root, self.parsed = str(root), {}

    def rules(self, source: Source) -> list:
        if source not in self.parsed:
            file, folder = source
            try:
                lines = Path(file).read_text("utf-8", "replace").split("\n")
            except FileNotFoundError:
                lines = []
            except OSError:
                lines = ["*"]
            self.parsed[source] = [r for line in lines if (r := ignore_pattern(line, folder))]
        return self.parsed[source]

    def ignored(self, sources: list[Source], path: str, is_dir: bool) -> bool:
        for source in reversed(sources):
            for pattern, negated, dirs in reversed(self.rules(source)):
                if (is_dir or not dirs) and pattern.fullmatch(path):
                    return not negated
        return False

    def step(self, folder: str, sources: list[Source]) -> tuple[list[str], list[tuple[str, list[Source]]]]:
        """(files, folders) of a folder, relative to the root."""
        here = os.path.join(self.root, folder)
        own = [(os.path.join(here, name), folder) for name in (IGNORE_FILES if not folder else IGNORE_FILES[:1])]
        sources = [*sources, *(s for s in own if self.rules(s))]
        files, folders = [], []
        try:
            entries = [*os.scandir(here)]
        except OSError:
            if not folder:
                raise
            return files, folders
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or self.ignored(sources, path, is_dir):
                continue
            if is_dir and e.name not in T.SKIP_DIRS:
                folders.append((path, sources))
            elif e.is_file(follow_symlinks=False):
                files.append(path)
        return files, folders

    def some(self, todo: list[tuple[str, list[Source]]], most: float) -> list[str]:
        """Files of the folders ``todo`` and below; beyond ``most`` files and folders, what is left to do stays in ``todo``."""
        out, seen = [], 0
        while todo and seen <= most:
            files, folders = self.step(*todo.pop())
            out += files
            todo += folders
            seen += len(files) + 1
        return out


def _begin(root: Path, workspace: str | Path | None) -> list[tuple[str, list[Source]]]:
    outer = [(str(Path(workspace) / IGNORE_FILES[1]), "")] if workspace is not None and Path(workspace) != root else []
    return [("", outer)]


def list_tree(root: str | Path, workspace: str | Path | None = None) -> list[str]:
    """Relative paths of regular files, sorted: nothing hidden, none of the skipped folders, nothing that ignore files name."""
    return sorted(_Walk(root).some(_begin(Path(root), workspace), float("inf")))


#: Files and folders that the driver looks at before executors go on, and that a task looks at before what is left is dealt out again.
DRIVER_ENTRIES, TASK_ENTRIES = 20_000, 50_000
_LISTED = "path string, sources array<struct<file:string,folder:string>>"


def list_files(spark: SparkSession, root: str | Path, workspace: str | Path | None, work: str) -> tuple[DataFrame, int]:
    """``list_tree`` as a table (path) and its number of rows; only a small tree is walked by the driver alone.

    Of a large one the folders that are left after ``DRIVER_ENTRIES`` are dealt
    over tasks.  A task gives back, after ``TASK_ENTRIES``, the folders that it
    has not come to, and these are dealt again, so a deep or large part of the
    tree is not one task's.  Folders carry the names of the ignore files that
    count in them.  The entries of one folder are read by one task.  ``work``: a
    folder for the tables of the passes.
    """
    base, todo = str(root), _begin(Path(root), workspace)
    walk = _Walk(root)
    first = walk.some(todo, DRIVER_ENTRIES)
    local = spark.createDataFrame([(p,) for p in first], "path string")
    if not todo:
        return local, len(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, todo, seen = _Walk(base), [], 0
        source = pa.list_(pa.struct([("file", pa.string()), ("folder", pa.string())]))
        rows = lambda paths, sources: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sources, source)], names=["path", "sources"])
        for batch in batches:
            todo += [(f, [(s["file"], s["folder"]) for s in sources]) for f, sources in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        while todo and seen <= TASK_ENTRIES:
            files, folders = walk.step(*todo.pop())
            todo += folders
            seen += len(files) + 1
            yield rows(files, [None] * len(files))
        yield rows([f for f, _ in todo], [[{"file": a, "folder": b} for a, b in sources] for _, sources in todo])

    left, n, turn = spark.createDataFrame(todo, _LISTED), len(todo), 0
    out, total = local, len(first)
    while n:
        tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
        found = saved(left.repartition(tasks).mapInArrow(run, _LISTED), f"{work}/listed-{turn}")
        counted = found.agg(F.count("sources").alias("left"), F.count("*").alias("all")).first()
        left, n, turn = found.where("sources is not null"), counted.left, turn + 1
        out, total = out.unionByName(found.where("sources is null").select("path")), total + counted["all"] - n
    return out, total


def dealt(paths: DataFrame, n: int) -> DataFrame:
    """``n`` paths over as many tasks as they are worth."""
    return paths.repartition(max(1, min(n // 200 + 1, paths.sparkSession.sparkContext.defaultParallelism)))


def read_paths(paths: DataFrame, root: str | Path, prefix: str = "") -> DataFrame:
    """(path, content, size, mtime, hash, binary, strict, readable) of files (column path) below ``root``; content is null over the size limit.

    ``root`` must be visible to the executors under the same name.
    """
    base = str(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = {n: [] for n in ("path", "content", "size", "mtime", "hash", "binary", "strict", "readable")}
            for path in batch.column(0).to_pylist():
                raw, size, mtime, ok = None, 0, 0, True
                try:
                    stat = os.stat(os.path.join(base, path))
                    size, mtime = stat.st_size, int(stat.st_mtime)
                    if size <= T.MAX_FILE_BYTES:
                        raw = Path(base, path).read_bytes()
                except OSError:
                    ok = False
                strict = True
                if raw is not None:
                    try:
                        raw.decode()
                    except UnicodeDecodeError:
                        strict = False
                for name, v in zip(out, (prefix + path, None if raw is None else raw.decode("utf-8", "replace"), size, mtime, None if raw is None else hashlib.sha256(raw).hexdigest(), raw is not None and b"\0" in raw, strict, ok), strict=True):
                    out[name].append(v)
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=[*out])

    return paths.select("path").mapInArrow(run, "path string, content string, size long, mtime long, hash string, binary boolean, strict boolean, readable boolean")


def with_skip_kind(files: DataFrame) -> DataFrame:
    kind = T.skip_kind(F.col("path"), F.col("content"), F.col("size"))
    return files.withColumn("skip_kind", F.when(~F.col("readable"), "unreadable").when(F.col("binary") & (kind != "ignore") & (kind != "secret_name"), "binary").otherwise(kind)).withColumn("language", T.language(F.col("path")))


EXTRACTED = "path string, parse_status string, symbols array<struct<ord:int,name:string,kind:string,start_line:int,end_line:int,start_byte:int,end_byte:int,signature:string>>, raw_edges array<struct<ord:int,src_name:string,dst_name:string,kind:string,confidence:string>>"


def extracted(files: DataFrame) -> DataFrame:
    """Symbols and raw edges of each file (path, content), one row a file; a task holds those of one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .extract import extract
        from .extract.base import Edge, Symbol

        ints = ("ord", "start_line", "end_line", "start_byte", "end_byte")
        kind = lambda n: pa.int32() if n in ints else pa.string()

        def listed(of: type, items: list) -> pa.Array:
            names = [*of.__dataclass_fields__]
            columns = [pa.array(range(len(items)), pa.int32()), *(pa.array((getattr(x, n) for x in items), kind(n), size=len(items)) for n in names)]
            return pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), pa.StructArray.from_arrays(columns, ["ord", *names]))

        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                x = extract(path.as_py(), content.as_py() or "")
                found = [pa.array([path.as_py()], pa.string()), pa.array([x.status], pa.string()), listed(Symbol, x.symbols), listed(Edge, x.edges)]
                del x
                yield pa.RecordBatch.from_arrays(found, names=["path", "parse_status", "symbols", "raw_edges"])

    return files.select("path", "content").mapInArrow(run, EXTRACTED)
