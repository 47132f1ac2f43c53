"""Commit history as a table: running the log command, and parsing its records natively."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The log format; records begin with \x1e, fields are split by \x1f.
FORMAT = "%x1e%H%x1f%an%x1f%aI%x1f%s%x1f%b"
RECORD, FIELD = "\x1e", "\x1f"
BODY_CHARS = 800
TIMEOUT_S = 120


def split_files(tail: Column) -> tuple[Column, Column]:
    """(body, files) of a record's last field: files are its last run of lines without spaces, trailing blank lines aside."""
    lines = F.split(F.regexp_replace(tail, r"\s+\z", ""), "\n")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"\r\z", ""))
    back = F.reverse(trimmed)
    is_file = lambda x: (x != "") & ~x.rlike(r"\s")
    first_other = F.coalesce(F.array_position(F.transform(back, lambda x: ~is_file(x)), True), F.lit(0))
    n = F.when(first_other == 0, F.size(back)).otherwise(first_other - 1).cast("int")
    files = F.slice(trimmed, F.size(trimmed) - n + 1, n)
    body = F.regexp_replace(F.array_join(F.slice(trimmed, F.lit(1), F.size(trimmed) - n), "\n"), r"\s+\z", "")
    return body, files


def records(spark: SparkSession, text: str) -> DataFrame:
    """(at, value) of a log output, a row for each record."""
    rows = [(k, RECORD + r) for k, r in enumerate(text.split(RECORD)[1:])]
    return spark.createDataFrame(rows, "at int, value string")


def parse_log(texts: DataFrame, column: str = "value", at: str | None = None) -> DataFrame:
    """(sha, author, authored_at, subject, body, files, ord) of log outputs, one row a commit; broken records are passed over.

    ``ord`` is the place in a row's output, or the column ``at`` where each row is a record.
    """
    each = texts.select(*([F.col(at).alias("_at")] if at else []), F.posexplode(F.split(column, RECORD)).alias("ord", "r"))
    if at:
        each = each.withColumn("ord", F.col("_at"))
    fields = each.withColumn("f", F.split("r", FIELD, 5)).where("size(f) = 5").withColumn("sha", F.trim(F.col("f")[0])).where("sha <> ''")
    body, files = split_files(F.col("f")[4])
    return fields.select("sha", F.col("f")[1].alias("author"), F.col("f")[2].alias("authored_at"), F.col("f")[3].alias("subject"), body.alias("body"), files.alias("files"), "ord")


class GitLog:
    """The installed git; ``run`` may be replaced in tests."""

    def __init__(self, root: str | Path, binary: str = "git", timeout: float = TIMEOUT_S):
        self.root, self.binary, self.timeout = Path(root), binary, timeout

    def run(self, *args: str) -> str:
        out = subprocess.run([self.binary, "-C", str(self.root), *args], capture_output=True, timeout=self.timeout, check=True)
        return out.stdout.decode("utf-8", "replace")

    def head(self) -> str:
        return self.run("rev-parse", "HEAD").strip()

    def is_ancestor(self, sha: str) -> bool:
        try:
            self.run("merge-base", "--is-ancestor", sha, "HEAD")
        except subprocess.CalledProcessError:
            return False
        return True

    def log(self, since: str | None = None) -> str:
        return self.run("log", f"{since}..HEAD" if since else "HEAD", "--reverse", "--date=iso-strict", f"--format={FORMAT}", "--name-only", "--no-color")


def read_log(source) -> tuple[str, str, str | None]:
    """(status, text, head): status is ok, absent, not_installed or timeout; a failure never raises."""
    try:
        head = source.head()
        return "ok", source.log(), head
    except FileNotFoundError:
        return "not_installed", "", None
    except subprocess.TimeoutExpired:
        return "timeout", "", None
    except subprocess.CalledProcessError:
        return "absent", "", None
