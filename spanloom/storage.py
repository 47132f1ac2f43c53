"""Intermediate tables in the folder that the session's driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder; a private one is set only where none is and all executors run in this machine's one JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="spanloom-")).as_uri()
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_scratch: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{_scratch[-1] if _scratch else shared_root(spark) + '/spanloom'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates made inside are deleted at the end: for steps whose result is complete elsewhere by then."""
    folder = fresh_dir(spark, "scratch")
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, read it back."""
    return saved(df, fresh_dir(df.sparkSession, name))


def saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*jobs: Callable) -> list:
    """The results of jobs that do not need each other; Spark runs them side by side."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]
