"""A table of files, or a whole index, kept up to date from a stream of changes.

State is keyed by path and the last writer wins, so neither watermarks nor
windows are needed: each micro-batch is reduced to the last change of a path
and merged into the next snapshot.  A batch that is run again after a failure
gives the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import api
from ..functions.text import content_hash, language
from ..operators import mutate

CHANGES = "path string, content string, deleted boolean, at timestamp"


def last_of(changes: DataFrame) -> DataFrame:
    """The last change of each path; of those at one time a deletion, or else one that is the same on every run."""
    return mutate.first_of(changes, ["path"], [F.desc("at"), F.desc("deleted"), F.desc(content_hash(F.col("content")))])


def merge_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``files`` (path, language, hash, size) after ``changes``; an unchanged content leaves its row as it is."""
    last = last_of(changes)
    new = last.where("not deleted").select("path", language(F.col("path")).alias("language"), content_hash(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"))
    kept = files.join(last.where("deleted").select("path"), "path", "left_anti")
    changed = new.join(files.select("path", "hash"), ["path", "hash"], "left_anti")
    return mutate.upsert(kept, changed.select(files.columns), "path")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Read change files (JSON lines) from ``folder`` and write the snapshot of each batch as ``out/batch=<n>``."""

    def apply(batch: DataFrame, n: int) -> None:
        earlier = sorted(int(p) for p in _batches(spark, out) if int(p) < n)
        files = spark.read.parquet(f"{out}/batch={earlier[-1]}") if earlier else spark.createDataFrame([], "path string, language string, hash string, size long")
        merge_changes(files, batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema(CHANGES).json(folder)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def follow_index(spark: SparkSession, folder: str, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Read change files (JSON lines) from ``folder`` and keep the index of ``root`` up to date: files, symbols, edges and postings.

    A batch becomes a segment, so it costs what it changes; one that is run
    again after a failure is applied once.
    """
    api.init(root)

    def apply(batch: DataFrame, n: int) -> None:
        api.apply_changes(spark, root, last_of(batch), (checkpoint, n))

    writer = spark.readStream.schema(CHANGES).json(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batches(spark: SparkSession, out: str) -> list[str]:
    """Numbers of the batches that are there."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName().split("=")[1] for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")] if fs.exists(path) else []
