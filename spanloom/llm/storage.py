"""Shared storage for intermediate tables and binary files.

Everything that outlives a task goes below the folder that the session names
in ``spark.checkpoint.dir``; executors and driver all see it.  Tables are
written through Spark, binary files through ``pyarrow.fs`` (``file:``,
``hdfs:``, ``s3:`` and so on), each under a name no other attempt uses, so a
lost executor only costs the attempts it was running.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_dir, scratch, shared_root, written

__all__ = ["columns_of", "fresh_dir", "open_fs", "salted_join", "scratch", "shared_root", "shuffle_width", "sized", "spread_join", "unused", "where_text", "written"]


#: Rows up to which a table of two or three short columns is broadcast (some 10 MB).
BROADCAST_ROWS = 200_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, short rows of a written table, marked for broadcast if a count finds it small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def spread_join(rows: DataFrame, named: DataFrame, key: str, weigh: DataFrame) -> DataFrame:
    """``rows`` joined with ``named``, one row for each key, so that no key's rows meet in one task.

    A key is heavy if it has more than 1 / (4 * shuffle partitions) of the rows
    of ``weigh``, a written table with the keys of ``rows``; so there are at most
    that many, they are broadcast, and only the others are shuffled.  Null keys
    match nothing.
    """
    hot, named_hot, cold = _heavy(rows, named, key, weigh)
    if hot is None:
        return cold
    return rows.join(F.broadcast(hot.select(key)), key, "left_semi").join(F.broadcast(named_hot), key).unionByName(cold)


def salted_join(rows: DataFrame, named: DataFrame, key: str, weigh: DataFrame) -> DataFrame:
    """``spread_join`` for a ``named`` of long rows: heavy keys are not broadcast but dealt, by a hash of ``weigh``'s columns, to several tasks, each with a copy."""
    hot, named_hot, cold = _heavy(rows, named, key, weigh)
    if hot is None:
        return cold
    salt = unused("_salt", rows)
    dealt = rows.join(F.broadcast(hot), key).withColumn(salt, F.pmod(F.xxhash64(*weigh.columns), F.col("_parts")).cast("int")).drop("_parts")
    copies = named_hot.join(F.broadcast(hot), key).withColumn(salt, F.explode(F.expr("sequence(0, _parts - 1)"))).drop("_parts")
    return dealt.join(copies, [key, salt]).drop(salt).unionByName(cold)


def _heavy(rows: DataFrame, named: DataFrame, key: str, weigh: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """(heavy keys with the number of parts to deal them to, ``named`` of these, join of the others)."""
    spark, most, total = rows.sparkSession, 4 * shuffle_width(rows.sparkSession), weigh.count()
    least = max(total / most, 64)
    counts = weigh.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > least))
    heavy = [(r[0], -(-r[1] // int(least))) for r in counts.collect()] if total > 2000 else []
    if not heavy:
        return None, None, rows.join(named, key)
    hot = spark.createDataFrame(heavy, f"`{key}` {weigh.schema[key].dataType.simpleString()}, _parts int")
    of = F.col(key).isin([k for k, _ in heavy])
    return hot, named.where(of), rows.where(~of).join(named.where(~of), key)


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """``df``'s columns by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def where_text(docs: DataFrame, accept: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """The rows of ``docs`` whose text (null: empty) is accepted; same columns, whatever their names.

    ``accept`` is called once a task and gives the test of a text.
    """
    at = [c.lower() for c in docs.columns].index("text")
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok = accept()
        for batch in batches:
            yield batch.filter(pa.array([ok(v.as_py() or "") for v in batch.column(at)], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def open_fs(uri: str):
    """(filesystem, path) for a URI or a plain local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
