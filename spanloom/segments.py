"""Tables as immutable segments: what changed is written beside what was there, and merged when read.

A segment holds the rows of some keys (paths of files, hashes of commits) and
a table ``gone`` of keys whose rows in older segments count no more: replaced
ones and deleted ones.  A row is alive if no later segment names its key, so a
read is one union and one anti-join with the keys gone, which are few: segments
of like size are merged, a new one with all before it that are not twice its
size.  Their number stays logarithmic, and a row is rewritten as often.

Nothing is changed in place; a list of segments is a state, and the states of
readers stay whole until the build after the one that replaced them.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keys gone up to which they are broadcast; more are joined by shuffles.
BROADCAST_GONE = 500_000
#: Keys for each bucket that a table's rows are dealt to.
KEYS_A_BUCKET = 5000
MOST_BUCKETS = 4096
#: Distinct lookup keys up to which buckets are picked one by one.
FEW_KEYS = 20_000


@dataclass(frozen=True)
class Table:
    """A table of every segment: its columns, the key that ``gone`` names, and the column that its buckets are by.

    A table without a key is a set: its rows stay, and are once in a segment.
    """

    ddl: str
    key: str
    by: str
    #: Whether rows go only where a whole key is replaced, not where just this table's rows are.
    kind: str = "all"
    #: Kept in ranges of this column instead of buckets.
    sorted_by: str | None = None
    #: Made of another table of its segment, and anew when segments are merged.
    of: tuple[str, Callable[[DataFrame], DataFrame]] | None = None


@dataclass(frozen=True)
class Segment:
    name: str
    #: Keys written and keys gone: how much it weighs.
    size: int
    gone: int
    buckets: int = 1


@dataclass(frozen=True)
class Segments:
    """A state: segments from the oldest to the newest."""

    spark: SparkSession
    folder: str
    tables: dict[str, Table]
    listed: tuple[Segment, ...] = ()
    retired: tuple[str, ...] = field(default=())

    def _path(self, segment: Segment, table: str) -> str:
        return f"{self.folder}/{segment.name}/{table}"

    def read(self, name: str, keys: DataFrame | None = None, marked: bool = False) -> DataFrame:
        """A table's rows that are alive; ``keys``: only those of these values (column named as the table's ``by``).

        ``marked``: also those that are not, with the columns _segment and _alive.
        """
        table = self.tables[name]
        schema = StructType.fromDDL(table.ddl)
        parts = None
        picked = self._buckets(table, keys) if keys is not None and table.sorted_by is None else None
        for k, segment in enumerate(self.listed):
            part = self.spark.read.schema(table.ddl + ("" if table.sorted_by else ", _bucket int")).parquet(self._path(segment, name))
            if picked is not None:
                part = part.where(F.col("_bucket").isin(picked[segment.buckets]))
            part = part.select(*schema.names, F.lit(k).alias("_segment"))
            parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return self.spark.createDataFrame([], schema if not marked else StructType.fromDDL(f"{table.ddl}, _segment int, _alive boolean"))
        if keys is not None:
            parts = parts.join(keys.select(table.by), table.by, "left_semi")
        gone = self._gone(table) if table.key else None
        if marked:
            if gone is None:
                return parts.withColumn("_alive", F.lit(True))
            dead = parts.join(gone.withColumnRenamed("_gone", table.key), table.key, "left")
            return dead.withColumn("_alive", F.col("_since").isNull() | (F.col("_segment") >= F.col("_since"))).select(*schema.names, "_segment", "_alive")
        if gone is not None:
            parts = parts.join(gone, (F.col(table.key) == F.col("_gone")) & (F.col("_segment") < F.col("_since")), "left_anti")
        return parts.select(*schema.names)

    def _gone(self, table: Table) -> DataFrame | None:
        later = [(k, s) for k, s in enumerate(self.listed) if s.gone and k]
        if not later:
            return None
        out = None
        for k, s in later:
            part = self.spark.read.schema("key string, what string").parquet(self._path(s, "gone")).select("key", "what", F.lit(k).alias("_since"))
            out = part if out is None else out.unionByName(part)
        out = out.where(F.col("what").isin("all", table.kind)).groupBy(F.col("key").alias("_gone")).agg(F.max("_since").alias("_since"))
        return F.broadcast(out) if sum(s.gone for _, s in later) <= BROADCAST_GONE else out

    def _buckets(self, table: Table, keys: DataFrame) -> dict[int, list[int]] | None:
        """For each number of buckets those that hold any of ``keys``, if these are few."""
        counts = sorted({s.buckets for s in self.listed})
        if counts in ([], [1]):
            return {1: [0]}
        hashes = [r[0] for r in keys.select(F.xxhash64(table.by)).distinct().limit(FEW_KEYS + 1).collect()]
        return {n: sorted({h % n for h in hashes}) for n in counts} if len(hashes) <= FEW_KEYS else None

    def write(self, tables: dict[str, DataFrame], gone: DataFrame | None, size: int, n_gone: int) -> Segment:
        """A new segment of these tables, and of those made of them; it is not listed yet."""
        tables = tables | {n: t.of[1](tables[t.of[0]]) for n, t in self.tables.items() if t.of}
        segment = Segment(f"segment-{uuid.uuid4().hex}", size + n_gone, n_gone, min(MOST_BUCKETS, max(1, size // KEYS_A_BUCKET)))
        jobs = [lambda n=n, df=df: self._write_table(segment, n, df) for n, df in tables.items()]
        if n_gone:
            jobs.append(lambda: gone.select("key", "what").coalesce(1).write.parquet(self._path(segment, "gone")))
        with ThreadPoolExecutor(4) as pool:
            for f in [pool.submit(j) for j in jobs]:
                f.result()
        return segment

    def _write_table(self, segment: Segment, name: str, rows: DataFrame) -> None:
        table = self.tables[name]
        rows = rows.select(*StructType.fromDDL(table.ddl).names)
        if table.sorted_by:
            order = [table.sorted_by, *([table.key] if table.key else [])]
            rows = rows if table.key else rows.distinct()
            dealt = rows.repartitionByRange(*order) if segment.buckets > 1 else rows.repartition(1)
            dealt.sortWithinPartitions(*order).write.parquet(self._path(segment, name))
        else:
            dealt = rows.withColumn("_bucket", bucket_of(table.by, segment.buckets))
            dealt = dealt.repartition("_bucket") if segment.buckets > 1 else dealt.repartition(1)
            dealt.sortWithinPartitions("_bucket", table.by).write.partitionBy("_bucket").parquet(self._path(segment, name))

    def with_segment(self, segment: Segment) -> Segments:
        """The state with a new segment, merged with those before it that are not twice the size of what follows them."""
        listed = [*self.listed, segment]
        first, size = len(listed) - 1, segment.size
        while first and listed[first - 1].size < 2 * size:
            first -= 1
            size += listed[first].size
        out = replace(self, listed=tuple(listed))
        return out if first == len(listed) - 1 else out._merged(first)

    def _merged(self, first: int) -> Segments:
        some = replace(self, listed=self.listed[first:])
        keys = sum(s.size for s in some.listed)
        tables = {n: some.read(n) for n, t in self.tables.items() if not t.of}
        gone, n = None, 0
        if first:  # older segments still have rows of these keys
            for s in some.listed:
                if s.gone:
                    part = self.spark.read.schema("key string, what string").parquet(self._path(s, "gone"))
                    gone = part if gone is None else gone.unionByName(part)
            if gone is not None:
                gone = gone.groupBy("key").agg(F.when(F.max(F.col("what") == "all"), "all").otherwise(F.min("what")).alias("what"))
                n = gone.count()
        written = self.write(tables, gone, max(0, keys - sum(s.gone for s in some.listed)), n)
        return replace(self, listed=(*self.listed[:first], written), retired=(*self.retired, *(s.name for s in some.listed)))

    def as_json(self) -> list[dict]:
        return [{"name": s.name, "size": s.size, "gone": s.gone, "buckets": s.buckets} for s in self.listed]


def bucket_of(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def listed(spark: SparkSession, folder: str | Path, tables: dict[str, Table], known: list[dict]) -> Segments:
    return Segments(spark, str(folder), tables, tuple(Segment(**s) for s in known))


def drop(folder: str | Path, names: list[str]) -> None:
    for n in names:
        shutil.rmtree(Path(folder) / n, ignore_errors=True)
