"""The star-schema tables seen as the engine's own relations, in Spark and as SQL views of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import content_hash

#: File endings that documents get, by doc_id, so that every skip and language rule has cases.
ENDINGS = [".md", ".py", ".ts", ".min.js", ".json", ".pem", ".txt", ".YAML", ".png", ".css", ".tsx", ".graphql", ""]
NAMES = ["credentials.json", ".env", "yarn.lock", "a.env"]
CUT = "2024-01-16 00:00:00"


class Tables:
    """Driver tables by name, and the relations made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def files(self) -> DataFrame:
        """documents as path, content, hash, size."""
        ending = F.element_at(F.lit(ENDINGS), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
        name = F.when(F.col("doc_id") % 29 == 0, F.concat(F.element_at(F.lit(NAMES), (F.floor(F.col("doc_id") / 29) % len(NAMES) + 1).cast("int")))).otherwise(F.concat(F.lit("d"), "doc_id", ending))
        folder = F.when(F.col("doc_id") % 31 == 0, F.lit("node_modules/")).otherwise(F.lit(""))
        path = F.concat("source", F.lit("/"), folder, "doc_id", F.lit("/"), name)
        content = F.when(F.col("doc_id") % 37 == 0, F.concat("text", F.lit(" AKIA"), F.lit("ABCDEFGH12345678"))).otherwise(F.col("text"))
        return self.documents.select("doc_id", path.alias("path"), content.alias("content")).withColumn("hash", content_hash(F.col("content"))).withColumn("size", F.octet_length("content").cast("long"))

    def symbols(self) -> DataFrame:
        """part as symbols: a brand is a file, a type a kind."""
        return self.part.select(
            F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.lower("p_name").alias("name_lc"),
            F.col("p_type").alias("kind"), F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 7).cast("int").alias("end_line"),
        )

    def edges(self) -> DataFrame:
        """lineitem as raw edges between symbols, in the order of its keys."""
        return self.lineitem.select(
            F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"),
            F.when(F.col("l_linestatus") == "F", "high").otherwise("low").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        )

    def snapshot(self, before: str | None = None) -> DataFrame:
        """events as the last state of each user and type: path, hash, value."""
        rows = self.events if before is None else self.events.where(F.col("ts") < F.lit(before).cast("timestamp"))
        last = rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("props", "value"), F.struct("ts", "event_id")).alias("s"))
        path = F.concat(F.lit("user/"), "user_id", F.lit("/"), "event_type")
        return last.select(path.alias("path"), F.sha2(F.col("s.props"), 256).alias("hash"), F.col("s.value").alias("value"))

    def commits(self) -> DataFrame:
        """orders as commits: subject and body are made of their columns."""
        return self.orders.select(
            F.col("o_orderkey").alias("ord"), F.format_string("c%07d", "o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("authored_at"),
            F.concat("o_orderpriority", F.lit(" change of "), "o_orderkey").alias("subject"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("status "), "o_orderstatus")).alias("body"),
        )


FILES = f"""files as (
  select *, sha256(content) as hash, cast(strlen(content) as bigint) as size from (
    select doc_id,
      source || '/' || case when doc_id % 31 = 0 then 'node_modules/' else '' end || doc_id || '/' ||
      case when doc_id % 29 = 0 then ({NAMES!r})[(doc_id // 29) % {len(NAMES)} + 1] else 'd' || doc_id || ({ENDINGS!r})[doc_id % {len(ENDINGS)} + 1] end as path,
      case when doc_id % 37 = 0 then text || ' AKIA' || 'ABCDEFGH12345678' else text end as content
    from documents))"""
SYMBOLS = """symbols as (select p_partkey as symbol_id, p_brand as path, p_partkey as ord, p_name as name, lower(p_name) as name_lc, p_type as kind,
  p_size as start_line, cast(p_size + p_partkey % 7 as int) as end_line from part)"""
EDGES = """edges as (select l_partkey as src, l_suppkey as dst, l_returnflag as kind, case when l_linestatus = 'F' then 'high' else 'low' end as confidence,
  l_orderkey * 10 + l_linenumber as ord from lineitem)"""
COMMITS = """commits as (select o_orderkey as ord, 'c' || lpad(cast(o_orderkey as varchar), 7, '0') as sha, o_custkey as author, o_orderdate as authored_at,
  o_orderpriority || ' change of ' || o_orderkey as subject, case when o_orderstatus = 'P' then '' else 'status ' || o_orderstatus end as body from orders)"""


def snapshot_sql(name: str, before: str | None = None) -> str:
    cut = f"where ts < timestamp '{before}'" if before else ""
    return f"""{name} as (select 'user/' || user_id || '/' || event_type as path, sha256(props) as hash, value from
      (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events {cut}) where n = 1)"""
