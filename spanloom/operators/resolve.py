"""Raw edges to edges between symbols, by cascades of equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem
from ..sources.extract.base import FILE
from .mutate import first_of


def without_ending(path: Column) -> Column:
    """A path without its file's last ending."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def relative(from_path: Column, spec: Column) -> Column:
    """``spec`` seen from the folder of ``from_path``; null if it does not begin with a dot."""
    folder = F.filter(F.slice(F.split(from_path, "/"), F.lit(1), F.size(F.split(from_path, "/")) - 1), lambda x: x != "")
    step = lambda a, x: F.when(x.isin(".", ""), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    return F.when(F.startswith(spec, F.lit(".")), F.array_join(F.aggregate(F.split(spec, "/"), folder, step), "/"))


def _first(df: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """(keys, id, at): the first (or last) symbol of each key, by path and order."""
    order = F.struct("path", "ord")
    pick = (F.max_by if last else F.min_by)(F.struct("symbol_id", "path"), order)
    return df.groupBy(*keys).agg(pick.alias("_p")).select(*keys, F.col("_p.symbol_id").alias("id"), F.col("_p.path").alias("at"))


def _is_file() -> Column:
    return (F.col("name") == FILE) & (F.col("kind") == "module")


def _stem_of(spec: Column) -> Column:
    return F.coalesce(F.nullif(stem(spec), F.lit("")), spec)


def _modules_of(specs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, spec, id, at): the file symbol that an import means: by relative path, by path, by stem."""
    modules = symbols.where(_is_file())
    exact = modules.select(F.col("path").alias("_k"), "symbol_id", "path", "ord")
    bare = modules.select(without_ending(F.col("path")).alias("_k"), "symbol_id", "path", "ord")
    stems = modules.select(stem(F.col("path")).alias("_k"), "symbol_id", "path", "ord")
    tries = [("_rel", exact), ("_rel", bare), ("spec", exact), ("spec", bare), ("_stem", stems)]
    out = specs.withColumn("_rel", relative(F.col("path"), F.col("spec"))).withColumn("_stem", _stem_of(F.col("spec")))
    ids, ats = [], []
    for k, (on, table) in enumerate(tries):
        t = _first(table, ["_k"], last=True).select(F.col("_k").alias(on), F.col("id").alias(f"_id{k}"), F.col("at").alias(f"_at{k}"))
        out = out.join(t, on, "left")
        ids.append(F.col(f"_id{k}"))
        ats.append(F.col(f"_at{k}"))
    return out.select("path", "spec", F.coalesce(*ids).alias("id"), F.coalesce(*ats).alias("at")).where("id is not null")


def resolved(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (path, src, dst, kind, confidence, ord) of raw edges (path, ord, src_name, dst_name, kind); of equal ones the first.

    Calls: a symbol of the file, then of a file it imports, then any of the
    name (which is less sure).  Imports: a module, a symbol of the file, any of
    the name.  Supersedes: a decision of the name, digits also as ``ADR-<n>``.
    Symbols that no raw edge can mean may be left out (see ``reference_keys``).
    """
    local = _first(symbols, ["path", "name"]).select("path", "name", "id")
    by_name = _first(symbols.where(~_is_file()), ["name_lc"])
    src = local.select("path", F.col("name").alias("src_name"), F.col("id").alias("_own"))
    files = local.where(F.col("name") == FILE).select("path", F.col("id").alias("_file"))
    e = raw.join(src, ["path", "src_name"], "left").join(files, "path", "left").withColumn("src", F.coalesce("_own", "_file")).where("src is not null").drop("_own", "_file").withColumn("name_lc", F.lower("dst_name"))

    specs = raw.where("kind = 'import'").select("path", F.col("dst_name").alias("spec")).distinct()
    modules = _modules_of(specs, symbols)
    here = local.select("path", F.col("name").alias("dst_name"), F.col("id").alias("_local"))
    anywhere = by_name.select("name_lc", F.col("id").alias("_global"))

    calls = e.where("kind = 'call'").join(here, ["path", "dst_name"], "left").join(anywhere, "name_lc", "left")
    order = [F.when(F.col("spec").rlike("^[./]|/"), 0).otherwise(1), "spec"]
    inside = _first(symbols, ["path", "name_lc"]).select(F.col("path").alias("at"), "name_lc", F.col("id").alias("_there"))
    wanted = calls.where("_local is null").select("path", "name_lc", "dst_name").distinct()
    via = first_of(modules.join(wanted, "path").where("spec <> dst_name").join(inside, ["at", "name_lc"]), ["path", "dst_name"], order).select("path", "dst_name", "_there")
    calls = calls.join(via, ["path", "dst_name"], "left").withColumn("dst", F.coalesce("_local", "_there", "_global"))
    calls = calls.withColumn("confidence", F.when(F.coalesce("_local", "_there").isNotNull(), "high").otherwise("low"))

    to = modules.select("path", F.col("spec").alias("dst_name"), F.col("id").alias("_module"))
    imports = e.where("kind = 'import'").join(to, ["path", "dst_name"], "left").join(here, ["path", "dst_name"], "left").join(anywhere, "name_lc", "left")
    imports = imports.withColumn("dst", F.coalesce("_module", "_local", "_global")).withColumn("confidence", F.lit("high"))

    decisions = _first(symbols.where("kind = 'decision'"), ["name_lc"])
    named, numbered = decisions.select("name_lc", F.col("id").alias("_named")), decisions.select(F.col("name_lc").alias("_adr"), F.col("id").alias("_numbered"))
    olds = e.where("kind = 'supersedes'").withColumn("_adr", F.when(F.col("dst_name").rlike("^[0-9]+$"), F.concat(F.lit("adr-"), "dst_name")))
    olds = olds.join(named, "name_lc", "left").join(numbered, "_adr", "left").withColumn("dst", F.coalesce("_named", "_numbered")).withColumn("confidence", F.lit("high"))

    columns = ["path", "ord", "src", "dst", "kind", "confidence"]
    found = calls.select(columns).unionByName(imports.select(columns)).unionByName(olds.select(columns)).where("dst is not null")
    kept = first_of(found, ["src", "dst", "kind"], ["path", "ord"])
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy("path", "ord", "dst"))).select("path", "src", "dst", "kind", "confidence", "ord")


def definition_keys(symbols: DataFrame) -> DataFrame:
    """``symbols`` under every key that a raw edge can ask for them by: their name, or for the symbol of a file its paths and its stem."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    path = F.col("path")
    keys = F.when(_is_file(), F.array_distinct(F.array(key("p", path), key("p", without_ending(path)), key("s", stem(path))))).otherwise(F.array(key("n", F.col("name_lc"))))
    return symbols.select(F.explode(keys).alias("key"), "symbol_id", "path", "ord", "name", "name_lc", "kind")


def reference_keys(raw: DataFrame) -> DataFrame:
    """(key, path) of all that the raw edges of a file ask for, as ``definition_keys`` names it."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    spec = F.col("dst_name")
    modules = F.when(F.col("kind") == "import", F.array(key("p", relative(F.col("path"), spec)), key("p", spec), key("s", _stem_of(spec))))
    numbered = F.when((F.col("kind") == "supersedes") & spec.rlike("^[0-9]+$"), F.array(key("n", F.concat(F.lit("adr-"), spec))))
    none = F.array().cast("array<string>")
    keys = F.concat(F.array(key("n", F.lower(spec))), F.coalesce(modules, none), F.coalesce(numbered, none))
    return raw.select(F.explode(F.array_compact(keys)).alias("key"), "path")


__all__ = ["definition_keys", "reference_keys", "relative", "resolved", "without_ending"]
