"""Extraction and resolution of sources on the driver's tables, each beside SQL that derives the same from the columns.

A brand of ``part`` is a source file in each language and its parts are the
file's members, a fixed number of lines each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bridge import Tables
from .operators import graph
from .operators.resolve import resolved
from .queries import _DISTINCT, _distinct_edges, query
from .sources import tree
from .sources.extract import FILE

_PARTS = """p as (select p_partkey as pk, p_name, p_size, cast(replace(p_brand, 'Brand#', '') as int) as n, row_number() over (partition by p_brand order by p_partkey) as r, count(*) over (partition by p_brand) as k from part),
b as (select distinct n, k from p)"""


def _sql(path: str, *symbols: tuple[str, str, str, str, str]) -> str:
    """SQL of symbols: (table, name, kind, first line, last line) of files named ``path``."""
    each = [f"select {path} as path, {name} as name, '{kind}' as kind, cast({a} as int) as start_line, cast({z} as int) as end_line from {table}" for table, name, kind, a, z in symbols]
    return f"with {_PARTS} {' union all '.join(each)}"


def _n() -> Column:
    return F.regexp_extract("p_brand", "([0-9]+)$", 1)


def _files(t: Tables, path: tuple, head: tuple, each: tuple, tail: tuple) -> DataFrame:
    """(path, content): for each brand ``n`` the head, a piece for each part in order of its key, and the tail."""
    text = lambda parts: F.concat(F.lit(""), *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    members = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), text(each).alias("x"))))
    whole = t.part.withColumn("n", _n()).groupBy("n").agg(F.array_join(F.transform(members, lambda m: m["x"]), "").alias("body"))
    files = whole.select(text(path).alias("path"), F.concat(text(head), "body", text(tail)).alias("content"))
    return files.repartition(4 * t.spark.sparkContext.defaultParallelism)  # files are few and long: a task has one or two


def _symbols(files: DataFrame) -> DataFrame:
    return tree.extracted(files).select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.kind", "s.start_line", "s.end_line")


def _raw_edges(files: DataFrame) -> DataFrame:
    return tree.extracted(files).select("path", F.explode("raw_edges").alias("e")).select("path", "e.src_name", "e.dst_name", "e.kind", "e.confidence")


def _python(t: Tables) -> DataFrame:
    """With a form feed and a line separator above, which end no line."""
    n, pk, size = F.col("n"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return _files(t, ("src/b", n, ".py"), ("# \u2028 and \x0c\nimport mod", n, "\nclass B", n, ":\n"), ("    def f", pk, "(self):\n        return g", size, "(self)\n"), ())


@query(_sql("'src/b' || n || '.py'", ("b", "'<file>'", "module", "1", "2 * k + 3"), ("b", "'B' || n", "class", "3", "2 * k + 3"), ("p", "'f' || pk", "method", "2 * r + 2", "2 * r + 3")))
def extract_python(t: Tables) -> DataFrame:
    return _symbols(_python(t))


@query(f"with {_PARTS} select 'src/b' || n || '.py' as path, '<file>' as src_name, 'mod' || n as dst_name, 'import' as kind, 'high' as confidence from b union all select 'src/b' || n || '.py', 'f' || pk, 'g' || p_size, 'call', 'low' from p")
def extract_python_edges(t: Tables) -> DataFrame:
    return _raw_edges(_python(t))


def _script(t: Tables) -> DataFrame:
    n, pk, size = F.col("n"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    head = ("import { x", n, " } from './b", n, "'\nexport interface I", n, " { f(x: string): void }\nexport abstract class B", n, "<T extends { x: { y: number } }> extends Base<{ a: 1 }> {\n")
    tail = ("  abstract w(a: string): void\n}\ndeclare function z(a: string): void\nfunction r", n, "(): { a: string } { return `${'}'}${deep", n, "({ b: 1 })}` }\n")
    return _files(t, ("src/b", n, ".ts"), head, ("  m", pk, "(a: { v: string }): Map<string, { b: number }> {\n    g", size, "(a)\n  }\n"), tail)


@query(_sql("'src/b' || n || '.ts'", ("b", "'<file>'", "module", "1", "3 * k + 7"), ("b", "'I' || n", "interface", "2", "2"), ("b", "'B' || n", "class", "3", "3 * k + 5"), ("p", "'m' || pk", "method", "3 * r + 1", "3 * r + 3"), ("b", "'r' || n", "function", "3 * k + 7", "3 * k + 7")))
def extract_script(t: Tables) -> DataFrame:
    return _symbols(_script(t))


@query(f"""with {_PARTS} select 'src/b' || n || '.ts' as path, '<file>' as src_name, unnest(['x' || n, './b' || n]) as dst_name, 'import' as kind, 'high' as confidence from b
union all select 'src/b' || n || '.ts', 'r' || n, 'deep' || n, 'call', 'low' from b union all select 'src/b' || n || '.ts', 'm' || pk, 'g' || p_size, 'call', 'low' from p""")
def extract_script_edges(t: Tables) -> DataFrame:
    return _raw_edges(_script(t))


def _decisions(t: Tables) -> DataFrame:
    n, pk = F.col("n"), F.col("p_partkey").cast("string")
    earlier = (n.cast("int") - 1).cast("string")
    return _files(t, ("docs/adr/", n, ".md"), ("# Brand ", n, "\n\nSupersedes ADR-", earlier, "\n\n## Decision\n"), ("### ", F.col("p_name"), " ", pk, "\ntext\n"), ("## After\nend",))


@query(_sql(
    "'docs/adr/' || n || '.md'", ("b", "'Brand ' || n", "heading", "1", "1"), ("b", "'Decision'", "heading", "5", "5"), ("b", "'After'", "heading", "2 * k + 6", "2 * k + 6"),
    ("p", "p_name || ' ' || pk", "heading", "2 * r + 4", "2 * r + 4"), ("b", "'Brand ' || n", "decision", "5", "2 * k + 5"),
))
def extract_markdown(t: Tables) -> DataFrame:
    return _symbols(_decisions(t))


@query(f"with {_PARTS} select 'docs/adr/' || n || '.md' as path, 'Brand ' || n as src_name, 'ADR-' || (n - 1) as dst_name, 'supersedes' as kind, 'low' as confidence from b")
def extract_markdown_edges(t: Tables) -> DataFrame:
    return _raw_edges(_decisions(t))


@query(_sql("'css/b' || n || '.css'", *(("p", f"'{sigil}' || pk", "selector", "r", "r") for sigil in (".p", "#i", "--v"))))
def extract_stylesheet(t: Tables) -> DataFrame:
    n, pk = F.col("n"), F.col("p_partkey").cast("string")
    return _symbols(_files(t, ("css/b", n, ".css"), (), (".p", pk, " #i", pk, " { --v", pk, ": url(img/.x", pk, ".png) }\n"), ()))


@query(_sql("'conf/b' || n || '.json'", ("b", "'b' || n", "heading", "1", "k + 2"), ("p", "'b' || n || '.k' || pk", "heading", "r + 1", "r + 1"), ("b", "'b' || n || '.z'", "heading", "k + 2", "k + 2"), ("b", "'list'", "heading", "k + 2", "k + 2")))
def extract_json(t: Tables) -> DataFrame:
    n, pk, size = F.col("n"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return _symbols(_files(t, ("conf/b", n, ".json"), ('{"b', n, '": {\n'), (' "k', pk, '": {"deep": {"x": ', size, "}},\n"), (' "z": 0}, "list": [{"no": 1}]}\n',)))


@query(_sql("'conf/b' || n || '.yaml'", ("b", "'b' || n", "heading", "1", "2 * k + 1"), ("p", "'b' || n || '.k' || pk", "heading", "2 * r", "2 * r + 1"), ("b", "'list'", "heading", "2 * k + 2", "2 * k + 3"), ("b", "'last'", "heading", "2 * k + 5", "2 * k + 5")))
def extract_yaml(t: Tables) -> DataFrame:
    """With an alias of nothing in the last document, so that the files are read by indentation."""
    n, pk, size = F.col("n"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return _symbols(_files(t, ("conf/b", n, ".yaml"), ("b", n, ":\n"), ("  k", pk, ":\n    deep: ", size, "\n"), ("list:\n  - no: 1\n---\nlast: *nope\n",)))


def _graphql(t: Tables) -> DataFrame:
    n, pk, size = F.col("n"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return _files(t, ("api/b", n, ".graphql"), ("type B", n, " implements Node {\n"), ("  f", pk, "(a: Int = ", size, "): [ID!]! @d\n"), ("}\nquery Q", n, " { b", n, " { id } }\n"))


@query(_sql("'api/b' || n || '.graphql'", ("b", "'<file>'", "module", "1", "k + 3"), ("b", "'B' || n", "type", "1", "k + 2"), ("p", "'B' || n || '.f' || pk", "method", "r + 1", "r + 1"), ("b", "'Q' || n", "function", "k + 3", "k + 3")))
def extract_graphql(t: Tables) -> DataFrame:
    return _symbols(_graphql(t))


@query(f"""with {_PARTS} select 'api/b' || n || '.graphql' as path, 'B' || n as src_name, 'Node' as dst_name, 'import' as kind, 'high' as confidence from b
union all select 'api/b' || n || '.graphql', 'Q' || n, 'Query.b' || n, 'call', 'low' from b""")
def extract_graphql_edges(t: Tables) -> DataFrame:
    return _raw_edges(_graphql(t))


# -- resolution ---------------------------------------------------------------------------------

#: parts as symbols of Python files, some of them decisions, and a file symbol each.
_CODE = """code as (select p_partkey as symbol_id, 'src/b' || replace(p_brand, 'Brand#', '') || '.py' as path, p_partkey + 1 as ord, case when p_size = 49 then 'ADR-' || p_partkey else p_name end as name,
    case when p_size >= 49 then 'decision' else 'function' end as kind from part
  union all select distinct -cast(replace(p_brand, 'Brand#', '') as bigint), 'src/b' || replace(p_brand, 'Brand#', '') || '.py', 0, '<file>', 'module' from part),
s as (select *, lower(name) as name_lc from code)"""
#: lineitem as raw edges: calls, imports (three ways to write them, some of nothing) and supersessions.
_RAW = """raw as (select 'src/b' || (l_orderkey % 25 + 1) || '.py' as path, l_orderkey * 10 + l_linenumber as ord, case when l_linenumber % 3 = 0 then '<file>' else a.p_name end as src_name,
  case l_returnflag when 'A' then b.p_name when 'N' then case l_linenumber % 3 when 0 then './b' || (l_suppkey % 30 + 1) when 1 then 'src/b' || (l_suppkey % 30 + 1) || '.py' else 'b' || (l_suppkey % 30 + 1) end
    else case when l_linenumber % 2 = 0 then cast(l_partkey as varchar) else upper(b.p_name) end end as dst_name,
  case l_returnflag when 'A' then 'call' when 'N' then 'import' else 'supersedes' end as kind
  from lineitem join part a on a.p_partkey = l_partkey join part b on b.p_partkey = l_suppkey)"""


def _code(t: Tables) -> DataFrame:
    path = F.concat(F.lit("src/b"), _n(), F.lit(".py"))
    parts = t.part.select(
        F.col("p_partkey").alias("symbol_id"), path.alias("path"), (F.col("p_partkey") + 1).alias("ord"),
        F.when(F.col("p_size") == 49, F.concat(F.lit("ADR-"), "p_partkey")).otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") >= 49, "decision").otherwise("function").alias("kind"),
    )
    modules = t.part.select((-_n().cast("long")).alias("symbol_id"), path.alias("path"), F.lit(0).cast("long").alias("ord"), F.lit(FILE).alias("name"), F.lit("module").alias("kind")).distinct()
    return parts.unionByName(modules).withColumn("name_lc", F.lower("name"))


def _raw(t: Tables) -> DataFrame:
    a, b = (t.part.select(F.col("p_partkey").alias(k), F.col("p_name").alias(f"{k}_name")) for k in ("l_partkey", "l_suppkey"))
    flag, line, to = F.col("l_returnflag"), F.col("l_linenumber"), (F.col("l_suppkey") % 30 + 1).cast("string")
    spec = F.when(line % 3 == 0, F.concat(F.lit("./b"), to)).when(line % 3 == 1, F.concat(F.lit("src/b"), to, F.lit(".py"))).otherwise(F.concat(F.lit("b"), to))
    older = F.when(line % 2 == 0, F.col("l_partkey").cast("string")).otherwise(F.upper("l_suppkey_name"))
    return t.lineitem.join(a, "l_partkey").join(b, "l_suppkey").select(
        F.concat(F.lit("src/b"), (F.col("l_orderkey") % 25 + 1).cast("string"), F.lit(".py")).alias("path"), (F.col("l_orderkey") * 10 + line).alias("ord"),
        F.when(line % 3 == 0, FILE).otherwise(F.col("l_partkey_name")).alias("src_name"), F.when(flag == "A", F.col("l_suppkey_name")).when(flag == "N", spec).otherwise(older).alias("dst_name"),
        F.when(flag == "A", "call").when(flag == "N", "import").otherwise("supersedes").alias("kind"),
    )


@query(f"""with {_CODE}, {_RAW},
own as (select path, name, arg_min(symbol_id, ord) as id from s group by path, name), anywhere as (select name_lc, arg_min(symbol_id, (path, ord)) as id from s group by name_lc),
inside as (select path, name_lc, arg_min(symbol_id, ord) as id from s group by path, name_lc), decisions as (select name_lc, arg_min(symbol_id, (path, ord)) as id from s where kind = 'decision' group by name_lc),
e as (select raw.*, coalesce(o.id, f.id) as src from raw left join own o on o.path = raw.path and o.name = src_name left join own f on f.path = raw.path and f.name = '<file>' where coalesce(o.id, f.id) is not null),
specs as (select distinct path, dst_name as spec from raw where kind = 'import'),
modules as (select specs.path, spec, m.symbol_id as id, m.path as at from specs join s m on m.kind = 'module' and m.path = 'src/' || regexp_extract(spec, '(b[0-9]+)(\\.py)?$', 1) || '.py'),
through as (select w.path, w.dst_name, arg_min(i.id, (case when contains(spec, '/') then 0 else 1 end, spec)) as id from (select distinct path, dst_name from e where kind = 'call') w join modules m on m.path = w.path join inside i on i.path = m.at and i.name_lc = lower(w.dst_name) group by w.path, w.dst_name),
calls as (select src, coalesce(l.id, t.id, g.id) as dst, 'call' as kind, case when coalesce(l.id, t.id) is null then 'low' else 'high' end as confidence
  from e left join own l on l.path = e.path and l.name = e.dst_name left join through t on t.path = e.path and t.dst_name = e.dst_name left join anywhere g on g.name_lc = lower(e.dst_name) where e.kind = 'call'),
imports as (select src, m.id as dst, 'import' as kind, 'high' as confidence from e join modules m on m.path = e.path and m.spec = e.dst_name where e.kind = 'import'),
olds as (select src, d.id as dst, 'supersedes' as kind, 'high' as confidence from e join decisions d on d.name_lc = case when regexp_full_match(dst_name, '[0-9]+') then 'adr-' || dst_name else lower(dst_name) end where e.kind = 'supersedes')
select distinct * from (select * from calls union all select * from imports union all select * from olds) where dst is not null""")
def resolve_edges(t: Tables) -> DataFrame:
    return resolved(_raw(t), _code(t)).select("src", "dst", "kind", "confidence")


@query(f"""with {_CODE}, edges as (select l_partkey as src, l_suppkey as dst, l_returnflag as kind, case when l_linestatus = 'F' then 'high' else 'low' end as confidence, l_orderkey * 10 + l_linenumber as ord from lineitem), {_DISTINCT}
select e.src, e.dst, e.kind, a.name as src_name, b.name as dst_name, a.path as src_path, b.path as dst_path
from e join s a on a.symbol_id = e.src join s b on b.symbol_id = e.dst where b.path in ('src/b1.py', 'src/b12.py') and a.path <> b.path""")
def incoming_edges(t: Tables) -> DataFrame:
    found = graph.incoming(_distinct_edges(t), _code(t), F.col("dst_path").isin("src/b1.py", "src/b12.py"))
    return found.select("src", "dst", "kind", "src_name", "dst_name", "src_path", "dst_path")
