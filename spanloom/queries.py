"""The engine's operators on the driver's tables, each beside SQL that says the same independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bridge import COMMITS, CUT, EDGES, FILES, SYMBOLS, Tables, snapshot_sql
from .functions import text as T
from .operators import fulltext, graph, lookup, mutate, pack, rank
from .plans import context, packages
from .plans.query_plan import ladder
from .storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        SQL[f.__name__] = sql
        return f

    return register


def rows(t: Tables, ddl: str, values: list[tuple]) -> DataFrame:
    return fulltext.local(t.spark, ddl, values)


def values_sql(name: str, columns: str, values: list[tuple]) -> str:
    return f"{name}({columns}) as (values {', '.join(map(repr, values))})"


# -- scanning and snapshots ---------------------------------------------------------------------

_SKIP_SQL = f"""case
  when list_has_any(string_split(path, '/'), {T.SKIP_DIRS!r}) then 'ignore'
  when name in ('.env', 'id_rsa', 'credentials.json') or name like '.env.%' or lower(name) like '%.pem' or lower(name) like '%.key' then 'secret_name'
  when name in {tuple(T.LOCKFILES)!r} or name like '%.min.js' or name like '%.map' or (contains(name, '.') and string_split(name, '.')[-1] in {tuple(T.NOISE_ENDINGS)!r}) then 'ignore'
  when contains(content, chr(0)) then 'binary' when size > 1048576 then 'large'
  when regexp_matches(content, '{T.SECRET_CONTENT}') then 'secret_content' else 'keep' end"""
_LANGUAGE_SQL = "case " + " ".join(f"when regexp_matches(lower(path), '\\.({'|'.join(e)})$') then '{tag}'" for tag, e in T.LANGUAGES.items()) + " end"


@query(f"with {FILES}, f as (select *, string_split(path, '/')[-1] as name from files) select path, {_SKIP_SQL} as skip_kind, {_LANGUAGE_SQL} as language, size, hash from f")
def scan_skip_chain(t: Tables) -> DataFrame:
    return t.files().select("path", T.skip_kind(F.col("path"), F.col("content"), F.col("size")).alias("skip_kind"), T.language(F.col("path")).alias("language"), "size", "hash")


@query(f"with {FILES}, f as (select *, string_split(path, '/')[-1] as name from files) select {_SKIP_SQL} as skip_kind, count(*) as n, sum(size) as bytes from f group by 1")
def skip_counters(t: Tables) -> DataFrame:
    kind = T.skip_kind(F.col("path"), F.col("content"), F.col("size"))
    return t.files().groupBy(kind.alias("skip_kind")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"""with {snapshot_sql("old", CUT)}, {snapshot_sql("new")}
select path, case when old.hash is null then 'added' when new.hash is null then 'deleted' when old.hash = new.hash then 'unchanged' else 'changed' end as status
from old full join new using (path)""")
def hash_diff(t: Tables) -> DataFrame:
    return mutate.hash_diff(t.snapshot(CUT), t.snapshot())


@query(f"""with {snapshot_sql("old", CUT)}, {snapshot_sql("new")}, changed as (select new.* from new left join old using (path) where old.hash is distinct from new.hash)
select * from changed union all select * from old where path not in (select path from changed)""")
def upsert_merge(t: Tables) -> DataFrame:
    old, new = t.snapshot(CUT), t.snapshot()
    changed = mutate.hash_diff(old, new).where("status in ('added', 'changed')")
    return mutate.upsert(old, new.join(changed, "path", "left_semi"), "path")


@query(f"""with {snapshot_sql("old", CUT)}, seen as (select distinct 'user/' || user_id || '/' || event_type as path from events where ts >= timestamp '{CUT}')
select * from old where not (starts_with(path, 'user/1') and path not in (select path from seen))""")
def prefix_scoped_delete(t: Tables) -> DataFrame:
    seen = t.events.where(F.col("ts") >= F.lit(CUT).cast("timestamp")).select(F.concat(F.lit("user/"), "user_id", F.lit("/"), "event_type").alias("path")).distinct()
    old = t.snapshot(CUT)
    gone = mutate.scoped_diff(old, seen.withColumn("hash", F.lit("")), "user/1").where("status = 'deleted'").select("path")
    return mutate.replace_payload(old, gone, old.limit(0))


@query(f"with {EDGES} select src, dst, kind, arg_min(confidence, ord) as confidence, min(ord) as ord from edges group by src, dst, kind")
def insert_or_ignore(t: Tables) -> DataFrame:
    e = t.edges()
    return mutate.insert_or_ignore(e.limit(0), e, ["src", "dst", "kind"], ["ord"])


@query(f"""with {EDGES}, known as (select src, dst, kind, confidence, ord from edges where confidence = 'high' qualify row_number() over (partition by src, dst, kind order by ord) = 1)
select * from known union all select src, dst, kind, arg_min(confidence, ord), min(ord) from edges where (src, dst, kind) not in (select src, dst, kind from known) group by src, dst, kind""")
def insert_or_ignore_existing(t: Tables) -> DataFrame:
    e = t.edges()
    known = mutate.first_of(e.where("confidence = 'high'"), ["src", "dst", "kind"], ["ord"])
    return mutate.insert_or_ignore(known, e, ["src", "dst", "kind"], ["ord"])


@query(f"with {SYMBOLS}, gone as (select distinct p_brand as path from part where p_size = 50) select path, symbol_id, name, false as rewritten from symbols where path not in (select path from gone) union all select path, -1, '<file>', true from gone")
def replace_payload(t: Tables) -> DataFrame:
    gone = t.part.where("p_size = 50").select(F.col("p_brand").alias("path")).distinct()
    payload = t.symbols().select("path", "symbol_id", "name", F.lit(False).alias("rewritten"))
    return mutate.replace_payload(payload, gone, gone.select("path", F.lit(-1).cast("long").alias("symbol_id"), F.lit("<file>").alias("name"), F.lit(True).alias("rewritten")))


@query(f"select (select count(*) from documents) as files, (select count(*) from part) as symbols, (with {EDGES} select count(*) from (select distinct src, dst, kind from edges)) as edges, (select count(*) from orders) as commits")
def table_counts_meta(t: Tables) -> DataFrame:
    return pack.table_counts({"files": t.documents, "symbols": t.part, "edges": t.edges().select("src", "dst", "kind").distinct(), "commits": t.orders})


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 'absent' as git_status, cast(0 as bigint) as commit_count from customer")
def additive_migration(t: Tables) -> DataFrame:
    return mutate.with_missing_columns(t.customer, {"git_status": "'absent'", "commit_count": "cast(0 as bigint)", "c_name": "''"})


# -- lookups ------------------------------------------------------------------------------------

TERMS = [(1, 0, "RED Widget"), (1, 1, "blue"), (1, 2, ""), (2, 0, "small R"), (2, 1, "SMALL RING"), (3, 0, "hot_gear"), (3, 1, "%"), (4, 0, "g"), (4, 1, "Hot gear")]
_TERMS = values_sql("terms", "query_id, term_ord, term", TERMS)


def _terms(t: Tables) -> DataFrame:
    return rows(t, "query_id int, term_ord int, term string", TERMS)


@query(f"with {SYMBOLS}, {_TERMS} select query_id, term, symbol_id, name, path, start_line from symbols join terms on name_lc = lower(term)")
def symbol_exact_nocase(t: Tables) -> DataFrame:
    return lookup.exact(t.symbols(), _terms(t)).select("query_id", "term", "symbol_id", "name", "path", "start_line")


@query(f"with {SYMBOLS}, {_TERMS} select query_id, term, symbol_id, name, path from symbols join terms on starts_with(name_lc, lower(term)) where term <> ''")
def symbol_prefix_escaped(t: Tables) -> DataFrame:
    return lookup.prefix(t.symbols(), _terms(t).where("term <> ''")).select("query_id", "term", "symbol_id", "name", "path")


@query(f"with {SYMBOLS}, {_TERMS} select query_id, term, symbol_id, name, kind from symbols join terms on name_lc = lower(term) where kind = 'ECONOMY'")
def symbol_kind_exact(t: Tables) -> DataFrame:
    return lookup.of_kind(lookup.exact(t.symbols(), _terms(t)), "ECONOMY").select("query_id", "term", "symbol_id", "name", "kind")


@query(f"with {SYMBOLS}, {_TERMS} select query_id, term, symbol_id, name, kind from symbols join terms on starts_with(name_lc, lower(term)) where kind = 'ECONOMY' and term <> ''")
def symbol_kind_prefix(t: Tables) -> DataFrame:
    return lookup.of_kind(lookup.prefix(t.symbols(), _terms(t).where("term <> ''")), "ECONOMY").select("query_id", "term", "symbol_id", "name", "kind")


@query(f"with {SYMBOLS} select path, symbol_id, name, start_line from symbols qualify row_number() over (partition by path order by start_line, ord) <= 50")
def symbols_in_path_topk(t: Tables) -> DataFrame:
    s = t.symbols()
    return lookup.in_path(s, s.select("path").distinct(), 50).select("path", "symbol_id", "name", "start_line")


@query(f"""with {SYMBOLS}, {_TERMS}, hits as (
  select query_id, term_ord, 0 as phase, symbol_id, path, ord from symbols join terms on name_lc = lower(term) where term <> ''
  union all select query_id, term_ord, 1, symbol_id, path, ord from symbols join terms on starts_with(name_lc, lower(term)) where term <> ''),
once as (select * from hits qualify row_number() over (partition by query_id, symbol_id order by term_ord, phase) = 1)
select query_id, symbol_id, phase = 0 as exact, row_number() over (partition by query_id order by term_ord, phase, path, ord) as hit_ord from once qualify hit_ord <= 50""")
def symbols_tagged_cap(t: Tables) -> DataFrame:
    return lookup.tagged(t.symbols(), _terms(t), 50).select("query_id", "symbol_id", "exact", "hit_ord")


# -- graph --------------------------------------------------------------------------------------

_SEEDS = "seeds as (select n_nationkey as query_id, p_partkey as id, p_partkey as seed_ord from nation join part on p_brand = 'Brand#' || n_nationkey)"


def _seeds(t: Tables) -> DataFrame:
    near = t.part.join(t.nation, F.concat(F.lit("Brand#"), "n_nationkey") == F.col("p_brand"))
    return near.select(F.col("n_nationkey").alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seed_ord"))


def _distinct_edges(t: Tables) -> DataFrame:
    """Each edge once.  Dealt by src, which serves the window and what is joined on src after it."""
    return mutate.first_of(t.edges().repartition("src"), ["src", "dst", "kind"], ["ord"])


_DISTINCT = "e as (select src, dst, kind, arg_min(confidence, ord) as confidence, min(ord) as ord from edges group by src, dst, kind)"


@query(f"with {EDGES}, {_DISTINCT}, {_SEEDS} select query_id, id as seed, src, dst, kind, confidence from e join seeds on e.src = seeds.id or e.dst = seeds.id")
def neighbors_union(t: Tables) -> DataFrame:
    return graph.touching(_distinct_edges(t), _seeds(t).withColumn("seed", F.col("id"))).select("query_id", "seed", "src", "dst", "kind", "confidence")


_NEIGHBORS = f"""with {EDGES}, {_DISTINCT}, {_SEEDS},
near as (select s.query_id, s.seed_ord, e.* from e join seeds s on e.src = s.id or e.dst = s.id qualify row_number() over (partition by s.query_id, s.seed_ord order by e.ord, src, dst, kind) <= 40),
sided as (select n.*, exists (select 1 from seeds s where s.query_id = n.query_id and s.id = n.src) as s, exists (select 1 from seeds s where s.query_id = n.query_id and s.id = n.dst) as d from near n),
new as (select *, case when s then dst else src end as other, case when confidence = 'high' then 0 else 1 end as low from sided where s <> d),
once as (select * from new qualify row_number() over (partition by query_id, other order by low, seed_ord, ord, src, dst, kind) = 1)
select query_id, other, src, dst, kind, confidence, row_number() over (partition by query_id order by low, seed_ord, ord, src, dst, kind) as rank from once qualify rank <= 40"""


@query(_NEIGHBORS)
def neighbors_high_then_low_cap(t: Tables) -> DataFrame:
    return graph.neighbors(_distinct_edges(t), _seeds(t), 40, 40).select("query_id", "other", "src", "dst", "kind", "confidence", "rank")


@query(_NEIGHBORS)
def neighbors_of_heads(t: Tables) -> DataFrame:
    """The same from stored first edges of each node, as an index has them: of a hub only these are read."""
    stored = written(graph.heads(_distinct_edges(t), 40), "heads")
    near = graph.nearest(stored.join(_seeds(t).withColumnRenamed("id", "node"), "node"), 40)
    return graph.chosen(near, _seeds(t), 40).select("query_id", "other", "src", "dst", "kind", "confidence", "rank")


# -- full text ----------------------------------------------------------------------------------

_DUCK_TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
_POSTINGS = f"""docs as (select doc_id, {_DUCK_TOKENS.format("text")} as toks from documents), d as (select doc_id, toks, len(toks) as dl from docs),
flat as (select doc_id, unnest(toks) as term from d), postings as (select doc_id, term, count(*) as tf from flat group by all)"""
_STATS = "stats as (select count(*) as n, avg(dl) as avgdl from d)"
_WEIGHT = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _found(found: str, having: str = "") -> str:
    """SQL from a CTE of (query_id, phrase_ord, doc_id, tf) to ranked hits."""
    return f"""dfs as (select query_id, phrase_ord, count(distinct doc_id) as df from {found} group by all),
    summed as (select f.query_id, f.doc_id, -sum({_WEIGHT}) as score, count(*) as have from {found} f join dfs using (query_id, phrase_ord) join d using (doc_id), stats group by f.query_id, f.doc_id),
    hits as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9), doc_id) as rank from summed {having})"""


def _scanned(t: Tables, wanted: DataFrame) -> fulltext.TextIndex:
    return fulltext.scanned(t.documents, wanted, "doc_id", ("text",))


WORDS = [(1, ["anat", "erin"]), (2, ["tion", "thly", "with"]), (3, ["achch"]), (4, ["nosuchword", "the"]), (5, ["résh", "erst"])]
PHRASES = [(1, ["of", "the"]), (2, ["de", "la", "que"]), (3, ["with", "the", "nowhere"]), (4, ["is"])]


def _wanted(t: Tables, words: list[tuple[int, list[str]]], split: bool) -> DataFrame:
    """Phrases: each word one, or each list one."""
    flat = [(q, k, [w]) for q, ws in words for k, w in enumerate(ws)] if split else [(q, 0, ws) for q, ws in words]
    folded = rows(t, "query_id int, phrase_ord int, toks array<string>", flat)
    return folded.select("query_id", "phrase_ord", T.tokens(F.array_join("toks", " ")).alias("toks"), F.lit(False).alias("prefix"))


_WORDS = values_sql("w", "query_id, phrase_ord, word", [(q, k, w) for q, ws in WORDS for k, w in enumerate(ws)])


@query(f"with {_POSTINGS} select term, count(*) as df, sum(tf) as cf from postings group by term")
def fts_tokens_df(t: Tables) -> DataFrame:
    return fulltext.index(t.documents, "doc_id", ("text",)).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("places")).alias("cf"))


@query(f"""with {_POSTINGS}, {_STATS}, {_WORDS}, found as (select query_id, phrase_ord, doc_id, tf from postings join w on term = strip_accents(lower(word))),
{_found("found", "where have = (select count(*) from w where w.query_id = summed.query_id)")} select query_id, doc_id, rank, round(score, 6) as score from hits where rank <= 30""")
def fts_bm25_and_topk(t: Tables) -> DataFrame:
    wanted = _wanted(t, WORDS, True)
    found = fulltext.search(_scanned(t, wanted), wanted, False, 30)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""with {_POSTINGS}, {_STATS}, {_WORDS}, found as (select query_id, phrase_ord, doc_id, tf from postings join w on term = strip_accents(lower(word))), {_found("found")},
a as (select query_id, doc_id, rank from hits where rank <= 30),
strict as (select h.query_id, h.doc_id, row_number() over (partition by h.query_id order by round(score, 9), h.doc_id) as rank from summed h where have = (select count(*) from w where w.query_id = h.query_id)),
both_ as (select query_id, doc_id, 0 as part, rank from strict where rank <= 30 union all select query_id, doc_id, 1, rank from a),
once as (select * from both_ qualify row_number() over (partition by query_id, doc_id order by part, rank) = 1)
select query_id, doc_id, row_number() over (partition by query_id order by part, rank) as rank from once qualify row_number() over (partition by query_id order by part, rank) <= 30""")
def fts_or_fallback_union(t: Tables) -> DataFrame:
    wanted = _wanted(t, WORDS, True)
    texts = _scanned(t, wanted)
    return fulltext.ordered_union([fulltext.search(texts, wanted, any_of, 30) for any_of in (False, True)], 30, "doc_id")


@query(f"""with {_POSTINGS}, {_STATS}, {values_sql("p", "query_id, phrase", [(q, ws) for q, ws in PHRASES])},
found as (select query_id, 0 as phrase_ord, doc_id, len(list_filter(range(1, dl - len(phrase) + 2), lambda i: toks[i : i + len(phrase) - 1] = phrase)) as tf from d join p on list_has_all(toks, phrase)),
real as (select * from found where tf > 0), {_found("real")} select query_id, doc_id, rank, round(score, 6) as score from hits where rank <= 30""")
def fts_phrase(t: Tables) -> DataFrame:
    wanted = _wanted(t, PHRASES, False)
    found = fulltext.search(_scanned(t, wanted), wanted, False, 30)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""with {_POSTINGS}, {_STATS}, {values_sql("p", "query_id, start", [(1, "achl"), (2, "zu"), (3, "nothingstartsso")])},
found as (select query_id, 0 as phrase_ord, doc_id, sum(tf) as tf from postings join p on starts_with(term, start) group by all), {_found("found")}
select query_id, doc_id, rank, round(score, 6) as score from hits where rank <= 30""")
def fts_prefix(t: Tables) -> DataFrame:
    wanted = rows(t, "query_id int, phrase_ord int, toks array<string>, prefix boolean", [(1, 0, ["achl"], True), (2, 0, ["zu"], True), (3, 0, ["nothingstartsso"], True)])
    return fulltext.search(_scanned(t, wanted), wanted, False, 30).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""with {_POSTINGS}, {_STATS}, {_WORDS}, found as (select query_id * 10 + phrase_ord as query_id, 0 as phrase_ord, doc_id, tf from postings join w on term = strip_accents(lower(word))), {_found("found")},
each_ as (select query_id // 10 as query_id, doc_id, query_id % 10 as part, rank from hits where rank <= 30),
once as (select * from each_ qualify row_number() over (partition by query_id, doc_id order by part, rank) = 1)
select query_id, doc_id, row_number() over (partition by query_id order by part, rank) as rank from once qualify row_number() over (partition by query_id order by part, rank) <= 30""")
def fts_multi_term_union_cap(t: Tables) -> DataFrame:
    wanted = _wanted(t, WORDS, True)
    each = fulltext.search(_scanned(t, wanted), wanted.withColumn("query_id", F.col("query_id") * 10 + F.col("phrase_ord")), False, 30)
    parts = [each.where(F.col("query_id") % 10 == k).withColumn("query_id", F.floor(F.col("query_id") / 10).cast("int")) for k in range(max(len(w) for _, w in WORDS))]
    return fulltext.ordered_union(parts, 30, "doc_id")


@query(f"""with {_POSTINGS}, {_STATS}, w as (select query_id, row_number() over (partition by query_id order by word) as phrase_ord, word from (select distinct item_id as query_id, unnest({_DUCK_TOKENS.format("text")}) as word from benchmark)),
found as (select query_id, phrase_ord, doc_id, tf from postings join w on term = word), {_found("found")} select query_id, doc_id, rank, round(score, 5) as score from hits where rank <= 5""")
def batch_queries_topk(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    ord_ = F.row_number().over(Window.partitionBy("query_id").orderBy("word"))
    wanted = words.select("query_id", ord_.alias("phrase_ord"), F.array("word").alias("toks"), F.lit(False).alias("prefix"))
    return fulltext.search(_scanned(t, wanted), wanted, True, 5).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query(f"""with {FILES}, f as (select *, string_split(path, '/')[-1] as name from files), kept as (select path, content from (select *, {_SKIP_SQL} as skip from f) where skip = 'keep'),
docs as (select path, {_DUCK_TOKENS.format("path || chr(10) || content")} as toks from kept), d as (select path as doc_id, toks, len(toks) as dl from docs), flat as (select doc_id, unnest(toks) as term from d),
postings as (select doc_id, term, count(*) as tf from flat group by all), {_STATS}, {_WORDS},
found as (select query_id, phrase_ord, doc_id, tf from postings join w on term = strip_accents(lower(word))),
{_found("found", "where have = (select count(*) from w where w.query_id = summed.query_id)")}
select query_id, doc_id as path, rank, round(score, 6) as score from hits where rank <= 20""")
def search_code_end_to_end(t: Tables) -> DataFrame:
    """Flagship: scan, skip rules, postings over path and content, AND match, BM25, best 20."""
    kept = t.files().where(T.skip_kind(F.col("path"), F.col("content"), F.col("size")) == "keep")
    wanted = _wanted(t, WORDS, True)
    found = fulltext.search(fulltext.scanned(kept, wanted), wanted, False, 20)
    return found.select("query_id", "path", "rank", F.round("score", 6).alias("score"))


#: Expressions of the match language, and beside them, in ``_MATCHES``, the phrases they mean.
EXPRESSIONS = ["anat erin OR erst", "erst NOT anat", '"of the" OR "de la" NOT que', "ache* NOT \"nowhere of\"", "tion AND nowhere", "résh erst NOT thly OR zu*"]
_MATCHES = values_sql("m", "query_id, phrase_ord, words, prefix, grp, negated", [
    (0, 0, ["anat"], False, 0, False), (0, 1, ["erin"], False, 0, False), (0, 2, ["erst"], False, 1, False), (1, 0, ["erst"], False, 0, False), (1, 1, ["anat"], False, 0, True),
    (2, 0, ["of", "the"], False, 0, False), (2, 1, ["de", "la"], False, 1, False), (2, 2, ["que"], False, 1, True), (3, 0, ["ache"], True, 0, False), (3, 1, ["nowhere", "of"], False, 0, True),
    (4, 0, ["tion"], False, 0, False), (4, 1, ["nowhere"], False, 0, False), (5, 0, ["resh"], False, 0, False), (5, 1, ["erst"], False, 0, False), (5, 2, ["thly"], False, 0, True), (5, 3, ["zu"], True, 1, False),
])


@query(f"""with {_POSTINGS}, {_STATS}, {_MATCHES},
one as (select query_id, phrase_ord, doc_id, sum(tf) as tf from m join postings on case when prefix then starts_with(term, words[1]) else term = words[1] end where len(words) = 1 group by all),
more as (select query_id, phrase_ord, doc_id, len(list_filter(range(1, dl - len(words) + 2), lambda i: toks[i : i + len(words) - 1] = words)) as tf from m join d on list_has_all(toks, words) where len(words) > 1),
each_ as (select * from one union all select * from more where tf > 0), sides as (select each_.*, grp, negated from each_ join m using (query_id, phrase_ord)),
answers as (select distinct s.query_id, s.doc_id from sides s join (select query_id, grp, count(*) filter (where not negated) as need from m group by all) n on n.query_id = s.query_id and n.grp = s.grp
  group by s.query_id, s.grp, s.doc_id, need having count(*) filter (where not negated) = need and count(*) filter (where negated) = 0),
good as (select * from sides where not negated), {_found("good", "semi join answers on answers.query_id = summed.query_id and answers.doc_id = summed.doc_id")} select query_id, doc_id, rank, round(score, 6) as score from hits where rank <= 30""")
def match_expressions(t: Tables) -> DataFrame:
    wanted = context.phrase_table(t.spark, [(q, 0, e) for q, x in enumerate(EXPRESSIONS) for e in ladder(x)])
    return fulltext.search_expressions(_scanned(t, wanted), wanted, 30).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


#: Expressions with nearness, columns and first words; what they mean is in the SQL.
PLACED = ["NEAR(erin anat, 3)", "content: tion NOT path: src1", "path: src1 erst", "^src2", "{path content} : (anat + erin) OR path: zz9"]


@query(f"""with {FILES}, cut as (select path, {_DUCK_TOKENS.format("path")} as p, {_DUCK_TOKENS.format("content")} as c from files),
flat as (select path as doc_id, 0 as side, unnest(p) as term, unnest(range(1, len(p) + 1)) as pos from cut union all select path, 1, unnest(c), unnest(range(1, len(c) + 1)) from cut),
d as (select path as doc_id, len(p) + len(c) as dl from cut), {_STATS},
occ as (select 0 as query_id, 0 as phrase_ord, * from flat where term = 'erin' union all select 0, 1, * from flat where term = 'anat' union all select 1, 0, * from flat where term = 'tion' and side = 1
  union all select 2, 0, * from flat where term = 'src1' and side = 0 union all select 2, 1, * from flat where term = 'erst' union all select 3, 0, * from flat where term = 'src2' and pos = 1
  union all select 4, 0, a.* from flat a join flat b on a.doc_id = b.doc_id and a.side = b.side and b.pos = a.pos + 1 where a.term = 'anat' and b.term = 'erin'),
dfs as (select query_id, phrase_ord, count(distinct doc_id) as df from occ group by all),
kept as (select * from occ where query_id <> 0 union all select a.* from occ a where query_id = 0 and exists (select 1 from occ b where b.query_id = 0 and b.phrase_ord <> a.phrase_ord and b.doc_id = a.doc_id and b.side = a.side and abs(a.pos - b.pos) <= 4)),
found as (select query_id, phrase_ord, doc_id, count(*) as tf from kept group by all),
summed as (select f.query_id, f.doc_id, -sum({_WEIGHT}) as score, count(*) as have from found f join dfs using (query_id, phrase_ord) join d using (doc_id), stats group by f.query_id, f.doc_id),
hits as (select *, row_number() over (partition by query_id order by round(score, 9), doc_id) as rank from summed where (query_id not in (0, 2) or have = 2) and not (query_id = 1 and doc_id in (select doc_id from flat where term = 'src1' and side = 0)))
select query_id, doc_id as path, rank, round(score, 6) as score from hits where rank <= 30""")
def match_places(t: Tables) -> DataFrame:
    wanted = context.phrase_table(t.spark, [(q, 0, e) for q, x in enumerate(PLACED) for e in ladder(x)])
    return fulltext.search_expressions(fulltext.scanned(t.files(), wanted), wanted, 30).select("query_id", "path", "rank", F.round("score", 6).alias("score"))


# -- commits ------------------------------------------------------------------------------------

_SUBJECTS = values_sql("w", "query_id, word", [(1, "urgent"), (1, "1999"), (2, "of 77"), (3, "SPECIFIED")])


@query(f"with {COMMITS}, {_SUBJECTS} select distinct query_id, sha from commits join w on contains(lower(subject), lower(word))")
def commit_subject_contains(t: Tables) -> DataFrame:
    asked = rows(t, "query_id int, symbol_terms array<string>", [(1, ["urgent", "1999"]), (2, ["of 77"]), (3, ["SPECIFIED"]), (4, [""])])
    return context.subject_hits(t.commits(), asked).select("query_id", "sha")


@query(f"with {COMMITS}, {_SUBJECTS} select distinct query_id, sha from commits join w on contains(lower(subject), lower(word))")
def commit_subject_grams(t: Tables) -> DataFrame:
    """The same by the pieces of subjects."""
    asked = rows(t, "query_id int, symbol_terms array<string>", [(1, ["urgent", "1999"]), (2, ["of 77"]), (3, ["SPECIFIED"]), (4, [""])])
    commits = t.commits()
    return context.subject_hits(commits, asked, context.subject_grams(commits)).select("query_id", "sha")


#: Questions about commits; beside them, in ``_ASKED``, the subjects and in ``_SAID`` the words they ask for.
#: The words of the last are no expression, so they find nothing by text.
COMMIT_QUESTIONS = ["why URGENT change", '"of 77" status', "HIGH nosuchword", "status of change", "LOW soft-delete change"]
_ASKED = values_sql("a", "query_id, word", [(0, "urgent"), (1, "of 77"), (2, "high"), (4, "low")])
_SAID = values_sql("w", "query_id, phrase_ord, word", [(0, 0, "why"), (0, 1, "change"), (1, 0, "status"), (2, 0, "nosuchword"), (3, 0, "status"), (3, 1, "change")])


@query(f"""with {COMMITS}, d as (select sha as doc_id, toks, len(toks) as dl from (select sha, regexp_extract_all(lower(sha || chr(10) || subject || chr(10) || body), '[a-z0-9]+') as toks from commits)),
flat as (select doc_id, unnest(toks) as term from d), postings as (select doc_id, term, count(*) as tf from flat group by all), {_STATS}, {_ASKED}, {_SAID},
found as (select query_id, phrase_ord, doc_id, tf from postings join w on term = word), {_found("found", "where have = (select count(*) from w where w.query_id = summed.query_id)")},
f as (select query_id, doc_id as sha, rank as fts_rank from hits where rank <= 20),
sub as (select query_id, sha, row_number() over (partition by query_id order by ord) as subject_rank from (select distinct query_id, sha, ord from commits join a on contains(lower(subject), word)) qualify subject_rank <= 20),
u as (select coalesce(sub.query_id, f.query_id) as query_id, coalesce(sub.sha, f.sha) as sha, fts_rank, subject_rank from sub full join f on f.query_id = sub.query_id and f.sha = sub.sha)
select query_id, sha, round(coalesce(1.0 / fts_rank, 1.0), 9) as norm, row_number() over (partition by query_id order by subject_rank nulls last, fts_rank) as rank from u qualify rank <= 20""")
def commit_search(t: Tables) -> DataFrame:
    """Subject hits first, then full-text ones; a subject hit keeps its full-text norm, or has 1."""
    q, phrases = context.planned(t.spark, [(k, text, 0) for k, text in enumerate(COMMIT_QUESTIONS)])
    commits = t.commits()
    index = context.Index(None, None, None, None, None, commits, fulltext.scanned(commits, phrases, "sha", ("sha", "subject", "body")))
    return context.commit_hits(index, q, phrases).select("query_id", "sha", F.round("norm", 9).alias("norm"), "rank")


@query(f"""with {COMMITS}, files as (select l_orderkey as ord, 'Brand#' || (l_suppkey % 25 + 1) || '/' || l_linenumber as path from lineitem),
code as (select distinct p_size % 4 as query_id, p_brand || '/' || p_size as path from part), hints(query_id, hint) as (values (1, 'Brand#7/'), (2, '4/2'), (2, '/7'))
select distinct h.query_id, sha from commits join files using (ord) join (select unnest(range(4)) as query_id) h on path in (select path from code where code.query_id = h.query_id) or exists (select 1 from hints where hints.query_id = h.query_id and contains(path, hint))""")
def commit_path_flag(t: Tables) -> DataFrame:
    file = F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25 + 1, F.lit("/"), "l_linenumber")
    files = t.lineitem.groupBy(F.col("l_orderkey").alias("ord")).agg(F.collect_set(file).alias("files"))
    commits = t.commits().join(files, "ord").select(F.explode(F.lit([0, 1, 2, 3])).alias("query_id"), "sha", "files")
    code = t.part.select((F.col("p_size") % 4).alias("query_id"), F.concat("p_brand", F.lit("/"), "p_size").alias("file")).distinct()
    q = rows(t, "query_id int, path_hints array<string>", [(0, []), (1, ["Brand#7/"]), (2, ["4/2", "/7"]), (3, [])])
    return context.commits_on_path(commits, code, q)


@query("select conv_id, turn, case when length(text) > 800 then left(text, 800) || '…' else text end as body, length(text) > 800 as was_cut from conversations")
def truncate_body(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.cut(F.col("text"), 800).alias("body"), (F.char_length("text") > 800).alias("was_cut"))


@query(f"with {COMMITS} select sha, left(sha, 7) as short, case when body = '' then subject else subject || chr(10) || chr(10) || body end as text from commits")
def commit_text(t: Tables) -> DataFrame:
    return t.commits().select("sha", F.left("sha", F.lit(7)).alias("short"), T.commit_text(F.col("subject"), F.col("body")).alias("text"))


# -- spans --------------------------------------------------------------------------------------

_SPANS = """spans as (select l_orderkey % 5 as query_id, l_orderkey * 10 + l_linenumber as ord, 'Brand#' || (l_partkey % 25 + 1) || '/' || (l_suppkey % 9) as path,
  cast(l_quantity as int) as start_line, cast(l_quantity + l_linenumber % 4 as int) as end_line, case when l_tax < 0.05 then 's' || l_partkey end as symbol,
  case when l_tax < 0.05 then l_returnflag end as kind, case when l_discount < 0.03 then ['exact_symbol'] when l_discount < 0.06 then ['fts', 'prefix_symbol'] else ['fts'] end as why,
  1.0 / l_linenumber as fts_norm, l_returnflag = 'A' as neighbor_high, l_returnflag = 'N' as neighbor_low from lineitem)"""
_FUSED = """fused as (select query_id, path, start_line, end_line, min(ord) as ord, list_sort(list_distinct(flatten(list(why)))) as why,
  arg_min(symbol, ord) filter (where symbol is not null) as symbol, arg_min(kind, ord) filter (where symbol is not null) as kind,
  max(fts_norm) as fts_norm, bool_or(neighbor_high) as neighbor_high, bool_or(neighbor_low) as neighbor_low from spans group by query_id, path, start_line, end_line)"""
_SCORE = """(case when list_contains(why, 'exact_symbol') then 5 else 0 end + case when list_contains(why, 'prefix_symbol') then 3 else 0 end + case when list_contains(why, 'fts') then 2 * fts_norm else 0 end
  + case when neighbor_high then 1.5 when neighbor_low then 0.5 else 0 end + case when contains(path, '#7/') then 1 else 0 end + case when top then 1 else 0 end)"""
_SCORED = f"""tops as (select distinct query_id, path, true as t from fused where list_contains(why, 'exact_symbol') and ends_with(path, '/3')),
  scored as (select *, round({_SCORE}, 9) as score from (select fused.*, coalesce(t, false) as top from fused left join tops using (query_id, path)))"""


def _spans(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    named = F.col("l_tax") < 0.05
    return t.lineitem.select(
        (F.col("l_orderkey") % 5).alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("Brand#"), F.col("l_partkey") % 25 + 1, F.lit("/"), F.col("l_suppkey") % 9).alias("path"),
        F.col("l_quantity").cast("int").alias("start_line"), (F.col("l_quantity") + F.col("l_linenumber") % 4).cast("int").alias("end_line"), F.when(named, F.concat(F.lit("s"), "l_partkey")).alias("symbol"), F.when(named, F.col("l_returnflag")).alias("kind"),
        F.when(d < 0.03, F.array(F.lit("exact_symbol"))).when(d < 0.06, F.array(F.lit("fts"), F.lit("prefix_symbol"))).otherwise(F.array(F.lit("fts"))).alias("why"), (1.0 / F.col("l_linenumber")).alias("fts_norm"),
        (F.col("l_returnflag") == "A").alias("neighbor_high"), (F.col("l_returnflag") == "N").alias("neighbor_low"), F.lit(None).cast("string").alias("prequoted"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("at"),  # keys repeat: of equal ones the table's first row is first
    )


def _scored(t: Tables) -> DataFrame:
    fused = rank.fuse(_spans(t))
    tops = fused.where(F.array_contains("why", "exact_symbol") & F.endswith("path", F.lit("/3"))).select("query_id", "path", F.lit(True).alias("top")).distinct()
    marked = fused.join(tops, ["query_id", "path"], "left")
    s = rank.score(F.col("why"), F.col("fts_norm"), F.col("neighbor_high"), F.col("neighbor_low"), F.contains("path", F.lit("#7/")), F.coalesce("top", F.lit(False)))
    return marked.withColumn("score", F.round(s, 9)).drop("top")


_WHY = "array_to_string(why, ',') as why"


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("why", F.array_join("why", ",")).select(*columns)


@query(f"with {_SPANS}, {_FUSED} select query_id, path, start_line, end_line, ord, {_WHY}, symbol, kind, round(fts_norm, 9) as fts_norm, neighbor_high, neighbor_low from fused")
def fuse_spans(t: Tables) -> DataFrame:
    return _flat(rank.fuse(_spans(t)).withColumn("fts_norm", F.round("fts_norm", 9)), "query_id", "path", "start_line", "end_line", "ord", "why", "symbol", "kind", "fts_norm", "neighbor_high", "neighbor_low")


@query(f"with {_SPANS}, {_FUSED}, {_SCORED} select query_id, path, start_line, end_line, {_WHY}, round(score, 6) as score from scored")
def score_weighted(t: Tables) -> DataFrame:
    return _flat(_scored(t).withColumn("score", F.round("score", 6)), "query_id", "path", "start_line", "end_line", "why", "score")


@query(f"""with {_SPANS}, {_FUSED}, {_SCORED} select query_id, path, start_line, end_line, symbol from scored s where not (symbol is null and list_contains(why, 'fts') and exists
(select 1 from scored y where y.query_id = s.query_id and y.path = s.path and y.symbol is not null and y.start_line >= s.start_line and y.end_line <= s.end_line))""")
def drop_covered_snippets(t: Tables) -> DataFrame:
    return rank.drop_covered_snippets(_scored(t)).select("query_id", "path", "start_line", "end_line", "symbol")


@query(f"""with {_SPANS}, {_FUSED}, {_SCORED},
marked as (select *, coalesce(start_line > max(end_line) over (partition by query_id, path order by start_line, end_line, score desc, ord rows between unbounded preceding and 1 preceding), true) as opened,
  row_number() over (partition by query_id, path order by start_line, end_line, score desc, ord) as pos from scored),
islands as (select *, sum(opened::int) over (partition by query_id, path order by pos) as island from marked)
select query_id, path, min(start_line) as start_line, max(end_line) as end_line, array_to_string(list_sort(list_distinct(flatten(list(why)))), ',') as why, arg_min(symbol, pos) filter (where symbol is not null) as symbol, count(*) as n_rows
from islands group by query_id, path, island""")
def interval_merge(t: Tables) -> DataFrame:
    scored = _scored(t)
    merged = rank.merge_overlaps(scored)
    inside = merged.select("query_id", "path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    counted = scored.join(inside, ["query_id", "path"]).where("start_line between a and b").groupBy("query_id", "path", F.col("a").alias("start_line")).agg(F.count("*").alias("n_rows"))
    return _flat(merged.join(counted, ["query_id", "path", "start_line"]), "query_id", "path", "start_line", "end_line", "why", "symbol", "n_rows")


@query(f"with {_SPANS}, {_FUSED}, {_SCORED} select query_id, path, start_line, end_line, row_number() over (partition by query_id, path order by score desc, start_line, end_line) > 2 as overflow from scored")
def top2_per_path(t: Tables) -> DataFrame:
    return rank.first_pass(_scored(t)).select("query_id", "path", "start_line", "end_line", "overflow")


@query("""with items as (select conv_id as query_id, turn, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) + 2 as cost from conversations),
run as (select *, sum(cost) over (partition by query_id order by turn) as used from items) select query_id, turn, cost, used, used <= 150 as admitted from run""")
def budget_prefix_sum(t: Tables) -> DataFrame:
    items = t.conversations.select(F.col("conv_id").alias("query_id"), "turn", T.token_cost(F.col("text")).alias("cost"), F.lit(150).alias("budget"))
    items, parts = rank.dealt(items, ["turn"])
    return rank.within_budget(items, ["turn"], parts).select("query_id", "turn", "cost", "used", "admitted")


_FILLED = f"""with {FILES}, lined as (select *, case when content = '' then [] else string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) end as lines from files),
code as (select doc_id % 7 as query_id, path, cast(doc_id % 4 as int) as start_line, cast(doc_id % 4 + doc_id % 6 as int) as end_line, (doc_id % 11) / 2.0 as score, doc_id % 3 = 0 as overflow,
  case when doc_id % 5 = 0 then null else array_to_string(lines[greatest(doc_id % 4, 1) : doc_id % 4 + doc_id % 6], chr(10)) end as text from lined),
commits as (select o_orderkey % 7 as query_id, 'git://c' || o_orderkey as path, 1 as start_line, 1 as end_line, 1.25 as score, false as overflow, 'order ' || o_orderpriority as text from orders),
all_ as (select * from code union all select * from commits),
costed as (select *, case when text is null then 'stale' when text = '' then 'empty' else 'item' end as state, case when coalesce(text, '') = '' then 0 else len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) + 2 end as cost from all_),
open_ as (select *, sum(case when overflow then 0 else cost end) over (partition by query_id) as first, 60 * (query_id + 1) as budget from costed),
run as (select *, sum(cost) over (partition by query_id order by overflow, score desc, path, start_line rows unbounded preceding) as used, row_number() over (partition by query_id order by overflow, score desc, path, start_line) as pos
  from open_ where not overflow or first <> budget),
filled as (select query_id, pos, path, state, cost, used, used <= budget as admitted,
  case when state = 'item' and not starts_with(path, 'git://') then least(end_line, greatest(start_line, 1) + len(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10))) - 1) else end_line end as end_line from run)"""


def _filled(t: Tables, budget: int = 60) -> DataFrame:
    """Spans of documents as files, of which every fifth has changed since, and some commits, filled under the budgets of seven questions."""
    files, k = t.files(), F.col("doc_id")
    code = files.select(
        (k % 7).cast("int").alias("query_id"), "path", (k % 4).cast("int").alias("start_line"), (k % 4 + k % 6).cast("int").alias("end_line"), ((k % 11) / 2.0).alias("score"), (k % 3 == 0).alias("overflow"), F.lit(None).cast("string").alias("prequoted"),
        F.when(k % 2 == 0, F.concat(F.lit("s"), k % 40)).alias("symbol"), F.lit("function").alias("kind"), F.array(F.lit("fts")).alias("why"),
    )
    o = F.col("o_orderkey")
    commits = t.orders.select((o % 7).cast("int").alias("query_id"), F.concat(F.lit("git://c"), o).alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(1.25).alias("score"), F.lit(False).alias("overflow"), F.concat(F.lit("order "), "o_orderpriority").alias("prequoted"), F.concat(F.lit("c"), o).alias("symbol"), F.lit("commit").alias("kind"), F.array(F.lit("commit")).alias("why"))
    now = files.withColumn("hash", F.when(k % 5 == 0, "changed").otherwise(F.col("hash")))
    index = context.Index(files.select("path", "hash"), lambda paths: now.join(paths, "path", "left_semi"), None, None, None, None, None)
    q = rows(t, "query_id int, budget int", [(n, budget * (n + 1)) for n in range(7)])
    return context.filled(code.unionByName(commits), index, q)


@query(f"{_FILLED} select * from filled")
def filled_budget(t: Tables) -> DataFrame:
    return _filled(t).select("query_id", "pos", "path", "state", "cost", "used", "admitted", "end_line")


@query(f"{_FILLED} select query_id, count(*) filter (where state = 'item') as items, count(*) filter (where state = 'stale') as stale_omitted, 2 * count(*) filter (where state = 'stale') > count(*) filter (where state in ('item', 'stale')) as stale_index from filled group by query_id")
def stale_filter_counts(t: Tables) -> DataFrame:
    s = _filled(t).groupBy("query_id").agg(F.count_if(F.col("state") == "item").alias("items"), F.count_if(F.col("state") == "stale").alias("stale_omitted"))
    return s.withColumn("stale_index", pack.is_stale(F.col("stale_omitted"), F.col("items")))


# every k first items of a package with the bytes that its JSON has: head, items, commas, and edges among them
_PACKAGES = f"""{_FILLED.replace("60 * (query_id + 1)", "1000 * (query_id + 1)").replace("as text from lined)", "as text, case when doc_id % 2 = 0 then 's' || doc_id % 40 end as symbol, 'function' as kind, ['fts'] as why from lined)").replace("as text from orders)", "as text, 'c' || o_orderkey as symbol, 'commit' as kind, ['commit'] as why from orders)").replace("used <= budget as admitted,", "used <= budget as admitted, start_line, text, symbol, kind, why,")},
taken as (select *, row_number() over (partition by query_id order by pos) as k, strlen(to_json({{'path': path, 'start_line': start_line, 'end_line': end_line, 'symbol': symbol, 'kind': kind, 'text': text, 'why': why}})) as bytes
  from filled where admitted and state = 'item'),
counts as (select query_id, count(distinct path) as files_considered, max(cast(not admitted as bigint)) as dropped_for_budget, count(*) filter (where admitted and state = 'stale') as stale_omitted from filled group by query_id),
names as (select query_id, path || ':' || symbol as item, min(k) as k from taken where symbol is not null group by all),
asked as (select l_orderkey % 7 as query_id, l_partkey * 7 + l_orderkey % 7 as src, l_suppkey * 7 + l_orderkey % 7 as dst, l_returnflag as kind, case when l_linestatus = 'F' then 'high' else 'low' end as confidence, l_orderkey * 10 + l_linenumber as ord from lineitem),
syms as (select doc_id as symbol_id, path || ':s' || doc_id % 40 as item from files where doc_id % 2 = 0),
shown as (select a.query_id, f.item as "from", g.item as "to", a.kind, arg_min(a.confidence, a.ord) as confidence, min(a.ord) as ord, max(greatest(x.k, y.k)) as k
  from asked a join syms f on f.symbol_id = a.src join syms g on g.symbol_id = a.dst join names x on x.query_id = a.query_id and x.item = f.item join names y on y.query_id = a.query_id and y.item = g.item group by a.query_id, f.item, g.item, a.kind),
sizes as (select query_id, unnest(range(0, n + 1)) as k, n from (select query_id, (select count(*) from taken i where i.query_id = c.query_id) as n from counts c)),
firsts as (select s.query_id, s.k, s.n, coalesce(i.used_tokens, 0) as used_tokens, coalesce(i.bytes, 0) as item_bytes, coalesce(i.included, 0) as included, coalesce(e.edge_bytes, 0) as edge_bytes, coalesce(e.n_edges, 0) as n_edges
  from sizes s left join (select query_id, k, sum(cost) over w as used_tokens, sum(bytes) over w as bytes, sum(cast(kind = 'commit' as bigint)) over w as included from taken window w as (partition by query_id order by k rows unbounded preceding)) i using (query_id, k)
  left join (select s.query_id, s.k, count(*) as n_edges, sum(strlen(to_json({{'from': "from", 'to': "to", 'kind': kind, 'confidence': confidence}}))) as edge_bytes from sizes s join shown e on e.query_id = s.query_id and e.k <= s.k group by all) e using (query_id, k)),
cut as (select f.*, c.*, f.k < f.n as truncated, 2 * stale_omitted > f.k + stale_omitted as stale_index from firsts f join counts c on c.query_id = f.query_id),
sized as (select * exclude (query_id_1), strlen(to_json({{'query': 'question ' || query_id, 'budget_tokens': 1000 * (query_id + 1), 'used_tokens': cast(used_tokens as bigint), 'items': [], 'edges': [], 'stats': {{'files_considered': files_considered, 'symbols_considered': query_id, 'dropped_for_budget': dropped_for_budget,
  'stale_omitted': stale_omitted, 'stale_index': stale_index, 'truncated': truncated, 'git': {{'status': 'ok', 'commits_considered': 2 * query_id, 'included': cast(included as bigint)}}}}}})) + item_bytes + greatest(k - 1, 0) + edge_bytes + greatest(n_edges - 1, 0) as json_bytes from cut),
packed as (select * from sized where json_bytes <= 16384 or k = 0 qualify row_number() over (partition by query_id order by k desc) = 1)"""


@query(f"""{_PACKAGES} select query_id, cast(used_tokens as bigint) as used_tokens, k as n_items, n_edges, files_considered, dropped_for_budget, stale_omitted, stale_index, truncated, cast(included as bigint) as included, cast(json_bytes as bigint) as json_bytes,
  coalesce((select string_agg(path || ':' || start_line || ':' || end_line, ',' order by t.k) from taken t where t.query_id = p.query_id and t.k <= p.k), '') as items,
  coalesce((select string_agg("from" || '>' || "to" || ':' || kind || ':' || confidence, ',' order by ord, "from", "to", kind) from shown e where e.query_id = p.query_id and e.k <= p.k), '') as edges from packed p""")
def package_assembly(t: Tables) -> DataFrame:
    """The packages of seven questions from their filled spans, with edges among all that they quote, under the size limit."""
    filled = written(packages.quoted(_filled(t, 1000)), "filled")
    line, k = F.col("l_orderkey") % 7, F.col("doc_id")
    followed = t.lineitem.select(line.cast("int").alias("query_id"), (F.col("l_partkey") * 7 + line).alias("src"), (F.col("l_suppkey") * 7 + line).alias("dst"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "F", "high").otherwise("low").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    symbols = t.files().where(k % 2 == 0).select(k.alias("symbol_id"), "path", F.concat(F.lit("s"), k % 40).alias("name"))
    q = rows(t, "query_id int, query string, budget int", [(n, f"question {n}", 1000 * (n + 1)) for n in range(7)])
    considered = q.select("query_id", F.col("query_id").cast("long").alias("symbols"), (F.col("query_id") * 2).cast("long").alias("commits"))
    p = packages.assembled(q, filled, packages.edges_shown(filled, followed, symbols), considered, "ok")
    listed = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["path"], i["start_line"], i["end_line"])), ",")
    arrows = F.array_join(F.transform("edges", lambda e: F.concat(e["from"], F.lit(">"), e["to"], F.lit(":"), e["kind"], F.lit(":"), e["confidence"])), ",")
    return p.select(
        "query_id", "used_tokens", F.size("items").cast("long").alias("n_items"), F.size("edges").cast("long").alias("n_edges"), *(f"stats.{c}" for c in ("files_considered", "dropped_for_budget", "stale_omitted", "stale_index", "truncated")),
        F.col("stats.git.included").alias("included"), F.octet_length("json").cast("long").alias("json_bytes"), listed.alias("items"), arrows.alias("edges"),
    )


@query("""select doc_id, array_to_string((case when text = '' then [] else string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) end)[2:4], chr(10)) as quoted from documents""")
def line_slice_quote(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("quoted"))


@query("select doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) + 2 as cost from documents")
def token_cost(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_cost(F.col("text")).alias("cost"))


@query(f"""with {FILES}, w(token) as (values ('d7'), ('D12'), ('.env'), ('credentials'), ('yarn'), ('')),
s as (select path, regexp_replace(string_split(path, '/')[-1], '^(.+)\\.[^.]*$', '\\1') as stem from files)
select path, token from s, w where token <> '' and (lower(stem) = lower(token) or starts_with(lower(stem), lower(token) || '_') or starts_with(lower(stem), lower(token) || '-'))""")
def stem_match(t: Tables) -> DataFrame:
    tokens = F.lit(["d7", "D12", ".env", "credentials", "yarn", ""])
    return t.files().select("path", F.explode(tokens).alias("token")).where(T.stem_matches(F.col("path"), F.col("token"))).select("path", "token")


@query(f"""with {EDGES}, {_DISTINCT}, {SYMBOLS}, items as (select distinct n_nationkey as query_id, path || ':' || name as item from symbols join nation on path = 'Brand#' || n_nationkey or path = 'Brand#' || (n_nationkey + 1)),
named as (select a.path || ':' || a.name as "from", b.path || ':' || b.name as "to", e.kind, e.confidence, e.ord from e join symbols a on a.symbol_id = e.src join symbols b on b.symbol_id = e.dst)
select i.query_id, "from", "to", kind, arg_min(confidence, ord) as confidence from named join items i on i.item = "from" join items j on j.item = "to" and j.query_id = i.query_id group by i.query_id, "from", "to", kind""")
def package_edges(t: Tables) -> DataFrame:
    from .operators.pack import edges_among

    s = t.symbols()
    item = F.concat("path", F.lit(":"), "name")
    numbered = t.nation.select(F.explode(F.array("n_nationkey", F.col("n_nationkey") + 1)).alias("_b"), F.col("n_nationkey").alias("query_id")).withColumn("path", F.concat(F.lit("Brand#"), "_b"))
    items = s.join(numbered, "path").select("query_id", item.alias("item")).distinct()
    side = lambda i, c: s.select(F.col("symbol_id").alias(i), item.alias(c))
    named = _distinct_edges(t).join(side("src", "from"), "src").join(side("dst", "to"), "dst")
    return edges_among(items, named).select("query_id", "from", "to", "kind", "confidence")


# -- vectors and history ------------------------------------------------------------------------


@query("""with q as (select label as query_id, vec_id as seed, embedding as e from embeddings qualify row_number() over (partition by label order by vec_id) = 1),
c as (select q.query_id, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.e::double[]), 9) as cosine from embeddings v join q on v.label = q.query_id),
top as (select * from c qualify row_number() over (partition by query_id order by cosine desc, vec_id) <= 3) select query_id, vec_id, round(cosine, 5) as cosine from top where cosine >= 0.6""")
def cosine_floor_topk(t: Tables) -> DataFrame:
    from .operators.pack import cosine

    e = t.embeddings
    seeds = mutate.first_of(e, ["label"], ["vec_id"]).select("label", F.col("embedding").alias("q"))
    near = e.join(seeds, "label").select(F.col("label").alias("query_id"), "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    top = near.withColumn("_n", F.row_number().over(w)).where("_n <= 3").where("cosine >= 0.6")
    return top.select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"))


_LOG_SQL = """with recs as (select chr(30) || 'c' || o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus || chr(31) || 'change ' || o_orderkey || chr(31) || o_orderpriority || ' body' || chr(10) || chr(10) || 'src/' || o_custkey || '.py' || chr(10) || 'README' || chr(10) as log, o_orderkey from orders)
select 'c' || o_orderkey as sha, cast(o_custkey as varchar) as author, 'change ' || o_orderkey as subject, o_orderpriority || ' body' as body, 'src/' || o_custkey || '.py,README' as files from orders"""


@query(_LOG_SQL)
def git_log_parse(t: Tables) -> DataFrame:
    from .sources.gitlog import parse_log

    sep = lambda c: F.lit(chr(c))
    record = F.concat(sep(30), F.lit("c"), "o_orderkey", sep(31), "o_custkey", sep(31), "o_orderstatus", sep(31), F.lit("change "), "o_orderkey", sep(31), "o_orderpriority", F.lit(" body\n\nsrc/"), "o_custkey", F.lit(".py\nREADME\n"))
    return parse_log(t.orders.select(record.alias("value"))).select("sha", "author", "subject", "body", F.array_join("files", ",").alias("files"))

