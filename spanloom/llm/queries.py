"""The thin queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import benchmark_hits

    hits = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import stored, with_metadata, with_payload_features

    rows = stored(_table(spark, sf_dir, "documents")).filled(lambda places: with_payload_features(with_metadata(places)))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "channels")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .native_spans import count_of, joined
    from .secrets import BASE, secret_spans

    found = secret_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(count_of("base", k.name).alias(f"n_{k.name}") for k in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.array_join("credentials", ",").alias("credentials"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .native_spans import count_of, joined
    from .pii import BASE, personal_spans

    found = personal_spans(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(count_of("base", k.name).alias(f"n_{k.name}") for k in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.array_join(F.transform("sure", lambda p: p.cast("string")), ",").alias("sure"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN, {"<|endoftext|>": 50256})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("located", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.withColumn("sentences", spans).drop("located")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tok.path("word_bpe_49k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked

    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import exact_topk

    return exact_topk(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_decontamination, op3_media, op4_lm, op5_simhash, op6_secrets, op7_pii, op8_packing, op9_toxicity, op10_token_counts, op11_filter_audit, op12_ranked_search, op13_exact_topk)}


#: Words of op2 by DuckDB: A-Z folded, ASCII other than digits and letters as separators.
_OP2_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce({_OP2_WORDS}, []) as w from documents),
b as (select cast(item_id as varchar) as item, {_OP2_WORDS} as w from benchmark where item_id is not null and text is not null),
bw as (select distinct item, least(10, len(w)) as n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as x
       from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as s from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select r, s, n, array_to_string(w[s : s + n - 1], ' ') as x
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
hit as (select dw.r, dw.s, dw.n, bw.item from dw join bw on dw.n = bw.n and dw.x = bw.x),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from (select distinct r, s, n from hit)) group by r),
items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hit group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(words.n_hit, 0) as n_hit, coalesce(items.n_items, 0) as n_items,
       sha256(coalesce(items.ids, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words on d.r = words.r left join items on d.r = items.r
"""


OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as x, sha256(encode(coalesce(html, ''))) as digest from pages),
f as (select digest, min(page_id) as first from p where octet_length(x) >= 100 group by digest)
select p.page_id, octet_length(p.x) as payload_bytes, p.digest as payload_digest,
       case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first < p.page_id then f.first end as refers_to, 'ok' as status
from p left join f on p.digest = f.digest and octet_length(p.x) >= 100
"""


def _any_case(word: str) -> str:
    """A pattern of ``word`` with its letters in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secret_patterns() -> list[tuple[str, str, int, str]]:
    """(kind, DuckDB pattern, group, condition on the match ``v`` and the group ``g``) in order of rank."""
    keys = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
    users = "|".join(map(_any_case, ("username", "user", "login", "account", "client_?id", "access_key_id")))
    sep = r"""["'']?\x20*[:=]\x20*["'']?"""
    return [
        ("assign", rf"({keys}){sep}([A-Za-z0-9+/_.=-]+)", 2, "length(g) >= 6"),
        ("access", "AKIA[A-Z0-9]+", 0, "length(v) >= 20"),
        ("hex", "[0-9a-f]+", 0, "length(v) >= 24"),
        ("user", rf"\b(?:{users}){sep}[A-Za-z0-9._@+-]{{3,}}", 0, "true"),
        ("endpoint", r"\b(?:https|http|ftp|ssh|jdbc:[a-z]+|postgresql|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"''<>]+", 0, "true"),
        ("blob", "[A-Za-z0-9+/_-]{32,}={0,2}", 0, "regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]')"),
    ]


def _op6_sql() -> str:
    """Matches get their places by sums of lengths; weak ones stay by an exists over all parts of their row."""
    each = "\n    union all\n    ".join(
        f"select r, {rank} as rank, '{kind}' as kind, i, coalesce(gap, '') as gap, v, g, {keep} as ok from (select r, unnest(string_split_regex(text, '{p}')) as gap, unnest(regexp_extract_all(text, '{p}')) as v, unnest(regexp_extract_all(text, '{p}', {group})) as g, unnest(range(len(regexp_extract_all(text, '{p}')))) as i from d where regexp_matches(text, '{p}')) where v is not null"
        for rank, (kind, p, group, keep) in enumerate(_secret_patterns())
    )
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
m as ({each}),
placed as (select r, rank, kind, ok, sum(length(gap) + length(v)) over (partition by r, rank order by i) as stop, length(v) as n from m),
p as (select r, rank, kind, cast(stop - n as bigint) as start, cast(stop as bigint) as stop,
      case when kind in ('access', 'user') then 'identifier' when kind in ('assign', 'hex', 'blob') then 'secret' else 'endpoint' end as part from placed where ok),
kept as (select * from p where rank < 3
    union all
    select * from p where rank >= 3 and not exists (select 1 from p as q where q.r = p.r and q.rank < 3 and q.start < p.stop and q.stop > p.start)
    and exists (select 1 from p as q where q.r = p.r and (q.part = 'secret') <> (p.part = 'secret') and greatest(p.start - q.stop, q.start - p.stop) <= 300)),
s as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      coalesce(string_agg(concat_ws(':', kind, start, stop), ',' order by start, rank) filter (rank < 3), '') as base,
      string_agg(concat_ws(':', kind, start, stop), ',' order by start, rank) as spans from kept group by r),
n as (select kept.*, length(t.u) - length(replace(t.u, chr(10), '')) as line from kept join lateral (select left(d.text, kept.start) as u from d where d.r = kept.r) t on true),
x as (select s.r, s.start as s, s.rank as sr, o.start as o, o.rank as orank, o.part, s.line <> o.line as off, greatest(s.start - o.stop, o.start - s.stop, 0) as gap, (o.start, o.rank) > (s.start, s.rank) as behind, s.stop as s_stop, o.stop as o_stop
      from n s join n o on s.r = o.r and s.part = 'secret' and o.part <> 'secret' and greatest(s.start - o.stop, o.start - s.stop) <= 300),
links as (select * from x qualify row_number() over (partition by r, s, sr, part order by off, gap, behind, case when behind then o else -o_stop end, case when behind then orank else o end, orank) = 1
      and row_number() over (partition by r, o, orank order by off, gap, behind, case when behind then -s_stop else s end, case when behind then s else sr end, sr) = 1),
pieces as (select r, s, sr, s as start, sr as rank from links union select r, s, sr, o, orank from links),
one as (select pieces.r, pieces.s, pieces.sr, min(pieces.start) as first, string_agg(concat_ws(':', kind, kept.start, kept.stop), '+' order by kept.start, kept.rank) as text
      from pieces join kept on kept.r = pieces.r and kept.start = pieces.start and kept.rank = pieces.rank group by pieces.r, pieces.s, pieces.sr),
c as (select r, string_agg(text, ',' order by first, text) as credentials from one group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(credentials, '') as credentials
from d left join s on d.r = s.r left join c on d.r = c.r
"""


#: Masks by cases, orders by a join of letters, outcomes by bit operations on masks.
OP11_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
m as (select part, case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
        + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end
        + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end + case when w.doc_id > first then 16 else 0 end as mask,
        coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l on w.doc_id = l.doc_id),
h as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
f as (select unnest(range(5)) as k),
o as (select [a.k, b.k, c.k, d.k, e.k] as p from f a, f b, f c, f d, f e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s as (select array_to_string(list_transform(p, lambda x: chr(cast(65 + x as int))), '') as filter_order, unnest(range(1, 6)) as step, p from o),
b as (select filter_order, step, 1 << p[step] as own, cast(list_sum(list_transform(p[1 : step - 1], lambda x: 1 << x)) as bigint) as before from s),
r as (select part, filter_order, cast(step as int) as step, own,
        sum(case when mask & own = 0 and mask & coalesce(before, 0) = 0 then n else 0 end) as kept,
        sum(case when mask & own > 0 and mask & coalesce(before, 0) = 0 then n else 0 end) as removed,
        sum(case when mask & own > 0 and mask & coalesce(before, 0) > 0 then n else 0 end) as redundant,
        sum(case when mask = own then n else 0 end) as unique_fails,
        sum(case when mask & own > 0 and mask & coalesce(before, 0) = 0 then good else 0 end) as good_lost,
        sum(case when mask & own > 0 and mask & coalesce(before, 0) = 0 then toxic else 0 end) as toxic_lost
      from h, b group by part, filter_order, step, own)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, own) as bigint) as shapley from r
"""


OP12_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_OP2_WORDS} as w from documents where text is not null),
c as (select count(*) as docs, cast(sum(len(w)) as bigint) as words from d where len(w) > 0),
b as (select item_id, unnest({_OP2_WORDS}) as term from benchmark where text is not null),
q as (select item_id, term, count(*) as q from b group by item_id, term),
t as (select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as term from d) where term in (select term from q) group by r, term),
f as (select term, count(*) as df from t group by term),
x as (select r, doc_id, t.term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))) as x from t join f on t.term = f.term, c),
s as (select item_id, r, any_value(doc_id) as doc_id, cast(sum(q * x) as bigint) as score from q join x on q.term = x.term group by item_id, r having sum(q * x) > 0),
k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank, doc_id, score from s)
select item_id, rank, doc_id, score from k where rank <= 10
"""


OP13_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r, a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.r <> b.r where a.vec_id % 20 = 0),
k as (select query_id, cast(row_number() over (partition by r order by score desc, vec_id nulls last) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from k where rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_decontamination": OP2_SQL, "op6_secrets": _op6_sql(), "op11_filter_audit": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_exact_topk": OP13_SQL}
