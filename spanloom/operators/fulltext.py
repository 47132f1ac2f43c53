"""Full-text search as relational algebra: positional postings, boolean matching, BM25.

A posting has the places where a term stands in a document.  Columns are
streams of their own, far apart in the numbering of places, so no phrase goes
over their border.  Phrases are intersections of their tokens' place lists,
each moved to the phrase's begin; NEAR and column filters are conditions on
what is left.  Neither texts nor token lists are read by a search.  Lower ranks
are better.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.text import tokens
from ..storage import written

# Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Places of column k begin at k * STREAM.
STREAM = 1 << 40
#: Wanted terms up to which a scan tests tokens against a set, without a join.
FEW_TERMS = 20_000
#: Rows of what is asked for that go to every task.
FEW_ASKED = 200_000
#: Tokens whose hits are one task's.
TOKENS_A_TASK = 2_000_000


@dataclass(frozen=True)
class TextIndex:
    """What searches read: ``lengths`` (key, dl), ``postings`` (key, term, places, dl) and ``terms`` (term), the distinct ones in order.

    ``stats``: number and mean length of documents, where they are known.
    Without ``terms``, those of ``postings`` are listed when prefixes ask for them.
    """

    lengths: DataFrame
    postings: DataFrame
    key: str = "path"
    stats: tuple[float, float] | None = None
    terms: DataFrame | None = None

    def size(self) -> tuple[float, float]:
        if self.stats is not None:
            return self.stats
        s = self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        return float(s.n or 0), float(s.avgdl or 1)


def _streams(columns: tuple[str, ...]) -> list[Column]:
    return [tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]


def index(files: DataFrame, key: str = "path", columns: tuple[str, ...] = ("path", "content")) -> DataFrame:
    """The postings of ``files``, to be stored: key, term, places and dl.  A document's terms are gathered where it lies."""
    id_type = files.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, streams in zip(*batch.columns, strict=True):
                at: dict[str, list[int]] = {}
                streams = streams.as_py()
                for k, stream in enumerate(streams):
                    for place, term in enumerate(stream, k * STREAM):
                        at.setdefault(term, []).append(place)
                n = sum(map(len, streams))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(at), to_arrow_type(id_type)), pa.array(at, pa.string()), pa.array(at.values(), pa.list_(pa.int64())), pa.array([n] * len(at), pa.int32())], names=[key, "term", "places", "dl"])

    return files.select(key, F.array(*_streams(columns)).alias("streams")).mapInArrow(run, f"`{key}` {id_type.simpleString()}, term string, places array<bigint>, dl int")


def lengths_of(files: DataFrame, key: str = "path", columns: tuple[str, ...] = ("path", "content")) -> DataFrame:
    return files.select(key, sum((F.size(s) for s in _streams(columns)), F.lit(0)).alias("dl"))


def by_term(postings: DataFrame, key: str = "path") -> DataFrame:
    """``postings`` laid out for lookups: ranges of terms, common ones over several files, so that a scan skips what is not asked for."""
    return postings.repartitionByRange("term", key).sortWithinPartitions("term", key)


def _kept(files: DataFrame, keep: tuple[list[str], list[str]] | None, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Places (key, term, places, dl) of the terms that are in, or begin with, ``keep``, or of all; a document's are gathered where it lies.

    A length stands beside them, as that of the empty term.
    """
    id_type, width = files.schema[key].dataType, len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        rows = lambda ids, terms, ends, places, dl: pa.RecordBatch.from_arrays([ids, terms, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int64())), pa.array(dl, pa.int32())], names=[key, "term", "places", "dl"])
        for batch in batches:
            ids, streams = batch.column(0), batch.column(1).flatten()
            sizes = streams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            dl = sizes.reshape(-1, width).sum(axis=1)
            yield rows(ids, pa.array([""] * len(ids), pa.string()), np.arange(len(ids) + 1), np.zeros(len(ids), np.int64), dl)
            coded = streams.flatten().dictionary_encode()
            terms, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(code):
                continue
            begins = np.cumsum(sizes) - sizes
            if keep is None:
                at = np.arange(len(code))
            else:
                of = pc.is_in(terms, value_set=pa.array(keep[0], pa.string()))
                for start in keep[1]:
                    of = pc.or_(of, pc.starts_with(terms, start))
                at = np.flatnonzero(of.to_numpy(zero_copy_only=False)[code])
            stream = np.searchsorted(begins + sizes, at, side="right")
            place, code, doc = at - begins[stream] + stream % width * STREAM, code[at], stream // width
            order = np.argsort(doc * len(terms) + code, kind="stable")
            doc, code, place = doc[order], code[order], place[order]
            first = np.flatnonzero(np.diff(doc * len(terms) + code, prepend=-1))
            if len(first):
                yield rows(ids.take(pa.array(doc[first])), terms.take(pa.array(code[first])), np.append(first, len(doc)), place, dl[doc[first]])

    return files.select(key, F.array(*_streams(columns)).alias("streams")).mapInArrow(run, f"`{key}` {id_type.simpleString()}, term string, places array<bigint>, dl int")


def _each_once(postings: DataFrame, key: str) -> DataFrame:
    """``postings`` in which documents of one key are one document."""
    one = postings.where("term = ''")
    # hashes of keys are dealt; the keys themselves only where one repeats
    hashes = one.groupBy(F.xxhash64(key).alias("_hash")).agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    if (hashes := written(hashes, "hashes")).isEmpty():
        return postings
    again = one.withColumn("_hash", F.xxhash64(key)).join(hashes, "_hash", "left_semi").groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    if again.isEmpty():
        return postings
    same = F.col(key).eqNullSafe(F.col("_key"))
    merged = postings.join(again, same, "left_semi").groupBy(key, "term").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"), F.first("dl").alias("dl"))
    return written(postings.join(again, same, "left_anti").unionByName(merged.withColumn("places", F.when(F.col("term") == "", F.array(F.lit(0).cast("long"))).otherwise(F.col("places")))), "postings")


def scanned(files: DataFrame, wanted: DataFrame, key: str = "path", columns: tuple[str, ...] = ("path", "content")) -> TextIndex:
    """A search's own index, where none is stored: one pass over ``files`` that keeps lengths and the places of ``wanted``'s terms.

    Tokens are not shuffled: a document's are gathered in its task, other terms
    dropped there (where ``FEW_TERMS`` are exceeded, by a join), and what is
    left is written to the shared folder.
    """
    single = wanted.select(F.explode("toks").alias("term")).distinct()
    starts = sorted({r[0] for r in wanted.where("prefix and size(toks) > 0").select(F.element_at("toks", -1)).collect()})  # bounded: the phrases asked for
    some = [r[0] for r in single.limit(FEW_TERMS + 1).collect()]
    few = len(some) <= FEW_TERMS
    flat = _kept(files, (some, starts) if few else None, key, columns)
    if not few:
        begins = F.exists(F.lit(starts), lambda s: F.startswith("term", s)) if starts else F.lit(False)
        flat = flat.join(single.withColumn("_asked", F.lit(True)), "term", "left").where(F.col("_asked") | (F.col("term") == "") | begins).select(key, "term", "places", "dl")
    counted = _each_once(written(flat, "postings"), key)
    return TextIndex(counted.where("term = ''").select(key, "dl"), counted.where("term <> ''"), key)


def local(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    """A few rows as a local relation, so that what comes to nothing is planned away."""
    schema = StructType.fromDDL(ddl)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=arrow), schema)


def _matching(ix: TextIndex, each: DataFrame, asked: list[str]) -> DataFrame:
    """``each`` token (column term) with every term of the index that it, or what it begins, stands for; ``asked``: all such beginnings.

    What begins so is a range of the dictionary, whose order the scan of it uses.
    """
    if not asked:
        return each
    listed = ix.terms if ix.terms is not None else ix.postings.select("term")
    span = F.lit(False)
    for p in asked:  # ranges of the dictionary's order
        span = span | ((F.col("term") >= p) & F.startswith("term", F.lit(p)))
    sizes = sorted({len(p) for p in asked})
    found = listed.where(span).distinct().withColumn("_size", F.explode(F.filter(F.lit(sizes).cast("array<int>"), lambda n: n <= F.length("term")))).withColumn("_p", F.expr("left(term, _size)"))
    return each.where("not begins").unionByName(each.where("begins").withColumnRenamed("term", "_p").join(found, "_p").select(each.columns))


def small(asked: DataFrame) -> DataFrame:
    """``asked`` for every task, unless it is large."""
    return F.broadcast(asked) if asked.limit(FEW_ASKED + 1).count() <= FEW_ASKED else asked


def _held(asked: DataFrame) -> DataFrame:
    """``asked``, which is as small as what is asked for, as data of its own."""
    return asked.sparkSession.createDataFrame(asked.toArrow(), asked.schema)


def _by_document(ix: TextIndex, found: DataFrame) -> DataFrame:
    """Hits of a document in one task: what is then grouped by query and document is not shuffled again."""
    n, avgdl = ix.size()
    often = min(found.sparkSession.sparkContext.defaultParallelism, int(20 * n * avgdl / TOKENS_A_TASK) + 1)
    return found.repartition(max(often, int(n * avgdl / TOKENS_A_TASK) + 1), ix.key)


def phrases(ix: TextIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, phrase_ord, key, starts, tf, dl) of ``wanted``'s phrases in documents that have them; ``starts`` are the places where one begins.

    ``wanted``: query_id, phrase_ord, toks, prefix (of the last token), and perhaps ``columns``, ``first`` and ``distance``.
    A posting of a phrase of one token, which no place restricts, is its answer as it lies, and has no ``starts``.
    """
    key = ix.key
    for name, default in (("columns", "cast(null as array<int>)"), ("first", "false")):
        if name not in wanted.columns:
            wanted = wanted.withColumn(name, F.expr(default))
    some = wanted.where("size(toks) > 0")
    asked = sorted({r[0] for r in some.where("prefix").select(F.element_at("toks", -1)).collect()})  # bounded: the phrases asked for
    named = some.select("query_id", "phrase_ord", "prefix", "columns", "first", F.size("toks").alias("n"), F.posexplode("toks").alias("k", "term"), (F.col("distance").isNotNull() if "distance" in some.columns else F.lit(False)).alias("near"))
    alone = (F.col("n") == 1) & ~F.col("prefix") & F.col("columns").isNull() & ~F.col("first") & ~F.col("near")
    each = _matching(ix, named.where(~alone).withColumn("begins", F.col("prefix") & (F.col("k") == F.col("n") - 1)).drop("prefix", "near"), asked)
    postings = ix.postings
    if ix.terms is not None and len(terms := sorted({t for r in some.select("toks").collect() for t in r[0]})) <= FEW_TERMS:
        of = F.col("term").isin(terms)  # reaches the scan, which is in order of terms
        for p in asked:
            of = of | F.startswith("term", F.lit(p))
        postings = postings.where(of)
    single = postings.select(key, "term", F.size("places").cast("long").alias("tf"), "dl").join(small(named.where(alone).select("query_id", "phrase_ord", "term")), "term")
    single = single.select("query_id", "phrase_ord", key, F.lit(None).cast("array<bigint>").alias("starts"), "tf", "dl")
    if named.where(~alone).isEmpty():
        return single
    met = postings.join(small(each), "term").select("query_id", "phrase_ord", "n", "columns", "first", key, "dl", "k", F.transform("places", lambda p: p - F.col("k")).alias("at"))
    # a token's places are those of all its terms; a phrase stands where all its tokens' lists agree
    whole = met.groupBy("query_id", "phrase_ord", key).agg(F.collect_list(F.struct("k", "at")).alias("parts"), *(F.first(c).alias(c) for c in ("n", "columns", "first", "dl")))
    places = lambda k: F.flatten(F.transform(F.filter("parts", lambda p: p["k"] == k), lambda p: p["at"]))
    agreed = F.aggregate(F.sequence(F.lit(1), F.col("n") - 1), places(F.lit(0)), lambda a, k: F.array_intersect(a, places(k)))
    starts = F.when(F.col("n") == 1, F.flatten(F.transform("parts", lambda p: p["at"]))).otherwise(agreed)
    of = lambda s: (F.col("columns").isNull() | F.array_contains("columns", F.floor(s / STREAM).cast("int"))) & (~F.col("first") | (s % STREAM == 0))
    plain = F.col("columns").isNull() & ~F.col("first")
    placed = whole.where("n <= size(parts)").withColumn("starts", starts).withColumn("starts", F.when(plain, F.col("starts")).otherwise(F.filter("starts", of)))
    return single.unionByName(placed.where("size(starts) > 0").select("query_id", "phrase_ord", key, "starts", F.size("starts").cast("long").alias("tf"), "dl"))


def near(found: DataFrame, asked: DataFrame, key: str = "path") -> DataFrame:
    """``found`` without the places of NEAR's phrases that are in no clump: places of all its phrases, one column, of which the last begins at most ``distance`` tokens after any ends."""
    groups = asked.where("distance is not null").select("query_id", "phrase_ord", "atom", "distance", F.size("toks").alias("n")).distinct()
    need = groups.groupBy("query_id", "atom").agg(F.count("*").alias("need"))
    sides = found.join(F.broadcast(groups), ["query_id", "phrase_ord"]).groupBy("query_id", "atom", key).agg(F.collect_list(F.struct("phrase_ord", "n", "starts")).alias("sides"), F.first("distance").alias("distance"), F.first("dl").alias("dl"))
    whole = sides.join(F.broadcast(need), ["query_id", "atom"]).where("size(sides) = need")
    fits = lambda last, start, n: (start <= last) & (start >= last - n - F.col("distance"))
    lasts = F.filter(F.array_distinct(F.flatten(F.transform("sides", lambda s: s["starts"]))), lambda last: F.forall("sides", lambda s: F.exists(s["starts"], lambda x: fits(last, x, s["n"]))))
    kept = F.transform("sides", lambda s: F.struct(s["phrase_ord"], F.filter(s["starts"], lambda x: F.exists("lasts", lambda last: fits(last, x, s["n"]))).alias("starts")))
    clumps = whole.withColumn("lasts", lasts).where("size(lasts) > 0").select("query_id", key, "dl", F.inline(kept))
    rest = found.join(F.broadcast(groups.select("query_id", "phrase_ord")), ["query_id", "phrase_ord"], "left_anti")
    return rest.unionByName(clumps.withColumn("tf", F.size("starts").cast("long")).select(found.columns))


def _idf(n: float) -> Column:
    return F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))


def _weight(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def bm25_scores(ix: TextIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, key, score, have): summed weights of the phrases of ``wanted`` found, and how many they are.

    A phrase is looked up once, however many queries ask for it, and hits are
    dealt by document before they become rows of queries.
    """
    n, avgdl = ix.size()
    phrase = F.concat(F.array_join("toks", " "), F.when(F.col("prefix"), "*").otherwise(""))
    asked = wanted.where("size(toks) > 0").select("query_id", phrase.alias("phrase_ord"), "toks", "prefix")
    found = phrases(ix, asked.select(F.lit(0).alias("query_id"), "phrase_ord", "toks", "prefix").distinct()).select("phrase_ord", ix.key, "tf", "dl")
    df = found.groupBy("phrase_ord").agg(F.count("*").alias("df"))
    weighed = asked.select("query_id", "phrase_ord").join(df, "phrase_ord").select("query_id", "phrase_ord", _idf(n).alias("idf"))
    if asked.limit(FEW_ASKED + 1).count() <= FEW_ASKED:
        weighed = F.broadcast(weighed)
    each = _by_document(ix, found.withColumn("w", _weight(F.col("tf"), F.col("dl"), avgdl)).drop("tf", "dl"))
    return each.join(weighed, "phrase_ord").groupBy("query_id", ix.key).agg((-F.sum(F.col("idf") * F.col("w"))).alias("score"), F.count("*").alias("have"))


def best(summed: DataFrame, most: int, key: str = "path") -> DataFrame:
    """(query_id, key, score, rank) of the best ``most`` documents of each query; ties go by key."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9), key)
    return summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", key, "score", "rank")


def search(ix: TextIndex, wanted: DataFrame, any_of: bool, most: int) -> DataFrame:
    """BM25 hits of ``wanted`` phrases under AND, or under OR if ``any_of``."""
    summed = bm25_scores(ix, wanted)
    if not any_of:
        summed = summed.join(wanted.groupBy("query_id").agg(F.count("*").alias("need")), "query_id").where("have >= need")
    return best(summed, most, ix.key)


def ordered_union(parts: list[DataFrame], most: int, key: str = "path") -> DataFrame:
    """Hits (query_id, key, rank) of several searches one after the other, each document once, at most ``most`` a query."""
    both = None
    for k, p in enumerate(parts):
        p = p.select("query_id", key, F.lit(k).alias("_part"), F.col("rank").alias("_rank"))
        both = p if both is None else both.unionByName(p)
    return first_seen(both, ["_part", "_rank"], most, key)


def first_seen(hits: DataFrame, order: list[str], most: int, key: str = "path") -> DataFrame:
    """(query_id, key, rank): each document of a query once, where it comes first in ``order``, at most ``most`` a query."""
    once = Window.partitionBy("query_id", key).orderBy(*order)
    rank = Window.partitionBy("query_id").orderBy(*order, key)
    first = hits.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return first.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most).select("query_id", key, "rank")


#: Phrases that one number tells of whether they are there.
BITS = 62


def search_expressions(ix: TextIndex, wanted: DataFrame, most: int) -> DataFrame:
    """BM25 hits of expressions: ``wanted`` is what ``phrases`` takes with group, negated, atom and distance; a phrase has a row for each group.

    A document answers if it has all atoms of some group and none that the
    group negates; every phrase it has that is not negated adds to its score.

    A phrase is looked up once, however many queries ask for it, and hits are
    dealt by document before they become rows of queries.  Which phrases of a
    query a document has is bits of numbers.  Groups that need a phrase which
    no document has are left out before.
    """
    asked, key = wanted.where("size(toks) > 0"), ix.key
    # NEAR judges phrases by their atom, so its are told apart by query
    alone = F.when(F.col("distance").isNotNull(), F.struct("query_id", "phrase_ord"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("phrase_ord")) - 1
    once = asked.dropDuplicates(["query_id", "phrase_ord"]).withColumn("phrase", F.dense_rank().over(Window.orderBy("toks", "prefix", "columns", "first", alone))).withColumn("_at", place)
    once = once.withColumns({"_word": F.floor(F.col("_at") / BITS).cast("int"), "_bit": F.expr(f"shiftleft(1L, _at % {BITS})")})
    once = _held(once.select("query_id", "phrase_ord", "toks", "prefix", "columns", "first", "distance", "atom", "phrase", "_word", "_bit"))
    words = range((once.agg(F.max("_word")).first()[0] or 0) + 1)
    single = once.dropDuplicates(["phrase"]).select(F.lit(0).alias("query_id"), F.col("phrase").alias("phrase_ord"), "toks", "prefix", "columns", "first", "distance", F.struct("query_id", "atom").alias("atom"))
    everywhere = phrases(ix, single)
    found = everywhere if wanted.where("distance is not null").isEmpty() else near(everywhere, single, key)
    n, avgdl = ix.size()
    df = _held(everywhere.groupBy(F.col("phrase_ord").alias("phrase")).agg(F.count("*").alias("df")))

    # of every alternative the bits of phrases that must be there and, for each atom that must not, of one that is only there with it
    leaves = asked.select("query_id", "group", "atom", "negated", "phrase_ord").join(once.select("query_id", "phrase_ord", "phrase", "_word", "_bit"), ["query_id", "phrase_ord"]).join(df, "phrase", "left")
    first = F.row_number().over(Window.partitionBy("query_id", "group", "atom").orderBy("phrase_ord")) == 1
    bits = lambda what, k: F.coalesce(F.bit_or(F.when(what & (F.col("_word") == k), F.col("_bit"))), F.lit(0).cast("long"))
    groups = leaves.withColumn("_first", first).groupBy("query_id", "group").agg(
        F.array(*(bits(~F.col("negated"), k) for k in words)).alias("need"), F.array(*(bits(F.col("negated") & F.col("_first"), k) for k in words)).alias("bad"),
        F.bool_or(~F.col("negated") & F.col("df").isNull()).alias("lacking"),
    )
    groups = groups.where(F.exists("need", lambda x: x != 0))
    per_query = _held(groups.where("not lacking").groupBy("query_id").agg(F.collect_list(F.struct("need", "bad")).alias("groups")))
    counted = leaves.join(groups.select("query_id", "group"), ["query_id", "group"], "left_semi").where("not negated").select("query_id", "phrase_ord", F.lit(True).alias("_counts")).distinct()
    asking = once.join(per_query, "query_id", "left_semi").join(df, "phrase").join(counted, ["query_id", "phrase_ord"], "left").select("query_id", "phrase", "_word", "_bit", F.when(F.col("_counts"), _idf(n)).alias("_idf"))
    asking = small(_held(asking))

    hits = found.select(F.col("phrase_ord").alias("phrase"), key, _weight(F.col("tf"), F.col("dl"), avgdl).alias("w"))
    rows = _by_document(ix, hits.join(F.broadcast(asking.select("phrase").distinct()), "phrase", "left_semi")).join(asking, "phrase")
    have = [F.bit_or(F.when(F.col("_word") == k, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"_have{k}") for k in words]
    summed = rows.groupBy("query_id", key).agg((-F.sum(F.col("_idf") * F.col("w"))).alias("score"), *have).join(small(per_query), "query_id")
    fits = lambda g, k: (F.col(f"_have{k}").bitwiseAND(g["need"][k]) == g["need"][k]) & (F.col(f"_have{k}").bitwiseAND(g["bad"][k]) == 0)
    return best(summed.where(F.exists("groups", lambda g: reduce(and_, (fits(g, k) for k in words)))), most, key)
