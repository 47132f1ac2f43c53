"""Secret scanning with multipart credential linking, by DataFrame functions alone.

Strong parts are reported wherever they stand: keyword assignments, access key
identifiers, long hexadecimal strings.  Weak parts are ordinary by themselves:
account names, endpoints, long base64-like strings.  They are reported only
where a complementary part lies in the same scope, at most ``SCOPE`` characters
away: a name or endpoint needs a secret, a base64-like string needs an
identifier or an endpoint.

The interval join is one sweep: a document's parts in order of their starts,
each with the nearest end before and the nearest start after it of every class.
Only documents that have complementary parts can matter, so only those with
weak parts, or with base parts of two classes, take part in it.

What the sweep leaves is linked into credentials by nearness.  Every identifier
and endpoint names its nearest secret in scope, every secret its nearest
identifier and its nearest endpoint: parts of the same line come before others,
then the smaller gap counts, and of equal gaps an identifier or endpoint that
stands before its secret.  Two parts that name each other are linked, so a part
is in one credential at most, and what nobody names back stays by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native_spans import SPAN, Kind, spans_of, with_matches
from .storage import written

SCOPE = 300

# The three base patterns.
BASE = [
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", "length({g}) >= 6", "contains({text}, '=') or contains({text}, ':')", 2),
    Kind("access", r"AKIA[A-Z0-9]+", "length({v}) >= 20", "contains({text}, 'AKIA')"),
    Kind("hex", r"[0-9a-f]{24,}"),
]
WEAK = [
    Kind("user", r"(?<![A-Za-z0-9_])(?i:(?:user(?:name)?|login|account|client_?id|access_key_id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,})", gate="contains({text}, '=') or contains({text}, ':')"),
    Kind("endpoint", r"(?<![A-Za-z0-9_])(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+", gate="contains({text}, '://')"),
    Kind("blob", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}={0,2}", gate="{text} rlike '[A-Za-z0-9+/_-]{{32}}'"),
]
CLASSES = {"identifier": ("access", "user"), "secret": ("assign", "hex", "blob"), "endpoint": ("endpoint",)}
NEEDS = {"user": ("secret",), "endpoint": ("secret",), "blob": ("identifier", "endpoint")}


def _near(parts: str, kinds: tuple[str, ...], scope: int, before: Window, after: Window) -> Column:
    of = F.col(f"{parts}.kind").isin(*kinds)
    ended = F.max(F.when(of, F.col(f"{parts}.end"))).over(before)
    begins = F.min(F.when(of, F.col(f"{parts}.start"))).over(after)
    return F.coalesce(F.col(f"{parts}.start") - ended <= scope, F.lit(False)) | F.coalesce(begins - F.col(f"{parts}.end") <= scope, F.lit(False))


#: Documents with complementary parts, or with weak ones that may have some.
_MATTERS = "size(weak) > 0 or (exists(base, b -> b.kind = 'access') and exists(base, b -> b.kind <> 'access'))"


def linked(found: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """(key, linked, credentials): the weak spans of each document that have a complementary part in scope and cross no base span, and the credentials.

    ``found``: key, ``base``, ``weak`` and ``breaks``, the places of line ends.
    A credential is kind:start:end of its parts, joined by ``+``.
    """
    base = tuple(k.name for k in BASE)
    line_ends = F.transform("breaks", lambda at: F.struct(at.alias("start"), F.lit(-1).alias("rank"), F.lit("line").alias("kind"), at.alias("end")))
    parts = found.select(*key, F.explode(F.concat("base", "weak", line_ends)).alias("p")).dropDuplicates([*key, "p"])
    order = Window.partitionBy(*key).orderBy("p.start", "p.rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = {f"near_{c}": _near("p", kinds, scope, before, after) for c, kinds in CLASSES.items()}
    strong = F.col("p.kind").isin(*base)
    crossed = F.greatest(F.max(F.when(strong, F.col("p.end"))).over(before) - F.col("p.start"), F.col("p.end") - F.min(F.when(strong, F.col("p.start"))).over(after))
    line = F.count_if(F.col("p.kind") == "line").over(order.rowsBetween(Window.unboundedPreceding, 0))
    swept = parts.withColumns(near | {"crossed": F.coalesce(crossed > 0, F.lit(False)), "line": line}).where("p.kind <> 'line'")
    wanted = F.lit(False)
    for kind, needs in NEEDS.items():
        ok = F.lit(False)
        for c in needs:
            ok = ok | F.col(f"near_{c}")
        wanted = wanted | ((F.col("p.kind") == kind) & ok)
    kept = swept.where(strong | (wanted & ~F.col("crossed"))).select(*key, "p", "line")
    weak = kept.where(~strong).groupBy(*key).agg(F.sort_array(F.collect_list("p")).alias("linked"))
    return weak.join(_credentials(kept, key, scope, before, after), key, "full_outer")


def _nearest(kinds: tuple[str, ...], scope: int, before: Window, after: Window, first_before: bool) -> Column:
    """The part of ``kinds`` that is nearest to a row's own: of its line, then by the gap, then on the side that is preferred.

    No part goes over a line's end, so of those before it the one that ends
    last is nearest, and of those after it the one that starts first.
    """
    of, own = F.col("p.kind").isin(*kinds), F.col("p")
    that = F.when(of, F.struct("p", "line"))
    left = F.max_by(that, F.when(of, F.struct(F.col("p.end"), -F.col("p.start"), -F.col("p.rank")))).over(before)
    right = F.min_by(that, F.when(of, F.struct("p.start", "p.rank"))).over(after)
    away = lambda x: F.greatest(own["start"] - x["p"]["end"], x["p"]["start"] - own["end"], F.lit(0))
    entry = lambda x, side: F.when(x.isNotNull() & (away(x) <= scope), F.struct((x["line"] != F.col("line")).alias("off"), away(x).alias("gap"), F.lit(side).alias("side"), x["p"].alias("p")))
    return F.least(entry(left, 0 if first_before else 1), entry(right, 1 if first_before else 0))["p"]


def _credentials(parts: DataFrame, key: list[str], scope: int, before: Window, after: Window) -> DataFrame:
    """(key, credentials): links that both parts name, put together by their secret."""
    secret = F.col("p.kind").isin(*CLASSES["secret"])
    to = {f"to_{c}": _nearest(kinds, scope, before, after, c != "secret") for c, kinds in CLASSES.items()}
    vote = lambda s, o: F.struct(s.alias("secret"), o.alias("other"))
    votes = F.when(secret, F.array(vote(F.col("p"), F.col("to_identifier")), vote(F.col("p"), F.col("to_endpoint")))).otherwise(F.array(vote(F.col("to_secret"), F.col("p"))))
    named = parts.withColumns(to).select(*key, F.inline(F.filter(votes, lambda v: v["secret"].isNotNull() & v["other"].isNotNull())))
    links = named.groupBy(*key, "secret", "other").count().where("count = 2")
    own = F.array_sort(F.array_append(F.collect_list("other"), F.first("secret")))
    each = links.groupBy(*key, "secret").agg(own.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), "+")
    listed = F.array_sort(F.collect_list(F.struct(F.col("parts")[0]["start"].alias("first"), text.alias("text"))))
    return each.groupBy(*key).agg(F.transform(listed, lambda c: c["text"]).alias("credentials"))


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, ``base`` and ``spans`` (base and linked ones), arrays sorted by start, then kind, and ``credentials``.

    Null and empty texts have no spans; null and repeated doc_ids are kept,
    each row with its own spans; extra columns are ignored.
    """
    rows = docs.select("doc_id", docs["text"].alias("_text"))
    key = ["_id", "_hash", "_length"]
    matched = with_matches(rows, "_text", BASE + WEAK).select(
        "doc_id",
        "_text",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.xxhash64("_text", F.col("doc_id").isNull()).alias("_hash"),
        F.coalesce(F.length("_text"), F.lit(0)).alias("_length"),
        spans_of(BASE).alias("base"),
        spans_of(WEAK, len(BASE)).alias("weak"),
    )
    matched = matched.withColumn("matters", F.expr(_MATTERS))
    breaks = F.transform("_m_break", lambda m: m["start"])
    found = written(with_matches(matched, "_text", [Kind("break", r"\n", gate="matters")]).select("doc_id", *key, "base", "weak", "matters", breaks.alias("breaks")), "secrets")
    some, rest = found.where("matters"), found.where("not matters")
    both = some.join(linked(some, key, scope), key, "left").unionByName(rest, allowMissingColumns=True)
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    all_ = F.array_sort(F.concat("base", F.coalesce("linked", none)))
    return both.select("doc_id", "base", all_.alias("spans"), F.coalesce("credentials", F.array().cast("array<string>")).alias("credentials"))
