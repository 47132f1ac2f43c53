"""Regex matches with their places, by DataFrame functions alone.

Spark has no function for the offsets of matches.  Splitting a text by a
pattern gives the stretches between its matches, so match i starts after the
first i+1 stretches and the first i matches.  Those sums are taken in about
sqrt(n) blocks of sqrt(n) lengths, so a text with n matches costs n**1.5 steps
and not n**2.  Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An array element of a span; spans sort by start, then by the rank of their kind.
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def quoted(s: str) -> str:
    """``s`` as a SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Kind:
    """A kind of span: matches of ``pattern`` (Java) for which ``keep`` (SQL on ``v``, the match, and ``g``, its group) holds.

    ``gate``: SQL on the text column ``{text}``; no text without it has a match.
    """

    name: str
    pattern: str
    keep: str = "true"
    gate: str = "true"
    group: int = 0


def with_matches(df: DataFrame, text: str, kinds: list[Kind], context: int = 0) -> DataFrame:
    """``df`` with a column ``_m_<kind>`` for each kind: array of (start, v, g, before, after), unfiltered.

    ``before``, ``after``: up to ``context`` characters on both sides of the
    match, as far as the second match of the kind away.  A null text has no match.
    """
    t = f"`{text}`"
    values, groups, gaps, lengths, blocks, found = ({} for _ in range(6))
    for k in kinds:
        n, p = k.name, quoted(k.pattern)
        values[f"_v_{n}"] = F.expr(f"if({t} is not null and ({k.gate.format(text=t)}), regexp_extract_all({t}, {p}, 0), cast(array() as array<string>))")
        groups[f"_g_{n}"] = F.expr(f"if(size(`_v_{n}`) > 0, regexp_extract_all({t}, {p}, {k.group}), `_v_{n}`)") if k.group else F.col(f"_v_{n}")
        gaps[f"_p_{n}"] = F.expr(f"if(size(`_v_{n}`) > 0, split({t}, {p}, -1), `_v_{n}`)")
        lengths[f"_l_{n}"] = F.expr(f"zip_with(`_p_{n}`, `_v_{n}`, (p, v) -> cast(length(p) + coalesce(length(v), 0) as bigint))")
        width = f"cast(ceil(sqrt(greatest(size(`_v_{n}`), 1))) as int)"
        blocks[f"_w_{n}"] = F.expr(width)
        blocks[f"_b_{n}"] = F.expr(f"transform(sequence(0, cast(ceil(size(`_v_{n}`) / {width}) as int)), b -> aggregate(slice(`_l_{n}`, 1, b * {width}), 0L, (a, x) -> a + x))")
        start = f"(`_b_{n}`[i div `_w_{n}`] + aggregate(slice(`_l_{n}`, cast((i div `_w_{n}`) * `_w_{n}` + 1 as int), i % `_w_{n}`), 0L, (a, x) -> a + x) + length(`_p_{n}`[i]))"
        near = lambda side, *parts: f"{side}(concat({', '.join(parts)}), {context})"
        at = lambda side, i, n=n: f"coalesce({side}(get(`_p_{n}`, {i}), {context}), '')"
        other = lambda i, n=n: f"coalesce(get(`_v_{n}`, {i}), '')"
        before = near("right", at("right", "i - 1"), other("i - 1"), at("right", "i")) if context else "''"
        after = near("left", at("left", "i + 1"), other("i + 1"), at("left", "i + 2")) if context else "''"
        found[f"_m_{n}"] = F.expr(f"transform(`_v_{n}`, (v, i) -> named_struct('start', {start}, 'v', v, 'g', `_g_{n}`[i], 'before', {before}, 'after', {after}))")
    out = df
    for stage in (values, groups, gaps, lengths, blocks, found):
        out = out.withColumns(stage)
    return out.drop(*(c for stage in (values, groups, gaps, lengths, blocks) for c in stage))


def spans_of(kinds: list[Kind], first_rank: int = 0) -> Column:
    """The sorted spans of ``with_matches``'s columns that pass their kind's ``keep``."""
    each = []
    for rank, k in enumerate(kinds, first_rank):
        ok = k.keep.replace("{v}", "m.v").replace("{g}", "m.g")
        each.append(f"transform(filter(`_m_{k.name}`, m -> {ok}), m -> named_struct('start', m.start, 'rank', {rank}, 'kind', {quoted(k.name)}, 'end', m.start + length(m.v)))")
    return F.expr(f"cast(array_sort(concat({', '.join(each)})) as array<{SPAN}>)")


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def count_of(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = {quoted(kind)})) as bigint)")
