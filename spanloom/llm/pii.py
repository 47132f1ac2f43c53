"""Personal data by weak supervision, by DataFrame functions alone.

Strict patterns (with checks: Luhn, octets, digit counts) are reported as they
are.  They and looser candidates - what matches a strict pattern but fails its
check, numbers, written-out addresses, names after titles - are voted on by
labelers that look at different things: a regex check, a gazetteer (issuer
prefixes, country codes, address ranges, providers, names), the words on both
sides, the shape, and whether other personal data stands close by.  A vote is
1, 0 (abstains) or -1.

Expectation-maximisation (Dawid and Skene) estimates from the votes alone how
reliable each labeler is for each kind.  Its posteriors then train the final
span classifier, a logistic regression on features of the span and of its
surroundings: separators, length, leading digit, the characters next to it,
the words on each side, the check and the company.  It decides which loose
candidates become spans, and gives strict ones a probability as well, so those
that fit a pattern by chance can be told.

What reaches the driver is bounded: 3**5 vote patterns a kind for EM, which
covers every candidate of the corpus, and for the classifier a sample, the
``PATTERNS`` most frequent patterns of votes and features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import SPAN, Kind, quoted, spans_of, with_matches
from .storage import written

_LUHN = "aggregate(sequence(1, length(regexp_replace({v}, '[ -]', ''))), 0, (a, i) -> a + (cast(substr(reverse(regexp_replace({v}, '[ -]', '')), i, 1) as int) * if(i % 2 = 0, 2, 1)) - if(i % 2 = 0 and cast(substr(reverse(regexp_replace({v}, '[ -]', '')), i, 1) as int) > 4, 9, 0)) % 10 = 0"
_OCTETS = r"forall(split({v}, '\\.'), o -> length(ltrim('0', o)) <= 3 and cast(concat('0', right(ltrim('0', o), 3)) as int) <= 255)"
_DIGITS = "length(regexp_replace({v}, '[^0-9]', ''))"

# The four base patterns. Lookbehinds and possessive groups change no match; they keep long runs linear.
BASE = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", gate="contains({text}, '@')"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", _OCTETS, "{text} rlike '[0-9][.][0-9]'"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", f"{_DIGITS} between 12 and 19 and {_LUHN}", "{text} rlike '[0-9]{{3}}|[0-9][ -][0-9]'"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{_DIGITS} between 9 and 15", "contains({text}, '+')"),
]
LOOSE = [
    Kind("number", r"(?=[0-9(])(?<![0-9A-Za-z+.,-])(?<!\+[0-9]{1,3}[\x20.-]{0,2})(?![0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]))[(]?[0-9](?:[\x20().-]?[0-9]|[().-]\x20?[(]?[0-9]){6,10}+(?![0-9A-Za-z])(?![\x20.-][0-9])", gate="{text} rlike '(?:[0-9][(). -]{{0,3}}){{7}}'"),
    Kind("address", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}+", gate="contains({text}, '(at)') or contains({text}, '[at]') or contains({text}, ' dot ')"),
    Kind("name", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sra?|Don|Dona)\b\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?", gate=" or ".join(f"contains({{text}}, '{t}')" for t in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr", "Don"))),
]
KINDS = BASE + LOOSE
CONTEXT = 40
#: The most frequent patterns of votes and features that the classifier is fitted to.
PATTERNS = 20_000

# Words of the context labeler, by kind; those that speak for personal data, and those that speak against it.
CONTEXT_WORDS = {
    "email": ["mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel"],
    "ip": ["ip", "host", "server", "address", "login", "from", "client", "adresse"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "debit", "cvv", "exp", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "mobile", "cell", "fax", "call", "contact", "telefon", "handy", "téléphone", "teléfono", "móvil", "whatsapp"],
    "number": ["phone", "tel", "mobile", "cell", "fax", "call", "contact", "account", "iban", "ssn", "passport", "telefon", "handy", "téléphone", "teléfono", "móvil", "whatsapp"],
    "address": ["mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel"],
    "name": ["name", "patient", "client", "customer", "signed", "contact", "from", "dear", "born"],
}
OTHER_WORDS = {
    "email": ["example", "placeholder"],
    "ip": ["version", "release", "section", "chapter", "v"],
    "card": ["isbn", "order", "invoice", "tracking", "serial", "ref", "version", "build"],
    "phone": ["version", "isbn", "score"],
    "number": ["total", "version", "isbn", "order", "invoice", "units", "price", "page"],
    "address": ["look", "meet", "arrive"],
    "name": ["street", "avenue", "university", "hospital"],
}
# The gazetteers; card issuers' prefixes and lengths, country codes, ranges that are no one's address, mail providers, and common first and family names.
ISSUERS = "4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|35[0-9]{14}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}"
COUNTRIES = "1[2-9]|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
NO_ONE = "0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]"
PRIVATE = "10[.]|192[.]168[.]|172[.](?:1[6-9]|2[0-9]|3[01])[.]"
PROVIDERS = ["gmail", "yahoo", "hotmail", "outlook", "icloud", "proton", "aol", "gmx", "web", "mail", "example", "orange", "live"]
NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Maria", "Anna", "Thomas", "Peter", "Hans", "Klaus", "Jean", "Marie", "Pierre", "Jose", "Carmen", "Smith", "Jones", "Brown", "Miller", "Garcia", "Martin", "Muller", "Schmidt", "Lopez"]
LABELERS = ("check", "gazetteer", "context", "shape", "company")
#: Features and their numbers of values.
FEATURES = {"sep": 6, "size": 8, "lead": 11, "left": 6, "right": 6, "said": 4, "check": 3, "company": 2}
#: Other personal data, as seen in what stands around a span.
_COMPANY = "[A-Za-z0-9]@[A-Za-z0-9-]+[.]|[+][0-9][ ().0-9-]{7}|[0-9][.][0-9]+[.][0-9]+[.][0-9]|[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"


def _says(text: str, words: list[str]) -> str:
    """SQL: one of the words stands in the text."""
    return f"lower({text}) rlike '(?:^|[^\\\\p{{L}}])(?:{'|'.join(words)})(?:[^\\\\p{{L}}]|$)'"


def _votes(kind: Kind) -> dict[str, str]:
    """SQL of the votes on a match ``m`` of ``with_matches``, by labeler."""
    d, name = "regexp_replace(m.v, '[^0-9]', '')", kind.name
    passes = f"case when {kind.keep.replace('{v}', 'm.v')} then 1 else -1 end"
    if name == "email":
        check = "case when m.v rlike '[.][A-Za-z]{2,24}$' then 1 else -1 end"
        gazetteer = f"case when lower(m.v) rlike '@(?:.*[.])?(?:{'|'.join(PROVIDERS)})[0-9]*[.]' then 1 else 0 end"
        shape = "case when m.v rlike '^[.]|[.][.]|[.]@' then -1 else 1 end"
    elif name == "ip":
        check, gazetteer = passes, f"case when m.v rlike '^(?:{NO_ONE})[.]' then -1 when m.v rlike '^(?:{PRIVATE})' then 0 else 1 end"
        shape = "case when m.v rlike '(?:^|[.])0[0-9]' then -1 else 0 end"
    elif name == "card":
        check, gazetteer = passes, f"case when {d} rlike '^(?:{ISSUERS})$' then 1 else -1 end"
        shape = "case when m.v rlike '^[0-9]{4}([ -])[0-9]{4}\\\\1[0-9]{4}\\\\1[0-9]{4}$' or m.v rlike '^[0-9]{4}([ -])[0-9]{6}\\\\1[0-9]{5}$' then 1 when m.v rlike '^[0-9]+$' then 0 else -1 end"
    elif name == "phone":
        check, gazetteer = passes, f"case when {d} rlike '^(?:{COUNTRIES})' then 1 else 0 end"
        shape = "case when m.v rlike '^[+][0-9]{1,3}[ .-]?[(]?[0-9]{1,4}[)]?(?:[ .-]?[0-9]{2,8}){1,5}$' then 1 else -1 end"
    elif name == "number":
        check = "case when m.v rlike '^[(]?[0-9]{3}[) .-]+[0-9]{3}[ .-][0-9]{4}$' or m.v rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' then 1 when m.v rlike '^[0-9]+$' then 0 else -1 end"
        gazetteer = f"case when {d} rlike '^(?:00|0[1-9]|1[2-9][0-9]{{9}}$|[2-9][0-9]{{9}}$)' and length({d}) between 9 and 13 then 1 else 0 end"
        shape = f"case when m.v rlike '^(?:19|20)[0-9]{{2}}[-.]' or m.v rlike '^[0-9]{{1,3}}(?:[.][0-9]{{3}})+$' or {d} rlike '^([0-9])\\\\1+$' or {d} rlike '^0?123456' then -1 else 0 end"
    elif name == "address":
        check = "case when lower(m.v) rlike '[.)\\\\] ](?:com|org|net|edu|de|fr|es|io|co|uk)$' then 1 else -1 end"
        gazetteer = f"case when lower(m.v) rlike '\\\\b(?:{'|'.join(PROVIDERS)})[0-9]*\\\\b' then 1 else 0 end"
        shape = "case when m.v rlike '^(?:[Mm]eet|[Ll]ook|[Aa]rrive|be|is|was|are|were|not|all) ' then -1 else 0 end"
    else:
        check = "case when m.v rlike ' [A-Z][a-z]+ [A-Z][a-z]+$' then 1 else 0 end"
        gazetteer = f"case when m.v rlike ' (?:{'|'.join(NAMES)})\\\\b' then 1 else 0 end"
        shape = "case when m.v rlike ' (?:The|And|This|That|Das|Die|Der|Les?|La|El|Los|Las)\\\\b' then -1 else 0 end"
    around = "concat_ws(' | ', m.before, m.after)"
    context = f"case when {_says(around, OTHER_WORDS[name])} then -1 when {_says(around, CONTEXT_WORDS[name])} then 1 else 0 end"
    company = f"case when {around} rlike '{_COMPANY}' then 1 else 0 end"
    return dict(zip(LABELERS, (check, gazetteer, context, shape, company), strict=True))


def _features(kind: Kind, votes: dict[str, str]) -> dict[str, str]:
    """SQL of the features of a match ``m``, by name; whole numbers from 0."""
    next_to = lambda c: f"case when {c} = '' or {c} rlike '[\\\\n\\\\r]' then 0 when {c} rlike '\\\\p{{L}}' then 1 when {c} rlike '[0-9]' then 2 when {c} rlike '[:=#]' then 3 when {c} rlike '[ \\\\t]' then 4 else 5 end"
    return {
        "sep": "case when m.v rlike '[(]' then 1 when contains(m.v, '@') then 2 when contains(m.v, ' ') then 3 when contains(m.v, '-') then 4 when contains(m.v, '.') then 5 else 0 end",
        "size": "least(length(m.v) div 4, 7)",
        "lead": "coalesce(cast(nullif(regexp_extract(m.v, '[0-9]', 0), '') as int), 10)",
        "left": next_to("right(m.before, 1)"),
        "right": next_to("left(m.after, 1)"),
        "said": f"if({_says('m.before', CONTEXT_WORDS[kind.name])}, 1, 0) + if({_says('m.after', CONTEXT_WORDS[kind.name])}, 2, 0)",
        "check": f"1 + {votes['check']}",
        "company": votes["company"],
    }


def candidates() -> Column:
    """Sorted candidate spans of ``with_matches``'s columns, each with ``base``, its ``votes`` and its features ``f``."""
    each = []
    for rank, k in enumerate(KINDS):
        votes = _votes(k)
        strict = k.keep.replace("{v}", "m.v") if rank < len(BASE) else "false"
        # of numbers that strict patterns match too loosely, those of a card's length are candidates
        among = "filter(`_m_card`, m -> length(regexp_replace(m.v, '[^0-9]', '')) between 12 and 19)" if k.name == "card" else f"`_m_{k.name}`"
        fields = [f"'{n}', cast({x} as int)" for n, x in votes.items()], [f"'{n}', cast({x} as int)" for n, x in _features(k, votes).items()]
        each.append(
            f"transform({among}, m -> named_struct('start', m.start, 'rank', {rank}, 'kind', {quoted(k.name)}, 'end', m.start + length(m.v), 'base', {strict}, "
            f"'votes', named_struct({', '.join(fields[0])}), 'f', named_struct({', '.join(fields[1])})))"
        )
    return F.expr(f"array_sort(concat({', '.join(each)}))")


#: P(vote -1, 0, 1 | no personal data, personal data) from which EM starts, worth 20 candidates: labelers are better than chance, the check most.
_START = {n: ((0.3, 0.6, 0.1), (0.1, 0.45, 0.45)) for n in LABELERS} | {"check": ((0.6, 0.25, 0.15), (0.05, 0.15, 0.8))}


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(table, posteriors, share) of one kind by EM over (votes, count): table[labeler, class, vote + 1], a posterior for each row."""
    start = np.array([_START[n] for n in LABELERS])
    votes = np.array([v for v, _ in counts], int).reshape(-1, len(LABELERS)) + 1
    n = np.array([c for _, c in counts], float)
    table, share, post, k = start, 0.3, np.zeros(len(n)), np.arange(len(LABELERS))
    for _ in range(rounds):
        like = [np.prod(table[k, c, votes], axis=1) for c in (0, 1)]
        post = share * like[1] / (share * like[1] + (1 - share) * like[0])
        share = ((post * n).sum() + 3) / (n.sum() + 10)
        mass = 20 * start
        for c, p in ((0, 1 - post), (1, post)):
            for j in range(len(LABELERS)):
                mass[j, c] += np.bincount(votes[:, j], p * n, minlength=3)
        table = mass / mass.sum(axis=2, keepdims=True)
    return table, post, share


def trained(features: np.ndarray, post: np.ndarray, n: np.ndarray, ridge: float = 0.1, steps: int = 30) -> tuple[float, dict[str, list[float]]]:
    """(bias, weights of each feature's values): logistic regression on posteriors, from zero weights, by Newton steps."""
    width = sum(FEATURES.values())
    at = np.cumsum([0, *FEATURES.values()])[:-1]
    x = np.zeros((len(features), width + 1))
    x[:, -1] = 1
    for j, a in enumerate(at):
        x[np.arange(len(x)), a + features[:, j]] = 1
    w, penalty = np.zeros(width + 1), np.r_[np.full(width, ridge), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - post)) + penalty * w
        hess = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 4 / max(np.abs(move).max(), 1e-12))
    return float(w[-1]), {f: [float(v) for v in w[a : a + m]] for (f, m), a in zip(FEATURES.items(), at, strict=True)}


@dataclass
class SpanClassifier:
    """Logistic regression on span features, by kind; ``reliability``: what EM found, by kind (labeler, class, vote)."""

    bias: dict[str, float]
    weights: dict[str, dict[str, list[float]]]
    reliability: dict[str, np.ndarray]

    def margin(self, kind: str, f: str) -> str:
        """SQL: the log-odds that the span of a kind and features is personal data; none is for kinds never seen."""
        each = []
        for k, b in sorted(self.bias.items()):
            terms = [f"element_at(array({', '.join(f'{round(v, 9)!r}D' for v in vs)}), {f}.{name} + 1)" for name, vs in self.weights[k].items()]
            each.append(f"when {quoted(k)} then {' + '.join([f'{round(b, 9)!r}D', *terms])}")
        return f"(case {kind} {' '.join(each)} else -30D end)" if each else "-30D"


Patterns = list[tuple[str, tuple[int, ...], tuple[int, ...], int]]


def patterns(found: DataFrame, most: int = PATTERNS) -> tuple[list[tuple[str, tuple[int, ...], int]], Patterns]:
    """(kind, votes, count) over all candidates, and (kind, votes, features, count) of the ``most`` frequent patterns."""
    each = found.select(F.explode("candidates").alias("c"))
    votes, features = [F.col(f"c.votes.{n}").alias(f"v_{n}") for n in LABELERS], [F.col(f"c.f.{n}").alias(f"f_{n}") for n in FEATURES]
    seen = each.groupBy("c.kind", *votes, *features).count()
    of_votes = [f"v_{n}" for n in LABELERS]
    total = seen.groupBy("kind", *of_votes).agg(F.sum("count").alias("n")).collect()
    some = seen.orderBy(F.desc("count"), *seen.columns[:-1]).limit(most).collect()
    k = 1 + len(LABELERS)
    return sorted((r[0], tuple(r[1:k]), r[-1]) for r in total), sorted((r[0], tuple(r[1:k]), tuple(r[k:-1]), r[-1]) for r in some)


def fit(counts: list[tuple[str, tuple[int, ...], int]], some: Patterns) -> SpanClassifier:
    """EM over all vote patterns of each kind, then the classifier on its posteriors."""
    model = SpanClassifier({}, {}, {})
    for kind in (k.name for k in KINDS):
        rows = [(votes, n) for k, votes, n in counts if k == kind]
        if not rows:
            continue
        table, post, _ = reliabilities(rows)
        believed = {votes: p for (votes, _), p in zip(rows, post, strict=True)}
        mine = [(f, believed[v], n) for k, v, f, n in some if k == kind]
        model.reliability[kind] = table
        if mine:
            model.bias[kind], model.weights[kind] = trained(np.array([f for f, _, _ in mine]), np.array([p for _, p, _ in mine]), np.array([n for *_, n in mine], float))
    return model


# The spans of ``_taken`` without their probabilities.
_PLAIN = f"cast(transform(_taken, c -> named_struct('start', c.start, 'rank', c.rank, 'kind', c.kind, 'end', c.end)) as array<{SPAN}>)"


def found_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, sorted ``base`` spans, sorted ``candidates`` with votes and features."""
    rows = docs.select("doc_id", docs["text"].alias("_text"))
    return with_matches(rows, "_text", KINDS, CONTEXT).select("doc_id", spans_of(BASE).alias("base"), candidates().alias("candidates"))


def personal_spans(docs: DataFrame, at: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, ``base``, ``spans`` (base ones, and candidates that the classifier takes) and ``sure``, the probability of each.

    Loose candidates that cross a base span are left to it.  Null and empty
    texts have no spans; null and repeated doc_ids are kept, each row with its
    own spans; extra columns are ignored.
    """
    found = written(found_spans(docs), "personal")
    taken = found.select("doc_id", "base", _taken(fit(*patterns(found)), at).alias("_taken"))
    return taken.select("doc_id", "base", F.expr(_PLAIN).alias("spans"), F.expr("transform(_taken, c -> c.sure)").alias("sure"))


def _taken(model: SpanClassifier, at: float) -> Column:
    """The sorted candidates of columns ``base`` and ``candidates`` that are base ones, or that the classifier takes and that cross no base one."""
    weighed = f"transform(candidates, c -> named_struct('start', c.start, 'rank', c.rank, 'kind', c.kind, 'end', c.end, 'base', c.base, 'margin', {model.margin('c.kind', 'c.f')}))"
    kept = f"filter({weighed}, c -> c.base or c.margin >= {math.log(at / (1 - at))!r}D and not exists(base, b -> b.start < c.end and c.start < b.end))"
    return F.expr(f"transform({kept}, c -> named_struct('start', c.start, 'rank', c.rank, 'kind', c.kind, 'end', c.end, 'sure', round(1 / (1 + exp(-c.margin)), 4)))")


# Spans that cross become one, of the kind of the first; texts without any keep theirs.
_UNION = """if(forall(sequence(1, size(spans)), i -> i >= size(spans) or spans[i].start >= spans[i - 1].end), spans,
    aggregate(spans, cast(array() as array<{span}>), (g, s) -> if(size(g) > 0 and s.start < element_at(g, -1).end,
        concat(slice(g, 1, size(g) - 1), array(named_struct('start', element_at(g, -1).start, 'rank', element_at(g, -1).rank, 'kind', element_at(g, -1).kind, 'end', greatest(element_at(g, -1).end, s.end)))),
        concat(g, array(s)))))"""
# A text with the spans ``g`` replaced: cut into sqrt(n) blocks first, for a place in a string is found by counting.
_REPLACED = """if(size(g) > 0, concat(array_join(transform(sequence(0, cast(ceil(size(g) / w) as int) - 1), b -> array_join(transform(
        array(named_struct('o', if(b = 0, 0L, g[b * w - 1].end), 'c', substring({t}, cast(if(b = 0, 0L, g[b * w - 1].end) as int) + 1, cast(g[least((b + 1) * w, size(g)) - 1].end - if(b = 0, 0L, g[b * w - 1].end) as int)))),
        k -> array_join(transform(slice(g, b * w + 1, w), (s, i) -> concat(
            substring(k.c, cast(if(b * w + i = 0, 0L, g[b * w + i - 1].end) - k.o as int) + 1, cast(s.start - if(b * w + i = 0, 0L, g[b * w + i - 1].end) as int)),
            '<', upper(s.kind), '>')), '')), '')), ''), substring({t}, cast(g[size(g) - 1].end as int) + 1)), {t})"""


def mask(docs: DataFrame, at: float = 0.5) -> DataFrame:
    """``docs`` with the spans of ``personal_spans`` in ``text`` replaced by their kind in angle brackets; same columns, a null text stays null.

    Spans that cross are masked as one, under the kind of the first.
    """
    model = fit(*patterns(written(found_spans(docs), "personal")))
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[[c.lower() for c in docs.columns].index("text")]
    found = with_matches(docs.toDF(*names), text, KINDS, CONTEXT).select(*names, spans_of(BASE).alias("base"), candidates().alias("candidates"))
    spans = found.select(*names, _taken(model, at).alias("_taken")).select(*names, F.expr(_PLAIN).alias("spans"))
    grouped = spans.select(*names, F.expr(_UNION.format(span=SPAN)).alias("g")).withColumn("w", F.expr("cast(ceil(sqrt(greatest(size(g), 1))) as int)"))
    return grouped.withColumn(text, F.expr(_REPLACED.format(t=text))).select(*names).toDF(*docs.columns)
