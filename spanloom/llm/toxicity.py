"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences and only its label is known.  Each sentence
has a logistic score of its words and word beginnings; a document is toxic if
any sentence is (noisy-or).  Weights and bias are fitted to the document
labels through the noisy-or; the sentence scores then say where.

Fitting takes a bounded sample: about ``SAMPLE_DOCS`` labelled rows and
``SAMPLE_TEXT`` bytes of text at most, half of each class where there is as
much, no text longer than ``SAMPLE_BYTES``; its weights undo the sampling.
What reaches the driver are numbers of known features in flat arrays.  Scoring
covers every whole text.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import where_text, written

SAMPLE_DOCS = 16_000
SAMPLE_TEXT = 48 << 20
SAMPLE_BYTES = 4 << 20
FEATURES = 800
LEAST_DOCS = 4
#: Lengths of the word beginnings that are features.
PREFIXES = (4, 6)
_TOKENS = re.compile(r"\w+|[.!?\n。！？]+")
_END = frozenset(".!?\n。！？")


def word_features(words) -> set[str]:
    """The words, and their beginnings marked by ``^``."""
    return {*words, *("^" + w[:n] for w in words for n in PREFIXES if len(w) >= n)}


def sentence_features(text: str, known: dict[str, int] | None) -> Iterator[list]:
    """For each sentence of the text with words, its features: words and ``^`` beginnings; only known ones, as numbers, if given."""
    words: list[str] = []
    for t in [*_TOKENS.findall(text.lower()), "."]:
        if t[0] in _END:
            if words:
                each = word_features(words)
                yield [*each] if known is None else sorted(known[f] for f in each if f in known)
                words = []
        else:
            words.append(t)


@dataclass
class Model:
    """Weights by feature, and the bias of every sentence."""

    weights: dict[str, float]
    bias: float

    def sentence(self, words: list[str]) -> float:
        w = self.weights
        each = word_features(words)
        return -math.expm1(-softplus(self.bias + sum(w[f] for f in each if f in w)))

    def document(self, text: str) -> float:
        """Noisy-or of the sentences; a text without words counts as one sentence without evidence."""
        w, starts, bias = self.weights, self.starts, self.bias
        total, quiet, seen, words = 0.0, 0, [], False
        for t in [*_TOKENS.findall(text.lower()), "."]:
            if t[:4] in starts or t in w:
                seen.append(t)
            elif t[0] in _END:
                if seen:
                    total += softplus(bias + sum(w[f] for f in word_features(seen) if f in w))
                    seen = []
                elif words:
                    quiet += 1
                words = False
            else:
                words = True
        if not total:
            quiet = max(quiet, 1)
        return -math.expm1(-total - quiet * softplus(bias))

    def located(self, text: str, least: float) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences that score ``least`` or more, without the blanks around them."""
        out = []
        for m in re.finditer(r"[^.!?\n。！？]+", text):
            words = re.findall(r"\w+", m[0].lower())
            if words and (p := float(self.sentence(words))) >= least:
                out.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), p))
        return out

    @cached_property
    def starts(self) -> set[str]:
        """First four letters of everything that has a weight: most words are passed over by these."""
        return {f.removeprefix("^")[:4] for f in self.weights}


def softplus(z: float) -> float:
    """-log(1 - p) of the logistic p at z."""
    return math.log1p(math.exp(z)) if z < 30 else z


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels that may be learnt from; a repeated doc_id is toxic if any of its rows is."""
    rows = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    return rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))


def _shares(n: dict[int, float], most: float) -> dict[int, float]:
    return {y: min(1.0, most / 2 / n[y]) for y in n if n[y]}


def _thinned(rows: DataFrame, key: Column, share: dict[int, float]) -> DataFrame:
    """``rows`` (y, weight) of which each class keeps its share, by a hash of ``key`` alone."""
    if min(share.values(), default=1.0) >= 1:
        return rows
    rate = F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    return rows.where(F.pmod(key, F.lit(1_000_000)) < rate * 1_000_000).withColumn("weight", F.col("weight") / rate)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_text: int = SAMPLE_TEXT) -> DataFrame:
    """(text, y, weight, u) of the sample; which rows are in it depends on hashes of their doc_id and text only.

    Labels are thinned first, so that those drawn can be broadcast; then the
    rows that have them, for a doc_id may have many rows, and long ones.
    """
    of = learnable(labels)
    n = {r.y: r.n for r in of.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = _thinned(of.withColumn("weight", F.lit(1.0)), F.xxhash64("doc_id", F.lit("sample")), _shares(n, most)).select("doc_id", "y", "weight")
    texts = docs.select("doc_id", F.col("text").alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    rows = written(texts.join(F.broadcast(drawn), "doc_id").select("_text", "y", "weight", F.xxhash64("doc_id", "_text", F.lit("row")).alias("u")), "labelled")
    stats = rows.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("_text")).alias("bytes")).collect()
    by_rows, by_text = _shares({r.y: r.n for r in stats}, 2 * most), _shares({r.y: r.bytes for r in stats}, most_text)
    return _thinned(rows, F.col("u"), {y: min(by_rows[y], by_text.get(y, 1.0)) for y in by_rows})


def _vocabulary(rows: DataFrame, most: int) -> list[str]:
    """The features whose document shares differ most between the classes, for their noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        docs = [0, 0]
        for batch in batches:
            for text, y, *_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[y].update({f for s in sentence_features(text, None) for f in s})
                docs[y] += 1
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(["", *names], pa.string()), *(pa.array([docs[y], *(seen[y][f] for f in names)], pa.int64()) for y in (0, 1))], names=["f", "n0", "n1"])

    counts = rows.mapInArrow(run, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counts.where("f = ''").first()
    if total is None or not total.n0 or not total.n1:
        return []
    p0, p1 = (F.col("n0") + 0.5) / (total.n0 + 1.0), (F.col("n1") + 0.5) / (total.n1 + 1.0)
    gap = F.abs(p1 - p0) / F.sqrt(p0 * (1 - p0) / total.n0 + p1 * (1 - p1) / total.n1)
    return [r.f for r in counts.where(f"f <> '' and n0 + n1 >= {LEAST_DOCS}").orderBy(gap.desc(), "f").limit(most).collect()]


@dataclass
class Bags:
    """Bags of sentences as flat arrays: by document y, weight and quiet (sentences without known features); by other sentence its document, ``of``; by known feature its sentence, ``sent``, and number, ``feat``."""

    y: np.ndarray
    weight: np.ndarray
    quiet: np.ndarray
    of: np.ndarray
    sent: np.ndarray
    feat: np.ndarray


def _bags(rows: DataFrame, vocabulary: list[str]) -> Bags:
    """The sample's bags, in an order that does not depend on how its rows lie."""
    known = {f: k for k, f in enumerate(vocabulary)}
    schema = pa.schema([("u", pa.int64()), ("y", pa.int32()), ("weight", pa.float64()), ("quiet", pa.int64()), ("sizes", pa.binary()), ("feats", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in schema.names}
            for text, y, weight, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bags = [*sentence_features(text, known)]
                quiet = max(sum(not b for b in bags), not bags)
                row = (u, y, weight, quiet, np.array([len(b) for b in bags if b], "<i4").tobytes(), np.array([f for b in bags for f in b], "<i4").tobytes())
                for n, v in zip(out, row, strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    got = rows.mapInArrow(run, "u long, y int, weight double, quiet long, sizes binary, feats binary").toArrow()
    u, y, weight, quiet = (got[n].to_numpy() for n in schema.names[:4])
    order = np.lexsort((quiet, weight, y, u))
    sizes = [np.frombuffer(got["sizes"][int(k)].as_buffer(), "<i4") for k in order]
    feats = [np.frombuffer(got["feats"][int(k)].as_buffer(), "<i4") for k in order]
    flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, "<i4")
    of = np.repeat(np.arange(len(order), dtype="<i4"), [len(x) for x in sizes])
    sent = np.repeat(np.arange(len(of), dtype="<i4"), flat(sizes))
    return Bags(y[order].astype(float), weight[order], quiet[order].astype(float), of, sent, flat(feats))


def noisy_or_loss(b: Bags, w: np.ndarray, bias: float, ridge: float) -> tuple[float, np.ndarray]:
    """(weighted log-loss with the ridge on ``w``, its gradient with the bias last)."""
    z = bias + np.bincount(b.sent, w[b.feat], minlength=len(b.of))
    less = np.bincount(b.of, np.logaddexp(0, z), minlength=len(b.y)) + b.quiet * np.logaddexp(0, bias)  # -log of "no sentence is"
    toxic = b.y == 1
    loss = (b.weight * np.where(toxic, -np.log(np.maximum(-np.expm1(-less), 1e-300)), less)).sum() + ridge / 2 * (w**2).sum()
    pull = b.weight * np.where(toxic, -1 / np.maximum(np.expm1(less), 1e-9), 1)
    at = pull[b.of] / (1 + np.exp(-z))
    of_bias = at.sum() + (pull * b.quiet).sum() / (1 + np.exp(-bias))
    return loss, np.append(np.bincount(b.feat, at[b.sent], minlength=len(w)) + ridge * w, of_bias)


def minimised(b: Bags, features: int, steps: int, ridge: float) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam."""
    x, m, v = np.append(np.zeros(features), -5.0), np.zeros(features + 1), np.zeros(features + 1)
    b.weight *= len(b.weight) / b.weight.sum()
    for step in range(1, steps + 1):
        _, grad = noisy_or_loss(b, x[:-1], x[-1], ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, most: int = SAMPLE_DOCS, steps: int = 400, ridge: float = 0.2) -> Model:
    """Fit by Adam on the noisy-or's log-loss. Without labels of both classes the model has a bias only."""
    rows = sample(docs, labels, most)
    vocabulary = _vocabulary(rows, features)
    if not vocabulary:
        return Model({}, -6.0)
    w, bias = minimised(_bags(rows, vocabulary), len(vocabulary), steps, ridge)
    return Model({f: float(x) for f, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-3}, bias)


_models: dict[str, Model] = {}


def _shared(model: Model, docs: DataFrame):
    """The model once per worker; its size is bounded by the number of features."""
    token, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def get() -> Model:
        if token not in _models:
            _models.clear()
            _models[token] = Model(*sent.value)
        return _models[token]

    return get


def score(docs: DataFrame, model: Model, at: float = 0.7, least: float = 0.5) -> DataFrame:
    """(doc_id, score, located) of every row; null texts score as empty ones, repeated rows stay, extra columns are ignored.

    ``located``: (start, end, score) of the sentences that score ``least`` or
    more, in documents that score ``at`` or more; where it takes several
    sentences together, the one that scores most.
    """
    rows, get = docs.select("doc_id", docs["text"].alias("_text")), _shared(model, docs)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = get()
        for batch in batches:
            scores, found = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                scores.append(p := of.document(text))
                here = [] if p < at else of.located(text, least) or sorted(of.located(text, 0.0), key=lambda s: -s[2])[:1]
                found.append([{"start": s, "end": e, "score": q} for s, e, q in here])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, spans)], names=["doc_id", "score", "located"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, score double, located array<struct<start:long,end:long,score:double>>")


def locate(docs: DataFrame, model: Model, at: float = 0.7, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence, score) of ``score``'s located sentences; offsets in characters."""
    found = score(docs.select("doc_id", F.struct("doc_id", "text").alias("row"), "text").select(F.col("row").alias("doc_id"), "text"), model, at, least)
    each = found.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.text").alias("_text"), F.explode("located").alias("s"))
    return each.select("doc_id", "s.start", "s.end", F.expr("substring(_text, cast(s.start + 1 as int), cast(s.end - s.start as int))").alias("sentence"), "s.score")


def toxicity(docs: DataFrame, labels: DataFrame, at: float = 0.7, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, located) of every row of ``docs``, by a model fitted to the labels that may be learnt from."""
    scored = score(docs, fit(docs, labels, **options), at)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "located")


def drop_toxic(docs: DataFrame, model: Model, at: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``at`` or more; same columns, no shuffle."""
    get = _shared(model, docs)

    def accept():
        of = get().document
        return lambda text: of(text) < at

    return where_text(docs, accept)
