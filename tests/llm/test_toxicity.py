"""Multiple-instance toxicity: held-out accuracy, the noisy-or by hand, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from spanloom.llm import toxicity as tox

BAD = ["vile", "nasty", "schlecht"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(1200):
        sentences = [" ".join(rng.choices(words, k=rng.randint(3, 12))) for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.2
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += f" {rng.choice(BAD)}" * rng.randint(1, 2)
        docs.append((i, ". ".join(sentences).capitalize() + ".", "x"))
        if i % 10:
            labels.append((i, 1, int(bad)))
    odd = [(5000, None, "x"), (5001, "", "x"), (5002, "...", "x"), (None, "vile " * 30000, "x"), (7, docs[7][1], "again"), (5003, "plain " * 50000, "x")]
    return spark.createDataFrame(docs + odd, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"), {i: any(b in t for b in BAD) for i, t, _ in docs}


def test_held_out(spark, corpus):
    docs, labels, truth = corpus
    rows = tox.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 1200]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    of = {r.doc_id: r for r in rows}
    assert of[None].predicted == 1 and of[5003].predicted == 0 and of[5000].score == of[5001].score == of[5002].score < 0.2
    texts = {i: t for i, t, _ in docs.where("doc_id < 1200 and score = 'x'").collect()}
    for r in held:  # every located sentence of a document is one that was made toxic
        said = [texts[r.doc_id][s.start : s.end] for s in r.located]
        assert bool(said) == bool(r.predicted) and (not truth[r.doc_id] or all(any(b in x for b in BAD) for x in said))


def test_sentences(spark, corpus):
    docs, labels, _ = corpus
    model = tox.fit(docs, labels)
    text = "W1 w2 w3. w4 vile w5! w6\nNothing nasty here? w7"
    each = [tox.Model.sentence(model, s.lower().split()) for s in ("w1 w2 w3", "w4 vile w5", "w6", "nothing nasty here", "w7")]
    assert math.isclose(model.document(text), 1 - math.prod(1 - p for p in each), rel_tol=1e-9)
    found = tox.locate(spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text), (4, "W1. W2.")], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, text[r.start : r.end], r.sentence) for r in found if r.doc_id] == [(1, s, s) for s in ("w4 vile w5", "Nothing nasty here")] and len(found) == 4
    kept = tox.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0.6 < kept.count() / docs.count() < 0.9


def test_no_labels(spark, corpus):
    docs, labels, _ = corpus
    assert tox.toxicity(docs, labels.where("toxic = 1")).where("predicted = 1").count() == 0
    assert tox.toxicity(docs.limit(0), labels).count() == 0


def slow_loss(rows, w, bias, ridge):
    """The weighted log-loss by loops over documents, sentences and features."""
    total = 0.0
    for y, weight, sentences in rows:
        silent = 1.0
        for fs in sentences or [[]]:
            silent *= 1 - 1 / (1 + math.exp(-(bias + sum(w[f] for f in fs))))
        total -= weight * math.log(1 - silent if y else silent)
    return total + ridge / 2 * sum(x * x for x in w)


def test_fit_by_hand():
    """Loss, gradient and the descent against loops and differences."""
    rng = random.Random(4)
    rows = [(k % 2, 1.0 + k % 3, [sorted(rng.sample(range(5), rng.randint(0, 3)) + [5] * (k % 2 and s == 0)) for s in range(rng.randint(0, 4))]) for k in range(40)]
    heard = [[s for s in ss if s] for *_, ss in rows]
    arrays = lambda: tox.Bags(
        np.array([y for y, *_ in rows], float), np.array([w for _, w, _ in rows]), np.array([max(sum(not s for s in ss), not ss) for *_, ss in rows], float),
        np.array([d for d, ss in enumerate(heard) for _ in ss]), np.array([k for k, s in enumerate(s for ss in heard for s in ss) for _ in s]), np.array([f for ss in heard for s in ss for f in s]),
    )
    w, bias = np.array([rng.uniform(-1, 1) for _ in range(6)]), -0.7
    loss, grad = tox.noisy_or_loss(arrays(), w, bias, 0.2)
    assert math.isclose(loss, slow_loss(rows, w, bias, 0.2), rel_tol=1e-9)
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        up, down = (slow_loss(rows, w + s * step[:6], bias + s * step[6], 0.2) for s in (1, -1))
        assert math.isclose(grad[k], (up - down) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)
    b = arrays()
    w, bias = tox.minimised(b, 6, 400, 0.2)
    scaled = [(y, weight, ss) for (y, _, ss), weight in zip(rows, b.weight, strict=True)]
    best = slow_loss(scaled, w, bias, 0.2)
    assert all(slow_loss(scaled, w + [rng.gauss(0, 0.1) for _ in w], bias + rng.gauss(0, 0.1), 0.2) > best for _ in range(200))


def test_vocabulary(spark):
    """The features by brute force, and bags that do not depend on how rows lie."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choices(["aaaaaa", "bb", "cccc", "dd", "eeeeeeee"], k=6)) + (" zz." if k % 2 else "."), k % 2, 1.0, k * 7919 % 1009) for k in range(60)]
    df = spark.createDataFrame(rows, "_text string, y int, weight double, u long")
    seen = {}
    for t, y, *_ in rows:
        for f in {f for s in tox.sentence_features(t, None) for f in s}:
            seen.setdefault(f, [0, 0])[y] += 1

    def gap(f):
        p = [(seen[f][y] + 0.5) / 31 for y in (0, 1)]
        return -round(abs(p[1] - p[0]) / math.sqrt(sum(x * (1 - x) / 30 for x in p)), 9), f

    want = sorted((f for f in seen if sum(seen[f]) >= tox.LEAST_DOCS), key=gap)[:4]
    got = tox._vocabulary(df, 4)
    assert got[0] == "zz" and {gap(f)[0] for f in got} == {gap(f)[0] for f in want}
    a, b = tox._bags(df.repartition(5), got), tox._bags(df.coalesce(1), got)
    assert all((x == y).all() for x, y in zip(vars(a).values(), vars(b).values(), strict=True))


def test_sample_bounds(spark):
    """A doc_id with many rows does not make the sample larger, nor do long texts."""
    docs = spark.createDataFrame([(1, f"clean {k}") for k in range(400)] + [(2, f"toxic {k}") for k in range(400)] + [(3, "x" * 100_000), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    labels = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    whole = tox.sample(docs, labels)
    few = tox.sample(docs, labels, most_text=2000)
    assert few.agg({"_text": "count"}).first()[0] < whole.count() and sum(len(r[0]) for r in few.collect()) < 102_500
    assert math.isclose(few.agg({"weight": "sum"}).first()[0], whole.count(), rel_tol=0.5)
