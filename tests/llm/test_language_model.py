"""The backoff automaton against a brute-force walk."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import language_model as lm


def slow(rows, learn, priors):
    """n_tokens, n_known, N, base, score of each row, by following arcs one by one from state to state."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    end = "</s>"
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [end] for _, t in rows]
    c = Counter()  # of token sequences
    for (i, _), w in zip(rows, texts, strict=True):
        if learn(i):
            for k in range(len(w)):
                path = (end, *w)[: k + 2]
                c.update([path[-1:], path[-2:], *([path[-3:]] if k else [])])
    words = [h[0] for h in c if len(h) == 1]
    n, v = sum(c[w,] for w in words), len(words)

    def p(x, h):
        if not h:
            return (c[x,] + 1) / (n + v + 1)
        k = priors[len(h) - 1]
        return (c[*h, x] + k * p(x, h[1:])) / (c[h] + k)

    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        state, total, base = (end,), 0.0, 0.0
        for x in w:
            while state and (*state, x) not in c:
                k = priors[len(state) - 1]
                total += math.log10(k / (c[state] + k))
                state = state[1:]
            total += math.log10(p(x, state))
            base += math.log10(p(x, ()))
            state = (*state, x)[-2:]
            while len(state) > 1 and state not in c:
                state = state[1:]
            state = (end,) if x == end else state
        out.append((i, learn(i), len(w), sum(c[x,] > 0 for x in w), n, round(base, 8), round(total, 8)))
    for h in [(end,), *[h for h in c if len(h) < 3 and (len(h) == 1 or h[-1] != end)][:12]]:  # weights from a state sum to one, unknown words as one
        assert not n or math.isclose(sum(p(x, h) for x in [*words, "never seen"]), 1)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_scores(spark, block_bytes):
    rng = random.Random(block_bytes)
    rows = [(k, " ".join(rng.choices(["a", "B", "é", "d\te", "x1", "Zz"], k=rng.randint(0, 30)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "new words ONLY here"), (203, "hot " * 3000), (204, "hot " * 3000), (3, "a b")]
    rows += [(300 + k, f"only this one sentence comes {k} times") for k in range(8)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, n int")
    got = lm.score(docs, F.col("doc_id") % 3 != 1, priors=(5.0, 2.0), block_bytes=block_bytes).collect()
    want = slow(rows, lambda i: i % 3 != 1, (5.0, 2.0))
    assert sorted((r.doc_id, r.learnt, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in got) == sorted(want)


def test_lanes():
    """Stretches read side by side add what one reading from the first to the last token adds."""
    rng = np.random.default_rng(3)
    ids = np.r_[rng.integers(0, 6, 500), lm.END]
    pairs, pair = np.unique(np.r_[lm.END, ids[:-1]] * 6 + ids, return_inverse=True)
    triples, triple = np.unique(np.r_[0, pair[:-1]] * 6 + ids, return_inverse=True)
    some = lambda n, share: np.where(rng.random(n) < share, -rng.random(n), np.nan)
    a = lm.Automaton(-rng.random(6), -rng.random(6), some(len(pairs), 0.7), -rng.random(len(pairs)), some(len(triples), 0.5))
    path = lm.Path(ids, pair, triple)
    one = a.walk(path, lanes=1)
    for lanes in (2, 7, 100, 4096):
        assert np.allclose(a.walk(path, lanes), one)


def test_odd(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, F.lit(False)).collect()}
    assert got[1].train_tokens == 0 and got[1].score == got[1].base_score == 0.0 and got[None].n_tokens == 3
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_codes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
        counts = rng.integers(0, 2**40, n)
        assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()
