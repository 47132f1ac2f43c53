"""Filter audit, ranked search and exact top k against brute force."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from spanloom.llm import exact_topk, filter_audit, ranked_search


def slow_fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {k for k, f in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))), strict=True) if f}


def slow_audit(docs, labels):
    rows = []
    for i, t, part in docs:
        t, of = t or "", {q for j, *q in labels if i is not None and j == i for q in [tuple(q)]}
        again = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((part or "", slow_fails(t) | ({"E"} if again else set()), any(q == 1 for q, _ in of), any(x == 1 for _, x in of)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                redundant = sum(f in r[1] and bool(r[1] & set(order[:k])) for r in own)
                out[part, order, k + 1] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audit_rows(found):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found.collect()}


def test_audit(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "Be", "cé", "x#y", "W　q", "n1"]) + (str(rng.randint(0, 999)) if rng.random() < 0.9 else "")
    docs = [(rng.choice([k, k, 3]), rng.choice(["\t", " ", "\x0b"]).join(word() for _ in range(rng.choice([0, 3, 99, 100, 130]))), rng.choice(["en", "de", "", None])) for k in range(60)]
    docs += [(rng.choice([None, 200 + k]), docs[k % 4][1], rng.choice(["en", "xx"])) for k in range(40)] + [(None, None, None), (7, "", "en"), (7, "", "en"), (400, "b " * 200000, "de"), (401, "b " * 200000, "de")]
    docs += [(1000 + k, f"w{k} " + " ".join(f"u{j}" for j in range(120)), "fr") for k in range(5)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in [*range(0, 60, 2), 7, 7, 205, 400]] + [(None, 1, 1)]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, lang string, digest string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(d, lab)
    assert audit_rows(found) == slow_audit(docs, labels) and found.count() == 600 * 5
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert {tuple(v[4:6]) for v in audit_rows(filter_audit.audit(d, lab.limit(0))).values()} == {(0, 0)}


def test_audit_of_many_copies(spark):
    """Keys that hold most rows are joined apart; the histograms stay the same."""
    docs = [(k % 2500, "same" if k % 3 else f"t{k}", "en") for k in range(6000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(0, 2500, 5)], "doc_id long, quality int, toxic int")
    first = min(i for i, t, _ in docs if t == "same")
    want = Counter()
    for i, t, _ in docs:
        want[16 * (t == "same" and i > first)] += 1
    cells = {r.mask & 16: (r.n, r.good, r.toxic) for r in filter_audit.histograms(d, labels).groupBy("mask").sum("n", "good", "toxic").toDF("mask", "n", "good", "toxic").collect()}
    assert {k: v[0] for k, v in cells.items()} == want
    assert sum(v[1] for v in cells.values()) == sum(i % 5 == 0 for i, _, _ in docs) and sum(v[2] for v in cells.values()) == sum(i % 10 == 5 for i, _, _ in docs)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def slow_ranked(docs, items, top=10):
    words = [(i, slow_terms(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, []).extend(slow_terms(t))
    out = []
    for i, terms in wanted.items():
        found = []
        for doc, w in words:
            tf, m = Counter(w), 100 - 75 + 75 * len(w) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            found.append((-score, doc is None, doc or 0, doc))
        out += [(i, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(f for f in found if f[0] < 0)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes, run", [(1 << 22, 1 << 21), (400, 50)])
def test_ranked(spark, monkeypatch, block_bytes, run):
    monkeypatch.setattr(ranked_search, "RUN", run)
    rng = random.Random(6)
    word = lambda: rng.choice(["A", "b", "Été", "été", "d1", "e_e", "f", "g", "rare", "x　y"] + ["the"] * 8)
    text = lambda n: rng.choice([" ", "-", "\n"]).join(word() for _ in range(n))
    docs = [(rng.choice([k, 3, None]), text(rng.choice([0, 1, 5, 40, 300]))) for k in range(120)] + [(5, None), (None, None), (900, "..."), (901, "only " * 30000)]
    docs += [(1000 + k, "the same words again") for k in range(40)]
    items = [(k, text(rng.randint(0, 12))) for k in range(15)] + [(3, "rare b b"), (None, "same THE"), (77, None), (78, "nowhere-to-be-found"), (79, "!")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score long").repartition(5)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank long")
    got = sorted((tuple(r) for r in ranked_search.ranked(d, i, block_bytes=block_bytes).collect()), key=str)
    assert got == slow_ranked(docs, items)
    assert ranked_search.ranked(d.limit(0), i).count() == 0 and ranked_search.ranked(d, i.limit(0)).count() == 0
    assert ranked_search.ranked(d.where("doc_id = 900"), i).count() == 0


def test_accumulate():
    rng = np.random.default_rng(1)
    for most in (1, 100, 1 << 17, 1 << 40):
        keys, values = rng.integers(0, most, 5000), rng.integers(0, 1000, 5000)
        order = ranked_search.radix_order(keys)
        assert (order == np.argsort(keys, kind="stable")).all()
        want = Counter()
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            want[k] += v
        assert dict(zip(*(x.tolist() for x in ranked_search.accumulate(keys, values)), strict=True)) == want


def slow_topk(rows, every, top, scale=64):
    def floored(v):
        if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * scale) for x in v):
            return None
        return [math.floor(x * scale) for x in v]

    known = [(i, f) for i, v in rows if (f := floored(v)) is not None]
    out = []
    for a, (i, q) in enumerate(known):
        if i is None or i % every:
            continue
        scores = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, c, strict=False)))), j is None, j or 0) for b, (j, c) in enumerate(known) if a != b]
        out += [(i, k, None if null else j, -s) for k, (s, null, j) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["plain", "copies", "odd", "huge", "one length", "tiny"])
def test_topk(spark, monkeypatch, kind):
    monkeypatch.setattr(exact_topk, "CHUNK", 37)
    monkeypatch.setattr(exact_topk, "QUERIES", 16)
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(400, 16)) * rng.gamma(1, 1, (400, 1)) * np.linspace(2, 0.05, 16)
    if kind == "copies":
        x[100:300] = x[7]
        x[300:] = np.round(x[300:], 1)
    if kind == "one length":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "huge":
        x[::3] *= 1e12
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    if kind == "odd":
        rows = [(k if rng.random() < 0.8 else int(rng.integers(0, 12)) * 5, v[: int(rng.integers(0, 17))]) for k, v in rows[:200]]
        rows += [(None, x[3].tolist()), (None, x[3].tolist()), (400, None), (405, [1.0, None]), (410, [float("nan")]), (415, [float("inf"), 1.0]), (420, []), (-5, [0.0, -0.0]), (425, [1e308])]
        rows += rows[:9]
    if kind == "tiny":
        rows = rows[:3]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score long").repartition(4)
    got = sorted((tuple(r) for r in exact_topk.exact_topk(d, every=5, top=7).collect()), key=str)
    assert got == slow_topk(rows, 5, 7)
    assert exact_topk.exact_topk(d.limit(0)).count() == 0


def test_walk_prunes():
    """Where lengths differ, most pairs are never scored."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(4000, 16)) * rng.gamma(0.5, 40, (4000, 1)))
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    walk = exact_topk.Walk(np.arange(100) + 10**6, x[::40], exact_topk.rotation_of(x.T @ x), 10, True)
    for k in range(0, 4000, 250):
        if not walk.meet(x[k : k + 250], np.linalg.norm(x[k : k + 250], axis=1), pa.array([[j] for j in range(k, k + 250)], pa.list_(pa.int64()))):
            break
    want = np.sort(x[::40] @ x.T, axis=1)[:, -10:]
    assert (np.sort(np.array(walk.rows().column(3)).reshape(100, 10), axis=1) == want).all() and walk.scored < 100 * 4000 / 4
