"""Decontamination and near-duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from spanloom.llm import storage
from spanloom.llm.components import components
from spanloom.llm.decontamination import benchmark_hits, cut_item, drop_contaminated, windows_of
from spanloom.llm.near_copies import near_copies
from spanloom.llm.simhash import fingerprint, keep_one_of_each, links, near_duplicates

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def slow_hits(text, items):
    w, marked, found = slow_words(text), set(), set()
    for item, t in items:
        iw = slow_words(t)
        if item is None or not iw:
            continue
        n = min(10, len(iw))
        wins = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)}
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in wins:
                marked |= set(range(s, s + n))
                found.add(str(item))
    return len(w), len(marked), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_hits(spark, block_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Ça", "d1", "é", "f"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 2, 9, 10, 11, 25])))) for k in range(12)] + [(None, "zz"), (5, None), (7, "UNIQUE passage, of; seven words right here")]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(40)]
    docs += [(90 + k, f"x{k}. {items[k][1].upper()} y") for k in range(12)] + [(None, None), (1, ""), (1, ""), (None, "unique PASSAGE of seven words right-here")]
    d, b = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r.item_ids)) for r in benchmark_hits(d, b, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == sorted(((i, *slow_hits(t, items)) for i, t in docs), key=str)
    left = drop_contaminated(d, b, block_bytes=block_bytes)
    assert left.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((i, t) for i, t in docs if not slow_hits(t, items)[1]), key=str)
    assert benchmark_hits(d, b.limit(0)).where("size(spans) > 0").count() == 0
    assert benchmark_hits(d.limit(0), b).count() == 0


def test_cut_item():
    """Every window is in exactly one part; only items shorter than a window give shorter parts."""
    rng = random.Random(4)
    for _ in range(300):
        n, window, most = rng.randint(0, 60), rng.randint(1, 12), rng.randint(1, 80)
        words = [b"%d" % k * rng.randint(1, 4) for k in range(n)]
        parts = [*cut_item(words, window, most)]
        assert [w for p in parts for w in windows_of(p, window)] == [*windows_of(words, window)]
        assert all(len(p) == min(window, n) or len(p) > window and sum(map(len, p)) + len(p) <= most for p in parts)


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    g = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def slow_components(nodes, close):
    left, out = set(nodes), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            group.append(x := todo.pop())
            near = {y for y in left if close(x, y)}
            left -= near
            todo += near
        out |= dict.fromkeys(group, min(group))
    return out


def test_fingerprint(spark):
    for t in [None, "", " \t\n", "One", "One TWO", "a b c", "a b c a b c d É é x", "w " * 70000]:
        assert fingerprint((t or "").encode()) == slow_fingerprint(t)
    assert spark.sql("select xxhash64('a b c')").first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).view(np.int64)


@pytest.mark.parametrize("chunk", [8192, 30])
def test_links(spark, chunk):
    rng = random.Random(chunk)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for centre in list(fps)[:4] + [0]:
        for n in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 4 if n < 30 else 12)):
                f ^= 1 << b
            fps.add(f)
    far = 0
    for b in range(0, 60, 3):  # a long chain
        far |= 7 << b
        fps.add(far)
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = links(frame, chunk=chunk).collect()
    u = lambda x: int(np.int64(x).view(np.uint64))
    assert all((u(r.a) ^ u(r.b)).bit_count() <= 3 for r in found)
    roots = {u(r.node): r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    want = slow_components(fps, lambda x, y: (x ^ y).bit_count() <= 3)
    groups = {}
    for f, c in want.items():
        groups.setdefault(c, set()).add(roots.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set().union(*groups.values()))


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(80)] for _ in range(6)]
    docs = [(k, " ".join(base[k % 6])) for k in range(20, 38)] + [(50, None), (7, ""), (60, "one"), (61, "one")]
    for k in range(100, 130):
        w = list(base[k % 6])
        w[rng.randrange(80)] = "changed"
        docs.append((k, " ".join(w)))
    rows = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, fp int")
    got = {r.doc_id: (int(np.int64(r.fp).view(np.uint64)), r.component_id) for r in near_duplicates(rows).collect()}
    fp = {i: slow_fingerprint(t) for i, t in docs}
    want = slow_components(fp, lambda x, y: (fp[x] ^ fp[y]).bit_count() <= 3)
    assert got == {i: (fp[i], want[i]) for i in fp}
    kept = keep_one_of_each(rows.unionByName(rows.where("doc_id = 20")).unionByName(spark.createDataFrame([(None, "q", 0)], rows.schema)))
    assert kept.columns == rows.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(want.values()), None], key=str)
    assert near_duplicates(rows.limit(0)).count() == 0


@pytest.mark.parametrize("groups", [near_duplicates, near_copies])
def test_keep_without_id(spark, groups):
    """Rows without a doc_id are copies like others: none stays beside one with an id, one of them alone."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (None, a), (None, a), (4, a), (None, b), (None, b), (None, b.upper()), (9, c), (None, None), (None, " "), (8, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _digest int")
    kept = keep_one_of_each(docs, groups)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "").strip().lower()) for r in kept.collect())
    assert got == sorted([("4", a), ("None", b), ("9", c), ("8", "")])


@pytest.mark.parametrize("groups", [near_duplicates, near_copies])
def test_keep_repeated_id(spark, groups, monkeypatch):
    """A doc_id that stands for several texts loses none of them; equal rows are one; nothing depends on broadcasts."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (1, b), (2, c), (3, b), (2, c), (2, c.upper()), (None, d), (None, d), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (storage.BROADCAST_ROWS, 0):
        monkeypatch.setattr(storage, "BROADCAST_ROWS", most)
        kept = sorted((str(r.doc_id), (r.text or "").lower()) for r in keep_one_of_each(docs, groups).collect())
        assert kept == sorted([("1", a), ("1", b), ("2", c), ("None", d), ("None", "")])


@pytest.mark.parametrize("join", [storage.spread_join, storage.salted_join])
def test_hot_joins(spark, join):
    """A key with a third of all rows, null keys and keys without a partner."""
    rows = [(k % 50 if k % 3 else 7, k) for k in range(6000)] + [(None, -1), (999, -2)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(60)], "k long, name string")
    got = join(left, right, "k", left)
    assert sorted((r.k, r.v, r.name) for r in got.collect()) == sorted((k, v, f"n{k}") for k, v in rows if k is not None and k < 60)


def test_hot_fingerprint(spark):
    """One fingerprint and one star of links with most of the rows."""
    docs = spark.createDataFrame([(k, "same text here again" if k % 2 else f"text {k} of its own and no other {k * 7}") for k in range(3000)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert len(got) == 3000 and {got[k] for k in range(1, 3000, 2)} == {1}
    star = spark.createDataFrame([(0, k) for k in range(1, 3000)] + [(5000, 5001)], "a long, b long")
    roots = {r.node: r.root for r in components(star).collect()}
    assert len(roots) == 3002 and len({roots[k] for k in range(3000)}) == 1 and roots[5000] == roots[5001] != roots[0]


def test_empty_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
