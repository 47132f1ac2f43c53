"""The pipeline against a brute-force version, stage by stage, on a small corpus."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as tok
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import near_copies, toxicity
from spanloom.llm.components import components
from tests.llm.test_pairs import slow_components, slow_fingerprint, slow_hits
from tests.llm.test_spans import PERSONAL


def slow_mask(text):
    if text is None:
        return None
    for name, p, ok in PERSONAL:
        text = p.sub(lambda m, name=name, ok=ok: f"<{name.upper()}>" if ok(m) else m[0], text)
    return text


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, say(15)) for k in range(5)]
    docs = []
    for i in range(500):
        text = ". ".join(say(rng.randint(5, 15)) for _ in range(rng.randint(3, 8)))
        if i % 5 == 0:
            text += ". you vile nasty w1"
        elif i % 7 == 0:
            text += " " + items[i % 5][1][: 60 if i % 2 else 200]
        elif i % 11 == 0:
            text += " mail a.b@c.de or +49 30 1234567 now"
        docs.append((i, text, "en", "s", len(text)))
    docs += [(1000 + k, docs[k][1], "en", "s", docs[k][4]) for k in range(0, 60)]
    docs += [(2000, None, "en", "s", None), (2001, "", "en", "s", 0), (2002, say(6000), "en", "s", 1)]
    labels = [(i, 1, int("vile" in t)) for i, t, *_ in docs[:500]]
    out = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")

    model = toxicity.fit(spark.read.parquet(f"{out}/documents.parquet"), spark.read.parquet(f"{out}/labels.parquet"))
    keep = {i: t for i, t, *_ in docs if model.document(t or "") < 0.7}
    assert not any("vile" in (t or "") for t in keep.values()) and len(keep) > 400
    fp = {i: slow_fingerprint(t) for i, t in keep.items()}
    of = slow_components(fp, lambda x, y: (fp[x] ^ fp[y]).bit_count() <= 3)
    keep = {i: t for i, t in keep.items() if of[i] == i}
    keep = {i: slow_mask(t) for i, t in keep.items() if not slow_hits(t, items)[1]}
    lib = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    want = []
    for i, t in keep.items():
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, s, len(p := ids[s : s + 2048]), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), 2048)]

    got = corpus_pipeline.run(spark, out).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    d = spark.read.parquet(f"{out}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d2 = stage(spark, d, out)
        assert d2.columns == d.columns and d2.dtypes == d.dtypes
    assert re.fullmatch(r"[a-z]+", corpus_pipeline.STAGES[-1][0])


def test_odd_columns(spark, tmp_path):
    """Nulls in every column, repeated rows, no rows, and columns with the names used inside."""
    out = str(tmp_path)
    extra = ["_v", "_p", "_text", "_digest", "_i", "m", "v", "fp", "component_id", "spans", "a.b", "with `tick"]
    rows = [(k, f"mail me{k}@b.cc or" + "".join(f" w{k}x{j}" for j in range(9)), "en", None, 3, *[f"{c}{k}" for c in extra]) for k in range(20)]
    rows += [(*rows[3],), (None, None, None, None, None, *[None] * len(extra)), (None, "mail a@b.cc", None, None, 1, *["z"] * len(extra)), (99, "", None, None, 0, *[None] * len(extra))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in extra)
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, "not in any of them"), (None, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    docs = d = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, out)
        assert d.columns == docs.columns
    kept = {r.doc_id: r for r in d.collect() if r.doc_id is not None}
    assert set(kept) == {*range(20), 99} and d.where("doc_id is null").count() == 1  # the row of nulls is a copy of 99
    assert all(kept[k].text == rows[k][1].replace(f"me{k}@b.cc", "<EMAIL>") and kept[k][5:] == rows[k][5:] for k in range(20))
    packed = corpus_pipeline.STAGES[-1][1](spark, d, out)
    assert packed.count() == 22 and packed.select("sequence_id").distinct().count() == 1
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, out)
        assert none.count() == 0


def test_edited_copies(spark, tmp_path):
    """The near-duplicate stage takes every pair of 5-word Jaccard 0.8 or more, and no other."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    texts = [rng.choices(words, k=rng.choice([4, 5, 12, 40, 100, 400, 1500])) for _ in range(120)]
    for base in texts[:90]:
        edited = list(base)
        for _ in range(max(1, round(len(base) * rng.choice([0.005, 0.015, 0.02, 0.025, 0.03])))):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        texts.append(edited)
    hub = rng.choices(words, k=100)  # a chain: neighbours are similar, far ones are not
    for k in range(40):
        hub = [*hub[:k], f"x{k}", *hub[k + 1 :]]
        texts.append(hub)
    docs = [(k, " ".join(t) if k % 2 else "  ".join(t).upper(), "en", "s", 1) for k, t in enumerate(texts)]
    sets = {k: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for k, t in enumerate(texts)}
    want = slow_components(sets, lambda x, y: 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]))
    assert 150 < len(set(want.values())) < 190
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.STAGES[1][1](spark, d, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_far_from_leader(spark):
    """Pairs that are similar to one another, not to the smallest of their bucket, are found as well."""
    rng = random.Random(13)
    base = [f"b{k}" for k in range(200)]
    docs, k = [], 0
    for _ in range(40):
        far = list(base)
        for at in rng.sample(range(200), 16):
            far[at] = f"y{rng.randrange(10**6)}"
        near = list(far)
        near[rng.randrange(200)] = "z"
        docs += [(k, " ".join(far)), (k + 1, " ".join(near))]
        k += 2
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(196)} for k, t in docs}
    want = slow_components(sets, lambda x, y: 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]))
    got = near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_large_buckets(spark, monkeypatch):
    """Buckets compared in place, whole or cut into chunks, give the components of all pairs."""
    monkeypatch.setattr(near_copies, "_SMALL", 1)
    rng = random.Random(14)
    base = [f"b{k}" for k in range(200)]
    sets = {}
    for k in range(60):
        t = list(base) if k % 2 == 0 else list(t)
        for at in rng.sample(range(200), 16 if k % 2 == 0 else 1):
            t[at] = f"y{rng.randrange(10**6)}"
        h = near_copies.shingle_set(" ".join(t).encode())
        sets[near_copies.node_of(h)] = h
    want = slow_components(sets, lambda x, y: near_copies.similarity(sets[x], sets[y]) >= 0.8)
    assert 10 < len(set(want.values())) < 50
    rows = spark.createDataFrame([(k, h.tobytes()) for k, h in sets.items()], "node long, hashes binary")
    members = spark.createDataFrame([(7, k, k, len(sets), 1) for k in sets], "key long, node long, of long, n long, w long")
    for chunk in (1024, 13):
        root = {r.node: r.root for r in components(near_copies._within(members, rows, 0.8, chunk)).collect()}
        got = {}
        for k in sets:
            got.setdefault(root.get(k, ("alone", k)), []).append(k)
        assert sorted(map(sorted, got.values())) == sorted(sorted(k for k in sets if want[k] == c) for c in set(want.values()))
