"""Token counts and packing against the library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers as tok
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from spanloom.llm.packing import _encoder, best_fit_decreasing, pack_documents
from spanloom.llm.token_counts import counter, token_counts

SCHEMA = "doc_id long, text string, n_tokens int"
ODD = [None, "", " ", "a", "I'LL don't <|endoftext|>x<|startoftext|>", "\x1c\x85 a​b", "ΑΣ ς Σ", "İstanbul é ﬁ ½ ²", "日本語 🙂🙂", "aaaa" * 3000, "word " * 5000, "\U0001e4d0 Ᲊ", "٠० x1y2"]
texts = st.lists(st.one_of(st.text(), st.sampled_from(["<|endoftext|>", "<|", "'s", " ", "\n", "the", "Straße"]))).map("".join)


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(tok.path("word_bpe_49k.json"))


@given(texts)
@settings(max_examples=300, deadline=None)
def test_counts_as_library(text):
    lib = Tokenizer.from_file(tok.path("word_bpe_49k.json")) if not hasattr(test_counts_as_library, "lib") else test_counts_as_library.lib
    test_counts_as_library.lib = lib
    assert counter(tok.path("word_bpe_49k.json")).text(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_count_rows(spark, words):
    rows = [(k, t, -1) for k, t in enumerate(ODD)] + [(None, "x", 0), (3, "a", 1)]
    got = token_counts(spark.createDataFrame(rows, SCHEMA), tok.path("word_bpe_49k.json"), limit=3).collect()
    want = [(i, len((t or "").encode()), n := len(words.encode(t or "", add_special_tokens=False).ids), n > 3) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], SCHEMA), tok.path("word_bpe_49k.json")).count() == 0


def encoder():
    return _encoder(tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN, (("<|endoftext|>", 50256),))


@given(texts)
@settings(max_examples=300, deadline=None)
def test_ids_as_library(text):
    if not hasattr(test_ids_as_library, "lib"):
        test_ids_as_library.lib = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    assert encoder()(text).tolist() == test_ids_as_library.lib.encode(text, add_special_tokens=False).ids


def slow_best_fit(lengths, window):
    rooms, out = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits)[1]
        else:
            k = len(rooms)
            rooms.append(window)
        out.append((rooms[k], n))
        rooms[k] -= n
    return out, len(rooms)


@pytest.mark.parametrize("window", [1, 7, 64, 2048])
def test_best_fit(window):
    rng = random.Random(window)
    lengths = sorted((rng.randint(1, window) for _ in range(400)), reverse=True)
    placed = best_fit_decreasing(lengths, window)
    want, n = slow_best_fit(lengths, window)
    assert len({s for s, _ in placed}) == n
    assert [window - o for _, o in placed] == [r for r, _ in want]


def test_pack(spark):
    lib = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    rows = [(k, t, 5) for k, t in enumerate(ODD)] + [(None, "x y z", 0), (3, "a", 1)]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN, {"<|endoftext|>": 50256}, block_pieces=5).toPandas()
    want = []
    for i, t, _ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    have = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    # one row that repeats fills many blocks evenly
    from spanloom.llm.packing import pack, padding
    from spanloom.llm.storage import written

    piece = spark.createDataFrame([(1, 0, 1000, 7, 1000)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    same = pack(written(piece.crossJoin(spark.range(1000)).drop("id"), "same"), block_pieces=100).selectExpr("sequence_id >> 32 as block", "*").toPandas()
    assert same.block.nunique() == 10 and same.block.value_counts().max() < 150 and same.groupby("sequence_id").length.sum().max() <= 2048
    assert (p := padding(spark.createDataFrame(same)).first()).ids == 1_000_000 and 0.02 < p.padding < 0.05
    assert pack_documents(spark.createDataFrame([], SCHEMA), tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN, {}).count() == 0
