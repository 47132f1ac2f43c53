"""Scoring by a weighted backoff automaton of smoothed trigrams.

States are histories: the empty one, every known token, and every pair of
tokens seen side by side.  A state h has an arc for each token w seen after it,
and a failure arc to h', the history without its first token:

    arc      log10((c(h,w) + K p(w|h')) / (c(h) + K))
    failure  log10(K / (c(h) + K)),    p(w) = (c(w) + 1) / (N + V + 1) at last,

with a prior K for each length of history.  These are the weights of a
hierarchical Dirichlet model; they sum to one from every state.  An arc by w
leads to the longest state that ends in w.  A text is read once from left to
right: while the state has no arc for the token the failure arcs are followed,
their weights added, then the arc is taken.  The end of a text leads back to the
state of the end token alone.

The automaton grows with the corpus and no task ever holds it.  Texts are cut
into blocks, files in the shared folder; a block asks only for the arcs that
its own texts can take:

1. blocks of token numbers are written, with the 64-bit hashes of their words;
2. each block sends its distinct words and pairs (sorted hashes, delta coded)
   and its training counts to shards by leading hash bits; a shard adds up the
   counts of equal hashes and answers each block with what others have counted;
3. the same with triples, but a block only asks for a triple if other blocks
   have both of its pairs, for else they cannot have the triple;
4. each block meets its answers, builds its part of the automaton, and walks it.

So every distinct key of a block crosses the network once, whatever its
frequency, and hot words cost no more than rare ones.  Words are met by 64 bits
of their hashes, pairs and triples by so many that a key is mistaken for
another one with a chance of at most 2**-MARGIN.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_dir, open_fs, shuffle_width, written

BLOCK_BYTES = 8 << 20
#: Keys of a shard, about, as all blocks together send them.
SHARD_KEYS = 4_000_000
MARGIN = 20
#: Priors of histories of one and of two tokens.
PRIORS = (1000.0, 4.0)
END = 0
_END_HASH = 0x9E3779B97F4A7C15
_LANES = 4096


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z in lower case; runs without spaces and the characters 9 to 13."""
    return (text or b"").lower().split()


@dataclass
class Path:
    """The tokens of a block's texts, each text ended by END, with the numbers of the arcs that may be taken.

    ``pair`` and ``triple``: numbers of the pair and the triple of tokens that
    end at each place; a first token's pair is that of END and it, and its
    triple means nothing.
    """

    ids: np.ndarray
    pair: np.ndarray
    triple: np.ndarray


@dataclass
class Automaton:
    """The part of the automaton that some texts can reach.

    Arcs by number, nan where there is none: ``root`` from the empty history by
    token, ``second`` from a token by pair, ``third`` from a pair by triple.
    Failure arcs by state: ``fail`` of tokens, ``fail_pair`` of pairs.  A state
    is its token, or ``len(root)`` plus the number of its pair.
    """

    root: np.ndarray
    fail: np.ndarray
    second: np.ndarray
    fail_pair: np.ndarray
    third: np.ndarray

    def entered(self, path: Path, at: np.ndarray) -> np.ndarray:
        """The states before the places ``at``: the longest that what has been read ends in."""
        before = np.where(at > 0, path.ids[at - 1], END)
        pair = path.pair[at - 1]
        return np.where((before == END) | np.isnan(self.second[pair]), before, len(self.root) + pair)

    def step(self, path: Path, at: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, states after) of the tokens at the places ``at``, read in ``state``."""
        size, token, pair = len(self.root), path.ids[at], path.pair[at]
        deep = state >= size
        third = np.where(deep, self.third[path.triple[at]], np.nan)
        weight = np.nan_to_num(third)
        go = np.isnan(third)
        fell = go & deep
        weight[fell] = self.fail_pair[state[fell] - size]
        word = np.where(deep, path.ids[at - 1], state)
        second = self.second[pair]
        seen = ~np.isnan(second)
        weight += np.where(go, np.where(seen, np.nan_to_num(second), self.fail[word] + self.root[token]), 0.0)
        return weight, np.where(token == END, END, np.where(seen, size + pair, token))

    def walk(self, path: Path, lanes: int = _LANES) -> np.ndarray:
        """Weights that the tokens add, read left to right; stretches of the path are read side by side."""
        n = len(path.ids)
        steps = max(1, -(-n // lanes))
        out = np.empty(n)
        at = np.arange(0, n, steps)
        state = self.entered(path, at)
        while len(at):
            out[at], state = self.step(path, at, state)
            at = at + 1
            keep = (at < n) & (at % steps != 0)
            at, state = at[keep], state[keep]
        return out


def tokenized(docs: DataFrame, learn, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write blocks of texts below ``folder``; rows (block, tokens): the file's name and its number of tokens.

    A file is an Arrow stream of one row: doc_id[], learn[], hashes (of its
    words), ids (compressed, an END after each text).  To be evaluated once.
    ``learn``: Column, true for rows to learn from.
    """
    rows = docs.select("doc_id", docs["text"].cast("binary").alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)

        def fresh():
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            assert numbers[b""] == END  # no word is empty
            return numbers, [], [], [], 0

        def block():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            hashes[END] = _END_HASH
            flat, name = np.concatenate(parts), uuid.uuid4().hex
            row = pa.RecordBatch.from_arrays(
                [pa.array([doc_ids], pa.list_(kind)), pa.array([learns], pa.list_(pa.bool_())), pa.array([hashes.tobytes()], pa.binary()), pa.array([zstandard.compress(flat.tobytes(), 3)], pa.binary())],
                names=["doc_id", "learn", "hashes", "ids"],
            )
            with fs.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_stream(out, row.schema) as sink:
                sink.write_batch(row)
            return pa.RecordBatch.from_pydict({"block": [name], "tokens": [len(flat)]})

        numbers, parts, doc_ids, learns, size = fresh()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text, yes in zip(*batch.columns, strict=True):
                raw = text.as_py() or b""
                ids = [*map(numbers.__getitem__, words_of(raw)), END]
                parts.append(np.array(ids, np.uint32))
                doc_ids.append(doc_id.as_py())
                learns.append(yes.as_py())
                size += len(raw) + 64
                if size >= block_bytes:
                    yield block()
                    numbers, parts, doc_ids, learns, size = fresh()
        if doc_ids:
            yield block()

    return rows.mapInArrow(run, "block string, tokens long")


class Block:
    """A block's tokens, its distinct words and pairs in order of their hashes, and its own training counts."""

    def __init__(self, folder: str, name: str):
        fs, base = open_fs(folder)
        with fs.open_input_stream(f"{base}/{name}") as raw:
            row = pa.ipc.open_stream(raw).read_all()
        self.doc_ids, self.learns = row["doc_id"].chunk(0).values, row["learn"][0].as_py()
        self.hashes = np.frombuffer(row["hashes"][0].as_py(), np.uint64)
        self.ids = np.frombuffer(zstandard.decompress(row["ids"][0].as_py()), np.uint32).astype(np.int64)
        ends = np.flatnonzero(self.ids == END)
        self.starts = np.r_[0, ends[:-1] + 1]
        self.learn = np.repeat(np.array(self.learns, bool), np.diff(np.r_[self.starts, len(self.ids)]))
        size = len(self.hashes)
        self.pairs, self.pair = np.unique(np.r_[END, self.ids[:-1]] * size + self.ids, return_inverse=True)
        self.first, self.second = self.pairs // size, self.pairs % size
        self.words, self.own_pairs = np.bincount(self.ids[self.learn], minlength=size), np.bincount(self.pair[self.learn], minlength=len(self.pairs))

    def pair_hashes(self) -> np.ndarray:
        return mixed(self.hashes[self.first], self.hashes[self.second])

    def triples(self) -> None:
        """Number the triples as well: ``before`` and ``pair`` of each, its own count, and a place."""
        deep = np.ones(len(self.ids), bool)
        deep[self.starts] = False
        before = np.r_[0, self.pair[:-1]]
        key = np.where(deep, before * len(self.hashes) + self.ids, -1)
        self.triple_keys, self.some, self.triple = np.unique(key, return_index=True, return_inverse=True)
        self.before, self.after = before[self.some], self.pair[self.some]
        self.own_triples = np.bincount(self.triple[self.learn], minlength=len(self.triple_keys))
        self.real = self.triple_keys >= 0  # all but what first tokens have

    def wanted(self, more_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, hashes) of the triples that other blocks may have, for they have both pairs."""
        which = np.flatnonzero(self.real & (more_pairs[self.before] > 0) & (more_pairs[self.after] > 0))
        p = self.before[which]
        return which, mixed(mixed(self.hashes[self.first[p]], self.hashes[self.second[p]]), self.hashes[self.ids[self.some[which]]])


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes (a multiply-xorshift finisher)."""
    x = a * np.uint64(0xBF58476D1CE4E5B9) + (b ^ (b >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in as many bytes as the largest one takes."""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(step[1:].max()).bit_length() // 8)) if len(step) > 1 else 1
    rest = step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(step[0]).to_bytes(8, "little") + rest.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(rest) + 1, 8), np.uint8)
    step[0] = np.frombuffer(data, np.uint8, 8, offset=1)
    step[1:, :width] = rest
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes; those over 254 follow by place and value."""
    large = np.flatnonzero(counts > 254)
    low = np.minimum(counts, 255).astype(np.uint8)
    return zstandard.compress(low.tobytes(), 1) + large.astype("<u4").tobytes() + counts[large].astype("<u8").tobytes() + len(large).to_bytes(4, "little")


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-4:], "little")
    end = len(data) - 4
    out = np.frombuffer(zstandard.decompress(data[: end - 12 * n]), np.uint8).astype(np.int64)
    out[np.frombuffer(data[end - 12 * n : end - 8 * n], "<u4")] = np.frombuffer(data[end - 8 * n : end], "<u8")
    return out


_ASK = pa.schema([("shard", pa.int64()), ("block", pa.string()), ("kind", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASK_DDL = "shard long, block string, kind string, keys binary, counts binary"
_REPLY = pa.schema([("block", pa.string()), ("kind", pa.string()), ("shard", pa.int64()), ("more", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
_REPLY_DDL = "block string, kind string, shard long, more binary, n long, v long"


def _order(kind: str, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of the hashes of words, or of the leading ``width`` bits of others."""
    keys = hashes if kind == "word" else hashes >> np.uint64(64 - width)
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def _ask(block: str, kind: str, hashes: np.ndarray, counts: np.ndarray, bits: int, width: int) -> pa.Table:
    """A row for each shard that has some of the keys."""
    order, keys = _order(kind, hashes, width)
    counts = counts[order]
    shard = keys >> np.uint64((64 if kind == "word" else width) - bits)
    cuts = [*np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(keys)] if len(keys) else [0]
    rows = [(int(shard[s]), block, kind, pack_keys(keys[s:e]), pack_counts(counts[s:e])) for s, e in zip(cuts, cuts[1:], strict=False)]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ASK.types)], schema=_ASK)


def _added(asked: pa.Table) -> pa.Table:
    """One shard: what the other blocks have counted for each block's keys; a row without block has sums over words."""
    out = []
    for kind in ("word", "pair", "triple"):
        rows = [r for r in asked.to_pylist() if r["kind"] == kind]
        if not rows:
            continue
        keys, counts = [unpack_keys(r["keys"]) for r in rows], [unpack_counts(r["counts"]) for r in rows]
        where = np.unique(np.concatenate(keys), return_inverse=True)[1]
        total = np.bincount(where, np.concatenate(counts)).astype(np.int64)
        at = 0
        for r, c in zip(rows, counts, strict=True):
            out.append({"block": r["block"], "kind": kind, "shard": r["shard"], "more": pack_counts(total[where[at : at + len(c)]] - c)})
            at += len(c)
        if kind == "word":
            out.append({"block": None, "kind": "sum", "shard": rows[0]["shard"], "n": int(total.sum()), "v": int((total > 0).sum())})
    return pa.Table.from_pylist(out, schema=_REPLY)


def _answered(replies: pa.Table, kind: str, hashes: np.ndarray, width: int) -> np.ndarray:
    """What others have counted for the keys of ``hashes``."""
    order, _ = _order(kind, hashes, width)
    parts = sorted((r["shard"], r["more"]) for r in replies.select(["kind", "shard", "more"]).to_pylist() if r["kind"] == kind)
    out = np.zeros(len(hashes), np.int64)
    if parts:
        out[order] = np.concatenate([unpack_counts(m) for _, m in parts])
    return out


def automaton(b: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, v: int, priors: tuple[float, float]) -> Automaton:
    """Smoothed weights from the counts of all training texts; ``n`` tokens, ``v`` distinct ones."""
    k2, k3 = priors
    p = (words + 1.0) / (n + v + 1.0)
    p2 = (pairs + k2 * p[b.second]) / (words[b.first] + k2)
    p3 = (triples + k3 * p2[b.after]) / (pairs[b.before] + k3)
    with np.errstate(divide="ignore"):
        return Automaton(np.log10(p), np.log10(k2 / (words + k2)), np.where(pairs > 0, np.log10(p2), np.nan), np.log10(k3 / (pairs + k3)), np.where(triples > 0, np.log10(p3), np.nan))


def score(docs: DataFrame, learn, priors: tuple[float, float] = PRIORS, block_bytes: int = BLOCK_BYTES, margin: int = MARGIN) -> DataFrame:
    """Per row of ``docs``: doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``learn``: Column, true for rows whose counts make the model.  A null text
    is empty: one end token.  Doc_ids may be null or repeat; extra columns are
    ignored.  With nothing to learn from, N and V are 0.
    """
    spark = docs.sparkSession
    folder = fresh_dir(spark, "lm-blocks")
    blocks = written(tokenized(docs, learn, folder, block_bytes), "lm-block-names")
    n_blocks, tokens = blocks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    # a block has no more distinct pairs, nor triples, than tokens
    bits = max(1, shuffle_width(spark) - 1, tokens // SHARD_KEYS).bit_length()
    width = min(64, max(bits, tokens.bit_length()) + margin)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                b = Block(folder, name)
                for kind, hashes, counts in (("word", b.hashes, b.words), ("pair", b.pair_hashes(), b.own_pairs)):
                    yield from _ask(name, kind, hashes, counts, bits, width).to_batches()

    def second(replies: pa.Table) -> pa.Table:
        name = replies["block"][0].as_py()
        b = Block(folder, name)
        b.triples()
        which, hashes = b.wanted(_answered(replies, "pair", b.pair_hashes(), width))
        return _ask(name, "triple", hashes, b.own_triples[which], bits, width)

    # applyInArrow takes a whole shard; hashes spread keys evenly and a block sends each key once
    spread = blocks.select("block").repartition(max(shuffle_width(spark), min(n_blocks, 4096)), "block")
    replies = written(spread.mapInArrow(first, _ASK_DDL).groupBy("shard").applyInArrow(_added, _REPLY_DDL), "lm-replies")
    sums = replies.where("kind = 'sum'").agg(F.sum("n"), F.sum("v")).first()
    n, v = sums[0] or 0, sums[1] or 0
    of_blocks = replies.where("block is not null")
    deeper = of_blocks.where("kind = 'pair'").groupBy("block").applyInArrow(second, _ASK_DDL).groupBy("shard").applyInArrow(_added, _REPLY_DDL)
    id_type = docs.schema["doc_id"].dataType

    def last(replies: pa.Table) -> pa.Table:
        b = Block(folder, replies["block"][0].as_py())
        b.triples()
        words = b.words + _answered(replies, "word", b.hashes, width)
        more = _answered(replies, "pair", b.pair_hashes(), width)
        which, hashes = b.wanted(more)
        triples = b.own_triples * b.real
        triples[which] += _answered(replies, "triple", hashes, width)
        a = automaton(b, words, b.own_pairs + more, triples, n, v, priors)
        each = (np.ones(len(b.ids), np.int64), (words > 0)[b.ids].astype(np.int64), a.root[b.ids], a.walk(Path(b.ids, b.pair, b.triple)))
        known = [pa.array(np.add.reduceat(x, b.starts)) for x in each]
        return pa.table([b.doc_ids, pa.array(b.learns, pa.bool_()), known[0], known[1], pa.array(np.full(len(b.starts), n, np.int64)), known[2], known[3]], names=names)

    names = ["doc_id", "learnt", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    ddl = f"doc_id {id_type.simpleString()}, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return of_blocks.unionByName(deeper).groupBy("block").applyInArrow(last, ddl)
