"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a doubly linked list of byte symbols, the last of which
carries the end-of-word mark.  A heap holds the adjacent pairs that have a
merge rule; the pair of the lowest rank (leftmost on ties) is popped, joined in
place, and its two new neighbours are pushed.  A popped entry whose symbols
have changed meanwhile is stale and skipped.  The word's count is its initial
symbols minus its merges; identifiers never leave the function.

Counts of words repeat, so each worker keeps them in a cache of bounded size.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame

from .stable_chars import is_stable

CACHE_WORDS = 1_000_000


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: printable Latin-1 stays, the rest follows from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(keep))
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordMerger:
    """Merge rules of one vocabulary; ``count(word)`` is the number of symbols left."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        letters = byte_alphabet()
        self.inner = [number(letters[b]) for b in range(256)]
        self.last = [number(letters[b] + suffix) for b in range(256)]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.rules.setdefault((number(a), number(b)), (rank, number(a + b)))

    def count(self, word: str) -> int:
        raw = word.encode()
        n = len(raw)
        if n < 2:
            return n
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        rules = self.rules
        heap = [(*rule, i) for i in range(n - 1) if (rule := rules.get((sym[i], sym[i + 1])))]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            rank, joined, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or rules.get((sym[i], sym[j]), (-1,))[0] != rank:
                continue
            sym[i], sym[j] = joined, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if rule := rules.get((joined, sym[k])):
                    heapq.heappush(heap, (*rule, i))
            h = before[i]
            if h >= 0 and (rule := rules.get((sym[h], joined))):
                heapq.heappush(heap, (*rule, h))
        return left


class TokenCounter(dict):
    """word -> count, filled on demand; ``text(t)`` counts a whole text as the library does."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = WordMerger(merges, model["end_of_word_suffix"] or "")
        self.strings = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, self.strings)) or r"(?!)")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.path, self.library = path, None

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self.merger.count(word)
        if len(word) <= 64:
            self[word] = n
        return n

    def words(self, text: str) -> list[str]:
        """The library's pre-tokens of a text without special strings, as plain characters."""
        if is_stable(text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return self.split.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.back = {c: b for b, c in byte_alphabet().items()}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.back.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in pieces]

    def text(self, text: str) -> int:
        if not any(map(text.__contains__, self.strings)):
            return sum(map(self.__getitem__, self.words(text)))
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words(p))) for p in parts if p)


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    One pass without a shuffle.  A null text counts as empty (0 bytes, 0
    tokens); ids may be null or repeat, every row is counted by itself; other
    columns are ignored.
    """
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).text
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
