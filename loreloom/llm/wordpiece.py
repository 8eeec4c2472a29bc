"""Lengths of texts in greedy word pieces, by an automaton that never builds a piece.

The vocabulary is a trie over byte symbols, the last byte of a word being a symbol of its own. Each
node has a failure link to the node that stands for what is left once the pieces certain by then are
taken off, and the number of those pieces. A word is read once, symbol by symbol; where the trie has
no branch, the count of the node is added and its link followed. That gives the number of pieces that
taking the longest match from the left, again and again, would give.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.llm.bpe import byte_letters
from loreloom.llm.common import groups_of_rows

CACHED_WORDS = 400_000
SYMBOLS = 512
FEW = 24
SPLIT = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Automaton:
    """Trie, failure links and counts of a set of pieces (tuples of symbols below SYMBOLS).

    Every single symbol must be a piece, so that each word can be cut.
    """

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        goto: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                if symbol not in goto[node]:
                    goto[node][symbol] = len(goto)
                    goto.append({})
                    whole.append(False)
                node = goto[node][symbol]
            whole[node] = True
        missing = [s for s in range(SYMBOLS) if not whole[goto[0].get(s, 0)]]
        if missing:
            raise ValueError(f"{len(missing)} symbols are no pieces")
        link, popped = [0] * len(goto), [0] * len(goto)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, child in goto[node].items():
                queue.append(child)
                if whole[child]:
                    popped[child] = 1
                    continue
                back, count = link[node], popped[node]
                while symbol not in goto[back]:
                    back, count = link[back], count + popped[back]
                link[child], popped[child] = goto[back][symbol], count
        self.goto = goto
        self.link, self.popped = np.array(link), np.array(popped)
        keys = [(n * SYMBOLS + s, c) for n, edges in enumerate(goto) for s, c in edges.items()]
        keys.sort()
        self.keys = np.array([k for k, _ in keys])
        self.children = np.array([c for _, c in keys])

    def _child(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The branch of each node, or -1."""
        key = node * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)

    def _one(self, symbols: np.ndarray, node: int) -> int:
        count = 0
        for symbol in symbols.tolist():
            while symbol not in self.goto[node]:
                count += int(self.popped[node])
                node = int(self.link[node])
            node = self.goto[node][symbol]
        while node:
            count += int(self.popped[node])
            node = int(self.link[node])
        return count

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each word (none of them empty), all words in step."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        symbols[ends - 1] += 256
        starts = ends - sizes
        counts = np.zeros(len(words), dtype=np.int64)
        node = np.zeros(len(words), dtype=np.int64)
        live = np.arange(len(words))
        step = 0
        while len(live) > FEW:
            symbol = symbols[starts[live] + step]
            left = np.arange(len(live))
            while len(left):
                child = self._child(node[live[left]], symbol[left])
                found = child >= 0
                node[live[left[found]]] = child[found]
                left = left[~found]
                stuck = live[left]
                counts[stuck] += self.popped[node[stuck]]
                node[stuck] = self.link[node[stuck]]
            step += 1
            over = sizes[live] == step
            rest = live[over]
            while len(rest):
                counts[rest] += self.popped[node[rest]]
                node[rest] = self.link[node[rest]]
                rest = rest[node[rest] > 0]
            live = live[~over]
        for i in live.tolist():
            counts[i] += self._one(symbols[starts[i] + step : ends[i]], int(node[i]))
        return counts


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file with word ends."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    end = model["end_of_word_suffix"]
    pieces = []
    for token in model["vocab"]:
        last = token.endswith(end) and token != end
        body = [byte_of[c] for c in (token[: -len(end)] if last else token)]
        if last:
            body[-1] += 256
        pieces.append(tuple(body))
    return Automaton(pieces)


class Counter:
    """Word and piece counts of texts, remembered by stretch of text without white space."""

    def __init__(self, path: str) -> None:
        self.pieces = automaton(path)
        self.slots: dict[str, int] = {}
        self.words = self.lengths = np.zeros(0, dtype=np.int64)

    def _learn(self, chunks: list[str]) -> None:
        found = [SPLIT.findall(c) for c in chunks]
        per_chunk = np.array([len(f) for f in found], dtype=np.int64)
        words = [w.encode("utf-8", "surrogatepass") for f in found for w in f]
        lengths = self.pieces.lengths(words) if words else np.zeros(0, dtype=np.int64)
        sums = np.r_[0, np.cumsum(lengths)]
        edge = np.r_[0, np.cumsum(per_chunk)]
        base = len(self.slots)
        self.slots.update((c, base + i) for i, c in enumerate(chunks))
        self.words = np.r_[self.words, per_chunk]
        self.lengths = np.r_[self.lengths, sums[edge[1:]] - sums[edge[:-1]]]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > CACHED_WORDS:
            self.slots.clear()
            self.words = self.lengths = np.zeros(0, dtype=np.int64)
        chunks = [unicodedata.normalize("NFC", t).lower().split() for t in texts]
        flat = [c for some in chunks for c in some]
        fresh = set(flat) - self.slots.keys()
        if fresh:
            self._learn(list(fresh))
        slot = np.fromiter(map(self.slots.__getitem__, flat), np.int64, len(flat))
        edge = np.r_[0, np.cumsum([len(c) for c in chunks])].astype(np.int64)
        out = []
        for values in (self.words, self.lengths):
            sums = np.r_[0, np.cumsum(values[slot])]
            out.append(sums[edge[1:]] - sums[edge[:-1]])
        return out[0], out[1]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_pieces(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All columns of `docs` but the text, with n_words and n_pieces.

    A word is a run of letters, one digit, or a run of other signs, in lower case. A null or empty
    text, or one of white space alone, has none; every row gives one row; an empty table gives an
    empty table. New columns replace those of the same name.
    """
    added = ["n_words", "n_pieces"]
    names = [c for c in docs.columns if c != text and c not in added]
    schema = T.StructType([docs.schema[c] for c in names])
    for name in added:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(vocabulary)
        for batch, texts in groups_of_rows(batches, "__text"):
            words, pieces = tables.count([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(words), pa.array(pieces)], names=[*names, *added]
            )

    columns = [F.col(f"`{c}`") for c in names]
    return docs.select(*columns, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
