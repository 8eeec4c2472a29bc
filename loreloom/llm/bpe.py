"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of all words of a batch lie in one flat array. Each round looks up every adjacent pair by
binary search in the sorted keys of the merge table, takes the pair of lowest rank in each word, and
merges it everywhere at once; words without a pair in the table leave the rounds.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.llm.common import groups_of_rows

CACHED_WORDS = 200_000
NO_RANK = np.iinfo(np.int64).max

# Python's split() parts at these, the vocabulary's pattern does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")

# Letters and digits that are newer than the tables of the tokenizer library, which takes them for other
# signs: ranges of code points. Fixed values.
NEWER_LETTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686
16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD
323B0-33479 3D000-3FC3F
"""
# Capitals that the library knows and Python does not yet: first, last, first small letter. Fixed values.
NEWER_CAPITALS = """
1C89-1C89-1C8A A7CB-A7CB-264 A7CC-A7CC-A7CD A7CE-A7CE-A7CF A7D2-A7D2-A7D3 A7D4-A7D4-A7D5
A7DA-A7DA-A7DB A7DC-A7DC-19B 10D50-10D65-10D70 16EA0-16EB8-16EBB
"""
OTHER_SIGN = "\u2e2e"  # neither letter nor digit


def code_class(ranges: str) -> str:
    """A class of characters from ranges of code points in hexadecimal."""
    ends = [(r.split("-")[0], r.split("-")[-1]) for r in ranges.split()]
    return "[" + "".join(f"\\U{int(a, 16):08X}-\\U{int(b, 16):08X}" for a, b in ends) + "]"


def small_letters() -> dict[int, int]:
    """Code points of the newer capitals and of their small letters."""
    rows = [[int(x, 16) for x in r.split("-")] for r in NEWER_CAPITALS.split()]
    return {c: small + c - first for first, last, small in rows for c in range(first, last + 1)}


NEWER = regex.compile(code_class(NEWER_LETTERS))
SMALL = small_letters()
CAPITAL = regex.compile("[" + "".join(map(chr, SMALL)) + "]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """The tables of one vocabulary file and the merge rounds over them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, self.special)))
        self.pieces = regex.compile(
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        )
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.results = keys[order], rank[order], merged
        first_use = np.full(self.size, NO_RANK)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        # A merge may be done everywhere at once if its result takes part in later merges only.
        self.at_once = first_use[merged] > rank
        tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = token
        shown = [(t + " ").encode() for t in tokens]
        self.token_lengths = np.array([len(t) for t in shown], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.slots: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.slots.clear()
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each word has."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(symbols), NO_RANK)
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[heads, len(word)])
            lowest = np.minimum.reduceat(rank, heads)
            ended = np.repeat(lowest == NO_RANK, counts)
            if ended.any():
                done_ids.append(symbols[ended])
                done_words.append(word[ended])
            lowest_here = np.repeat(lowest, counts)
            take = (rank == lowest_here) & ~ended
            take = self._apart(take, word, rank)
            at = np.flatnonzero(take)
            symbols[at] = self.results[rank[at]]
            keep = ~ended
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _apart(self, take: np.ndarray, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of the wanted merges, those that do not overlap, from the left of each word."""
        at = np.flatnonzero(take)
        if not len(at):
            return take
        follows = np.r_[False, np.diff(at) == 1]
        run_head = np.maximum.accumulate(np.where(~follows, np.arange(len(at)), 0))
        good = (np.arange(len(at)) - run_head) % 2 == 0
        first_of_word = np.r_[True, word[at][1:] != word[at][:-1]]
        good &= self.at_once[rank[at]] | first_of_word
        out = np.zeros_like(take)
        out[at[good]] = True
        return out

    def _cut(self, chunk: str) -> list[str]:
        """The words of a chunk, by the letters that the library knows."""
        if NEWER.search(chunk):
            masked = NEWER.sub(OTHER_SIGN, chunk)
            return [chunk[m.start() : m.end()] for m in self.pieces.finditer(masked)]
        return self.pieces.findall(chunk)

    def _learn(self, chunks: set[str]) -> None:
        """Encode chunks of text without white space and remember them."""
        chunks = list(chunks)
        words: list[bytes] = []
        counts = np.zeros(len(chunks), dtype=np.int64)
        for i, chunk in enumerate(chunks):
            found = self._cut(chunk)
            counts[i] = len(found)
            words.extend(w.encode() for w in found)
        ids, per_word = self.merge_words(words) if words else (np.zeros(0, np.int32), counts[:0])
        bounds = np.r_[0, np.cumsum(per_word)]
        edge = np.r_[0, np.cumsum(counts)]
        lengths = bounds[edge[1:]] - bounds[edge[:-1]]
        base = len(self.slots)
        for i, chunk in enumerate(chunks):
            self.slots[chunk] = base + i
        offset = len(self.ids)
        self.ids = np.r_[self.ids, ids]
        self.starts = np.r_[self.starts, offset + bounds[edge[:-1]]]
        self.lengths = np.r_[self.lengths, lengths]

    def _chunks(self, text: str) -> list[str]:
        norm = unicodedata.normalize("NFC", text)
        # Letter by letter, as the vocabulary's normaliser does: a final sigma stays a plain one.
        norm = norm.replace("Σ", "σ").lower()
        if CAPITAL.search(norm):
            norm = norm.translate(SMALL)
        if SEPARATORS.search(norm):
            return regex.findall(r"\S+", norm)
        return norm.split()

    def _parts(self, text: str) -> Iterator[tuple[str | None, int]]:
        """Plain stretches of text and the special tokens between them."""
        start = 0
        for found in self.special_at.finditer(text):
            yield text[start : found.start()], -1
            yield None, self.special[found.group()]
            start = found.end()
        yield text[start:], -1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if len(self.slots) > CACHED_WORDS:
            self._clear()
        pieces: list[str] = []
        owners: list[int] = []
        for text in texts:
            before = len(pieces)
            for part, special in self._parts(text):
                if part is None:
                    # A key that no chunk of text can have, as it holds white space.
                    pieces.append(f" {special}")
                else:
                    pieces.extend(self._chunks(part))
            owners.append(len(pieces) - before)
        fresh = set(pieces) - self.slots.keys()
        for key in [k for k in fresh if k[0] == " "]:
            fresh.discard(key)
            self.slots[key] = len(self.slots)
            self.starts = np.r_[self.starts, len(self.ids)]
            self.lengths = np.r_[self.lengths, 1]
            self.ids = np.r_[self.ids, np.int32(int(key))].astype(np.int32)
        if fresh:
            self._learn(fresh)
        slot = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.lengths[slot]
        ids = self.ids[spans(self.starts[slot], lengths)]
        bounds = np.r_[0, np.cumsum(lengths)]
        edge = np.r_[0, np.cumsum(np.array(owners, dtype=np.int64))]
        return ids, bounds[edge[1:]] - bounds[edge[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of each text's tokens joined by a space, and each text's length."""
        lengths = self.token_lengths[ids]
        flat = self.token_bytes[spans(self.token_starts[ids], lengths)]
        bounds = np.r_[0, np.cumsum(lengths)]
        edge = np.r_[0, np.cumsum(counts)]
        sizes = bounds[edge[1:]] - bounds[edge[:-1]]
        keep = np.ones(len(flat), dtype=bool)
        ends = bounds[edge[1:]][sizes > 0] - 1
        keep[ends] = False
        return flat[keep], np.maximum(sizes - 1, 0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _arrow_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))


def _arrow_strings(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.StringArray.from_buffers(
        len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())
    )


def encode_texts(
    docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = True
) -> DataFrame:
    """All columns of `docs` with `ids` (array of int) and `decoded` (string, on request).

    A null or empty text, or one of white space alone, has no ids and decodes to the empty string;
    every row gives one row, repeated ids and rows included; an empty table gives an empty table. New
    columns replace those of the same name. Special tokens written in a text are single ids.
    """
    added = ["ids", "decoded"] if decoded else ["ids"]
    names = [c for c in docs.columns if c not in added or c == text]
    if text in added:
        raise ValueError(f"the text column cannot be called {text}")
    schema = T.StructType([docs.schema[c] for c in names])
    schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))
    schema = schema.add("decoded", T.StringType()) if decoded else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = encoder(vocabulary)
        for batch, texts in groups_of_rows(batches, text):
            ids, counts = tables.encode([t or "" for t in texts])
            columns = [*batch.columns, _arrow_lists(ids, counts)]
            if decoded:
                columns.append(_arrow_strings(*tables.decode(ids, counts)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
