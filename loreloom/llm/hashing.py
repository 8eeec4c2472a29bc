"""Vectorised hashing of words and of runs of symbols, for numpy batches."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least `size` of them."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < size:
        room = max(1 << 16, 1 << (size - 1).bit_length())
        whole = int(BASES[base])
        rows = []
        for value in (whole, pow(whole, -1, 1 << 64)):
            steps = np.full(room, U(value))
            steps[0] = U(1)
            rows.append(np.multiply.accumulate(steps))
        have = _POWERS[base] = (rows[0], rows[1])
    return have


def prefix_sums(symbols: np.ndarray, base: int = 0) -> np.ndarray:
    """Sums of symbol * power, from which the hash of any run follows; one longer than symbols."""
    powers, _ = _powers(len(symbols) + 1, base)
    out = np.zeros(len(symbols) + 1, dtype=U)
    np.cumsum(symbols * powers[: len(symbols)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hashes of the runs [start, end) of the symbols behind `sums`."""
    _, inverse = _powers(len(sums), base)
    return mix((sums[end] - sums[start]) * inverse[start])


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, a line feed after each, and where each text starts (and the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.r_[0, np.cumsum([len(r) + 1 for r in raw])].astype(np.int64)
    return np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8), starts


def word_spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in joined texts, and the number of words in each text."""
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    bounds = np.searchsorted(first, starts)
    return first, last, np.diff(bounds)


def word_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    sums = prefix_sums(raw.astype(U) + U(1))
    return mix(run_hash(sums, first, last) + (last - first).astype(U))


def shingles(
    texts: list[str | None], width: int, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their number per text.

    A text of fewer words than `width` has its whole sequence as one shingle; without words it has
    none.
    """
    raw, starts = joined(texts)
    first, last, counts = word_spans(raw, starts)
    words = word_hashes(LOWER[raw] if lower else raw, first, last)
    ends = np.cumsum(counts)
    heads = ends - counts
    have = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), have)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(have) - have, have)
    at = heads[doc] + within
    out = np.full(len(at), U(width))
    for k in range(width):
        inside = k < counts[doc]
        step = mix(out * U(0x9E3779B97F4A7C15) + words[np.minimum(at + k, len(words) - 1)])
        out = step if inside.all() else np.where(inside, step, out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    fresh = np.r_[True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])][: len(out)]
    return out[fresh], np.bincount(doc[fresh], minlength=len(texts))
