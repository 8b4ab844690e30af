"""Word hashes of whole texts, vectorised over blocks of documents (numpy inside Spark tasks)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stream(seed: str, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers for ``seed``."""
    return np.frombuffer(hashlib.shake_128(seed.encode()).digest(8 * n), "<u8").copy()


BYTE_CODES = stream("bytes", 256)
STEP = stream("step", 1)[0] | np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 256)
        table = np.full(size, STEP, np.uint64)
        table[0] = 1
        _POWERS = np.multiply.accumulate(table)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits (the public 64-bit finaliser by Stafford)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Hashes of all words of some documents; document ``i`` owns ``words[first[i]:first[i + 1]]``."""

    words: np.ndarray
    first: np.ndarray


def hash_words(texts: list[str | None]) -> Block:
    """Hash the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased; null texts have none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lengths + 1)
    data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    solid = ~WHITE[data]
    begins = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    first = np.concatenate(([0], np.searchsorted(begins, ends)))
    if not len(begins):
        return Block(np.empty(0, np.uint64), first)
    at = np.flatnonzero(solid)
    word_start = np.searchsorted(at, begins)
    size = np.diff(np.append(word_start, len(at)))
    place = np.arange(len(at)) - np.repeat(word_start, size)
    codes = BYTE_CODES[data[at]] * powers(int(size.max()))[place]
    return Block(mix(np.add.reduceat(codes, word_start) + size.astype(np.uint64)), first)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, Block]]:
    """(index of the first text, hashes) for runs of texts of about a megabyte."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BLOCK_BYTES:
            yield start, hash_words(texts[start:i + 1])
            start, held = i + 1, 0
    if start < len(texts):
        yield start, hash_words(texts[start:])


def windows(words: np.ndarray, width: int, codes: np.ndarray) -> np.ndarray:
    """Hash of each run of ``width`` words, in order."""
    n = len(words) - width + 1
    total = words[:n] * codes[0]
    for k in range(1, width):
        total = total + words[k:k + n] * codes[k]
    return mix(total)
