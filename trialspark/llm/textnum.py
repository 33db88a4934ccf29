"""Words, lines and shingles of a batch of texts as numpy arrays: one pass over the bytes of many texts at once.

Hashes are 64-bit polynomial sums over random byte values, finished by a mixer, so that equal byte strings have equal
hashes at any place and unequal ones collide with probability about 2**-52 or less for each pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that are hashed at once; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        n = max(n, BATCH_BYTES + BATCH_BYTES // 4)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(n, base)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


class Hashes:
    """Prefix sums over a byte buffer, from which the hash of any of its substrings follows."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of buf[start:end]; the length counts."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * STEP[63])


class Batch:
    """Texts joined by newlines. off: where each text begins, and the end of all; words and their text."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.buf = LOWER[joined] if lower else joined
        self.n = len(texts)
        self.off = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, self.n) + 1, out=self.off[1:])
        self.space = SPACE[self.buf]
        change = np.flatnonzero(self.space[1:] != self.space[:-1]) + 1
        if not self.space[0]:
            change = np.concatenate(([0], change))
        self.start, self.end = change[0::2], change[1::2]
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        self.hashes = Hashes(self.buf)
        self.word = self.hashes.of(self.start, self.end)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[self.off[1:]] - sums[self.off[:-1]]

    def words_per_text(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def grams(self, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-word windows inside one text (of those in at, if given), and the windows' hashes."""
        last = len(self.word) - n
        at = np.arange(max(0, last + 1)) if at is None else at[at <= last]
        at = at[self.doc[at] == self.doc[at + n - 1]]
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h += self.word[at + k] * STEP[k]
        return at, mix(h)


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    flags = np.zeros(len(keys), bool)
    flags[order[1:]] = same
    flags[order[:-1]] |= same
    return flags


def seen_before(keys: np.ndarray) -> np.ndarray:
    """For each key, whether an equal one stands earlier."""
    order = np.argsort(keys, kind="stable")
    flags = np.zeros(len(keys), bool)
    flags[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return flags


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the record batches with at most so many bytes of text (one row at least), and the texts as bytes; null is empty."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        first = size = 0
        for i, text in enumerate(texts):
            if i > first and size + len(text) > most:
                yield batch.slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += len(text)
        if first < len(texts):
            yield batch.slice(first), texts[first:]
