"""Edit distances of whole texts, by diagonals where the texts are alike and by bits where they are not."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are compared at once on every diagonal, and in one piece along a single one.
NEAR, FAR = 16, 1 << 16


def _slide(a: np.ndarray, b: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How far each i gets along its diagonal k while letters are equal. a and b end in NEAR marks that equal nothing."""
    at = i[:, None] + np.arange(NEAR)
    same = a[at] == b[at + k[:, None]]
    run = np.where(same.all(1), NEAR, same.argmin(1))
    i = i + run
    for d in np.flatnonzero(run == NEAR):
        x, size = int(i[d]), 64
        while True:
            p, q = a[x : x + size], b[x + k[d] : x + k[d] + size]
            n = min(len(p), len(q))
            differ = p[:n] != q[:n]
            first = int(differ.argmax()) if n else 0
            if n == 0 or differ[first]:
                x += first
                break
            x, size = x + n, min(2 * size, FAR)
        i[d] = x
    return i


def _by_diagonals(a: np.ndarray, b: np.ndarray) -> int | None:
    """The distance, from how far each diagonal gets with 0, 1, 2 ... edits; None once that costs, or looks like costing, more than the bits would."""
    n, m = len(a), len(b)
    budget = m * (3 + n / 8000)
    x, y = np.append(a, np.full(NEAR, -1, np.int64)), np.append(b, np.full(NEAR, -2, np.int64))
    lo = hi = e = 0
    far = _slide(x, y, np.zeros(1, np.int64), np.zeros(1, np.int64))
    while not (lo <= m - n <= hi and far[m - n - lo] == n):
        e += 1
        needed = e
        if e >= 8 and e & (e - 1) == 0:  # as many for the rest, after how far these got
            needed = e * n / max(1, min(n, int(far.max())))
        if needed * (60 + needed / 40) > budget:
            return None
        below, above = max(-e, -n), min(e, m)
        wide = np.full(above - below + 3, -(1 << 40), np.int64)
        wide[lo - below + 1 : hi - below + 2] = far
        k = np.arange(below, above + 1)
        i = np.maximum(np.maximum(wide[1:-1] + 1, wide[:-2]), wide[2:] + 1)
        i = np.minimum(i, np.minimum(n, m - k))
        far, lo, hi = _slide(x, y, i, k), below, above
    return e


def _by_bits(a: np.ndarray, b: np.ndarray) -> int:
    """The distance by a column of one-bit differences for each letter of b."""
    n = len(a)
    every, top = (1 << n) - 1, 1 << (n - 1)
    places: dict[int, int] = {}
    up, down, distance = every, 0, n
    for c in b.tolist():
        if c not in places:
            places[c] = int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little")
        equal = places[c]
        across = (((equal & up) + up) ^ up) | equal
        more, less = (down | ~(across | up)) & every, up & across
        distance += 1 if more & top else -1 if less & top else 0
        more, less, kept = (more << 1) | 1, less << 1, equal | down
        up, down = (less | ~(kept | more)) & every, more & kept & every
    return distance


def distance(a: str, b: str) -> int:
    """Insertions, removals and replacements of code points that make b of a."""
    if a == b:
        return 0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return max(len(x), len(y))
    found = _by_diagonals(x, y)
    return _by_bits(x, y) if found is None else found


def edit_distance(a: Column, b: Column) -> Column:
    """The edit distance in code points; null where a text is null. Equal ends are cut off, then the work is the length times the
    distance for texts that are alike, and a 64th of the product of the lengths for others. Texts are whole, however long."""

    @F.arrow_udf("long")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = ((p.as_py(), q.as_py()) for p, q in zip(a, b, strict=True))
        return pa.array([None if p is None or q is None else distance(p, q) for p, q in pairs], pa.int64())

    return of(a, b)


def character_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike."""
    return 1 - edit_distance(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
