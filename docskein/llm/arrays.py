"""Words and character q-grams of many texts at once, as numpy arrays.

Every function here works on one Arrow batch inside a task; Spark does the partitioning. The words of a text are its
maximal runs of letters, digits and underscores in lower case. Hashes are polynomial over code points (wrapping 64 bits)
with a final mix, so they are the same in every process.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np

#: Kept beside the interpreter, so that the worker processes Spark reuses build a table only once.
CACHE: dict = sys.__dict__.setdefault("_docskein_cache", {})

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
SLICE_CHARS = 1_000_000
HASH_BITS = 48


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64 bits whose outputs look random (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def word_table() -> np.ndarray:
    """For each code point whether it is a letter, a digit or an underscore."""
    if "word_table" not in CACHE:
        table = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
        table[ord("_")] = True
        CACHE["word_table"] = table
    return CACHE["word_table"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n."""
    have = CACHE.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_CHARS + 1)
        out = []
        for base in (BASE, INVERSE):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(x))
        have = (out[0], out[1])
        if size <= 8 * SLICE_CHARS:
            CACHE["powers"] = have
    return have


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of at most 60,000 texts of about limit characters in all; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if (size and size + n > limit) or i - begin >= 60_000:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def hash_runs(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run points[begin:end]."""
    n = len(points)
    powers, inverse = _powers(n + 1)
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((points.astype(U64) + U64(1)) * powers[:n], out=total[1:])
        return mix((total[ends] - total[begins]) * inverse[begins])


def words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 48-bit hash, begin, end, code points) of every word occurrence of the texts, in order.

    begin and end are places in the code points of the lower-cased texts joined by line breaks.
    """
    lowered = [(t or "").lower() for t in texts]
    points = code_points("\n".join(lowered))
    first = np.cumsum([0] + [len(t) + 1 for t in lowered])[:-1]
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = word_table()[points]
    step = np.diff(inside)
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    hashes = hash_runs(points, begins, ends) >> U64(64 - HASH_BITS)
    owner = np.searchsorted(first, begins, side="right") - 1
    return owner, hashes, begins, ends, points


def word_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 48-bit hash) of every distinct word of each text, ordered by both."""
    owner, hashes, *_ = words(texts)
    both = np.unique((owner.astype(U64) << U64(HASH_BITS)) | hashes) if len(texts) < (1 << 16) else None
    if both is None:
        raise ValueError("at most 65535 texts at once")
    return (both >> U64(HASH_BITS)).astype(np.int64), both & U64((1 << HASH_BITS) - 1)
