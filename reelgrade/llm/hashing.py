"""64-bit hashes of words and shingles, and groups of equal pieces, over whole buffers with numpy."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import sys

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Words that a worker remembers before it starts anew, and the longest of them in bytes.
MEMORY_WORDS, MEMORY_BYTES = 200_000, 48
#: Characters compared at a time; a longer piece is compared alone.
COMPARED = 1 << 19


_holder: dict = {}


def claim(owner: str, forget) -> None:
    """Called by an operator in a Python worker before it remembers words: what the worker held for another is forgotten,
    as workers are used again from operator to operator, and free memory goes back to the machine. ``forget`` empties the
    owner's memory."""
    if _holder.get("owner") == owner:
        return
    give_back()
    _holder.update(owner=owner, forget=forget)


def give_back() -> None:
    """What the worker remembers is forgotten, and its free memory goes back to the machine."""
    if "forget" in _holder:
        _holder["forget"]()
        _holder.clear()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)


def given_back(run):
    """A function over batches after whose last one the worker gives its memory back: it stays alive, idle, beside
    operators that need no Python."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed odd pseudo-random words, alike on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_STEP = stream(12, SHINGLE)


class _Words(dict):
    """The leading 64 bits of each word's BLAKE2b digest: no two words are known that share them."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= MEMORY_BYTES:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = found
        return found


_words = _Words()


def word_hashes(joined: bytes) -> np.ndarray:
    """A hash for each word of a text whose words are separated by single spaces."""
    claim("words", _words.clear)
    words = joined.split(b" ") if joined else []
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; with fewer words, of the whole sequence."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        k = min(size, n)
        h = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h += words[i : n - k + 1 + i] * _STEP[i]
        return np.unique(mix(h))


def words_of(text: str | None) -> bytes:
    """A-Z in lower case, words of ``[^\\x20\\x09-\\x0D]+`` joined by single spaces, as UTF-8."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def distinct(points: np.ndarray, start: np.ndarray, stop: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one piece of each kind, and for every piece its kind; pieces are ``points[start:stop]``.

    A hash only proposes: every piece is compared character by character with the one that stands for it.
    """
    _, first, kind = np.unique(hashed, return_index=True, return_inverse=True)
    like, size = first[kind], stop - start
    other = size != size[like]
    todo = np.flatnonzero(~other & (like != np.arange(len(like))))
    for i in todo[size[todo] > COMPARED].tolist():
        a, b, n = int(start[i]), int(start[like[i]]), int(size[i])
        other[i] = not np.array_equal(points[a : a + n], points[b : b + n])
    todo = todo[(size[todo] > 0) & (size[todo] <= COMPARED)]
    ends = np.cumsum(size[todo])
    for part in np.split(todo, np.searchsorted(ends, np.arange(COMPARED, ends[-1], COMPARED))) if len(todo) else ():
        n = size[part]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum())
        unequal = points[np.repeat(start[part] - begin, n) + step] != points[np.repeat(start[like[part]] - begin, n) + step]
        if unequal.any():
            other[part] = np.logical_or.reduceat(unequal, begin)
    if other.any():
        own: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(other).tolist():
            k = own.setdefault(points[start[i] : stop[i]].tobytes(), len(first) + len(own))
            if k == len(first) + len(more):
                more.append(i)
            kind[i] = k
        first = np.concatenate((first, more))
    return first, kind
