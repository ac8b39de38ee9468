"""Words and word shingles of many texts at once, in numpy.

Words are runs of characters other than space and U+0009..U+000D, with A-Z
lower-cased; both are byte-level rules that UTF-8 keeps intact.  A word is
represented by a 64-bit hash of its bytes, a shingle by one of its words'."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
CHUNK = 1 << 19  # bytes tokenised at a time, which take about 50 times their room; memory bound only
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: one-to-one, every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x5851F42D4C957F2D
_POWERS = np.ones(1, np.uint64)
_SEATS = mix(np.arange(101, 101 + WIDTH, dtype=np.uint64)) | U(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        n = max(n, 2 * len(_POWERS))
        p = np.full(n, _STEP, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def _hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a byte array."""
    data = _LOWER[data]
    blank = _SPACE[data]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.arange(len(data), dtype=np.int64)
    offset = at - np.maximum.accumulate(np.where(first, at, 0))
    offset[blank] = 0
    value = _BYTE[data] * _powers(int(offset.max()) + 1)[offset]
    value[blank] = 0
    return mix(np.add.reduceat(value, starts)), starts


def _slices(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space."""
    a = 0
    while a < len(raw):
        b = min(len(raw), a + CHUNK)
        if b < len(raw):
            ends = [k for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (k := raw.find(c, b)) >= 0]
            b = min(ends) if ends else len(raw)
        yield raw[a:b]
        a = b


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    group: list[bytes] = []
    size = 0

    def flush():
        data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
        h, starts = _hash(data)
        ends = np.cumsum([len(g) + 1 for g in group])
        return np.split(h, np.searchsorted(starts, ends)[:-1])

    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if len(raw) > CHUNK:
            if group:
                yield from flush()
                group, size = [], 0
            yield np.concatenate([_hash(np.frombuffer(s, np.uint8))[0] for s in _slices(raw)])
            continue
        group.append(raw)
        size += len(raw) + 1
        if size > CHUNK:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted distinct 5-word shingles; with fewer words the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    if n < WIDTH:
        return mix(np.array([(words * _SEATS[:n]).sum(dtype=np.uint64) + U(n)], np.uint64))
    total = words[:n - WIDTH + 1] * _SEATS[0]
    for j in range(1, WIDTH):
        total = total + words[j:n - WIDTH + 1 + j] * _SEATS[j]
    return np.unique(mix(total))
