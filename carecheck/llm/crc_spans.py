"""CRC-32 of many spans of one byte buffer at once, by a position table.

A CRC is linear over exclusive or: the contribution of a byte depends on its
value and on how many bytes follow it only.  ``_TABLE`` holds the contribution
of every byte value at every distance from the end below ``REACH``, so the CRC
of a span is the exclusive or (``bitwise_xor.reduceat``) of one table entry per
byte and a constant of the span's length (the start value carried over as many
zero bytes).  Longer spans fold block by block: a block of ``REACH`` bytes
pushes the state before it ``REACH`` bytes further, which the same table does.
"""

from __future__ import annotations

import numpy as np

REACH = 64  # bytes a block: 64 kB of table
CHUNK = 1 << 20  # bytes expanded at a time
_ONES = np.uint32(0xFFFFFFFF)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    last = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        last = np.where(last & 1, (last >> 1) ^ np.uint32(0xEDB88320), last >> 1).astype(np.uint32)
    rows, starts = [last], [_ONES]
    for _ in range(REACH):
        rows.append((rows[-1] >> 8) ^ last[rows[-1] & 255])
        starts.append((starts[-1] >> 8) ^ last[starts[-1] & 255])
    return np.concatenate(rows[:REACH]), np.array(starts, dtype=np.uint32)


#: _TABLE[d * 256 + b]: byte b with d bytes after it; _START[n]: the start value after n zero bytes
_TABLE, _START = _tables()


def _reduced(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The contributions of spans of 1 to ``REACH`` bytes."""
    out = np.empty(len(start), dtype=np.uint32)
    ends = np.cumsum(length)
    lo = 0
    while lo < len(start):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        n = length[lo:hi].astype(np.int32)
        first = (ends[lo:hi] - length[lo:hi] - done).astype(np.int32)
        total = int(ends[hi - 1]) - done
        i = np.arange(total, dtype=np.int32)
        after = np.repeat(first + n - 1, n) - i
        at = i + np.repeat(start[lo:hi] - first, n)
        out[lo:hi] = np.bitwise_xor.reduceat(_TABLE[(after << 8) | data[at]], first)
        lo = hi
    return out


def _carried(state: np.ndarray) -> np.ndarray:
    """The state after ``REACH`` zero bytes: it acts as the first four bytes of the block."""
    out = np.zeros_like(state)
    for k in range(4):
        out ^= _TABLE[((REACH - 1 - k) << 8) + ((state >> (8 * k)) & 255).astype(np.int64)]
    return out


def crc32_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 (as zlib's) of ``data[start:start + length]`` for every span; spans may overlap or be empty."""
    start, length = np.asarray(start, dtype=np.int64), np.asarray(length, dtype=np.int64)
    head = length % REACH
    head[length == REACH] = REACH  # one block needs no fold
    state = _START[head].copy()
    some = np.flatnonzero(head)
    state[some] ^= _reduced(data, start[some], head[some])
    at, left = start + head, length - head
    rest = np.flatnonzero(left)
    while len(rest):
        state[rest] = _carried(state[rest]) ^ _reduced(data, at[rest], np.full(len(rest), REACH))
        at[rest] += REACH
        left[rest] -= REACH
        rest = rest[left[rest] > 0]
    return state ^ _ONES
