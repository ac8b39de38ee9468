"""The position-table CRC against zlib."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from carecheck.llm import crc_spans


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.lists(st.tuples(st.integers(0, 700), st.integers(0, 700)), max_size=30), st.sampled_from([1, 50, 1 << 20]))
def test_any_spans(data, spans, chunk):
    kept = crc_spans.CHUNK
    crc_spans.CHUNK = chunk
    try:
        spans = [(min(a, len(data)), min(b, len(data))) for a, b in spans]
        start, length = np.array([min(x) for x in spans], dtype=np.int64), np.array([abs(a - b) for a, b in spans], dtype=np.int64)
        got = crc_spans.crc32_spans(np.frombuffer(data, dtype=np.uint8), start, length)
        assert got.tolist() == [zlib.crc32(data[s:s + n]) for s, n in zip(start, length)]
    finally:
        crc_spans.CHUNK = kept


def test_lengths_around_the_blocks_and_a_long_span():
    data = np.random.default_rng(3).integers(0, 256, 200_000, dtype=np.uint8)
    length = np.array([0, 1, 63, 64, 65, 127, 128, 129, 192, 100_000, 200_000 - 9])
    start = np.arange(len(length)) % 9
    want = [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(start, length)]
    assert crc_spans.crc32_spans(data, start, length).tolist() == want
