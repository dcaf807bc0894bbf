"""Hashed word shingles of Arrow texts, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE, _OTHER = np.random.default_rng(20260101).integers(1, 2**64, (2, 256), np.uint64)   # random numbers per byte
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    return mix64_here(x.copy())


def mix64_here(x: np.ndarray) -> np.ndarray:
    """The same in the array's own place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, at least ``n`` of them."""
    held = _powers.get(0)
    if held is None or len(held[0]) < n:
        size = 1 << max(22, int(n).bit_length())
        def run(base):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)
        held = _powers[0] = run(_STEP), run(_BACK)
    return held


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in a row, and the bounds of the texts in them."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def runs(data: np.ndarray, breaks: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, which never reach over a position in ``breaks``."""
    first = np.zeros(len(data) + 1, bool)
    first[breaks] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """A 64-bit hash of every range of bytes, wherever it lies; ``other`` gives a second, independent one."""
    up, down = powers(len(data) + 1)
    value = (_OTHER if other else _VALUE)[data]
    value *= up[:len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    out = total[ends]
    out -= total[starts]
    out *= down[starts]
    out += (ends - starts).view(np.uint64)
    return mix64_here(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and the first word of each text."""
    data, bounds = raw_bytes(texts)
    data = _LOWER[data]
    starts, ends = runs(data, bounds, ~_WHITE[data])
    return range_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Per text its distinct ``words``-word shingles as sorted 64-bit hashes; fewer words are one shingle."""
    word, first = word_hashes(texts)
    n = max(0, len(word) - words + 1)
    shingle = np.zeros(n, np.uint64)
    for i in range(words):
        shingle *= _STEP
        shingle += word[i:i + n]
        shingle += np.uint64(1)
        mix64_here(shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(shingle[a:b - words + 1]))
        elif b > a:
            few = np.uint64([b - a])
            for i in range(a, b):
                few = mix64(few * _STEP + word[i:i + 1] + np.uint64(2))
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def by_bytes(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in ``column`` each; a longer text is a part of its own."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end
