"""Words of whole texts as 64-bit hashes, computed on UTF-8 bytes with numpy.

Letters A-Z are lower-cased; everything else stays. Separators are single bytes below 0x80, so a
character of several bytes is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x2545F4914F6CDD1D
_ROOT = pow(_BASE, -1, 1 << 64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and shift, both invertible)."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def in_words(separators: list[tuple[int, int]]) -> np.ndarray:
    """Table over bytes: True for those in a word, given ranges of separator bytes."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


SPACED = in_words([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = in_words([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_VALUES = _byte_values()
_powers = np.ones(1, dtype=_U), np.ones(1, dtype=_U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        _powers = tuple(
            np.concatenate([np.ones(1, dtype=_U), np.cumprod(np.full(size - 1, b, dtype=_U))]) for b in (_BASE, _ROOT)
        )
    return _powers


def words(data: np.ndarray, table: np.ndarray, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Byte positions where words start and end, and their hashes; then, for each length in
    ``beginnings``, the hashes of the words' first so many bytes."""
    none = np.zeros(0, dtype=np.int64)
    if not len(data):
        return none, none, *[none.astype(_U)] * (1 + len(beginnings))
    low = FOLD[data]
    inside = np.zeros(len(low) + 2, dtype=bool)
    inside[1:-1] = table[low]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    power, root = _power_tables(len(low))
    sums = np.zeros(len(low) + 1, dtype=_U)
    np.cumsum(_VALUES[low] * power[: len(low)], out=sums[1:])
    hashes = [mixed((sums[ends] - sums[starts]) * root[starts])]
    for size in beginnings:
        part = (sums[np.minimum(ends, starts + size)] - sums[starts]) * root[starts]
        hashes.append(mixed(part + _U(size)))
    return starts, ends, *hashes


def texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    """UTF-8 bytes of each value of a string column; None for null."""
    for value in column.cast(pa.large_binary()):
        buffer = value.as_buffer()
        if buffer is None:
            yield None
        else:
            yield np.frombuffer(buffer, dtype=np.uint8) if buffer.size else np.zeros(0, dtype=np.uint8)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; a shorter text is one run, no words none."""
    n = len(hashes)
    width = min(width, n)
    if not n:
        return hashes
    runs = np.zeros(n - width + 1, dtype=_U)
    for k in range(width):
        runs = mixed(runs + _U(k + 1)) + hashes[k : n - width + 1 + k]
    return np.unique(mixed(runs))
