"""Static binary-fuse filters: one byte a key and a bit, no false negatives, 1 in 256 false positives.

A key has one place in each of three consecutive segments; its fingerprint is the exclusive or of the
three bytes there. Keys are laid down by peeling places that only one remaining key uses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tenderlake.llm.words import mixed

_U = np.uint64
_TRIES = 100


def _shape(keys: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of starting segments for so many keys."""
    length = 1 << max(2, min(18, int(np.log(max(keys, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(keys, 2)))
    segments = max(1, -(-int(keys * factor) // length) - 2)
    return length, segments


def _places(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three places (3 x keys) and the fingerprints of 64-bit keys."""
    h = mixed(keys + _U(seed) * _U(0xD1342543DE82EF95))
    first = ((h >> _U(32)) * _U(segments)) >> _U(32)
    inside = _U(length - 1)
    places = [first * _U(length) + (h & inside)]
    for step, shift in ((1, 18), (2, 36)):
        places.append((first + _U(step)) * _U(length) + ((mixed(h + _U(shift)) >> _U(shift // 2)) & inside))
    return np.stack(places).astype(np.int64), (mixed(h) >> _U(56)).astype(np.uint8)


@dataclass(frozen=True)
class BinaryFuse:
    seed: int
    length: int
    segments: int
    cells: bytes

    @staticmethod
    def build(keys: np.ndarray) -> BinaryFuse:
        """A filter over distinct 64-bit keys."""
        keys = np.unique(keys.astype(_U))
        length, segments = _shape(len(keys))
        for seed in range(1, _TRIES + 1):
            if seed % 10 == 0:  # unlucky sizes get more room
                segments += max(1, segments // 10)
            cells = BinaryFuse._laid(keys, seed, length, segments)
            if cells is not None:
                return BinaryFuse(seed, length, segments, cells.tobytes())
        raise RuntimeError("no layout found for the filter")

    @staticmethod
    def _laid(keys: np.ndarray, seed: int, length: int, segments: int) -> np.ndarray | None:
        places, prints = _places(keys, seed, length, segments)
        size = (segments + 2) * length
        uses = np.bincount(places.ravel(), minlength=size)
        owners = np.zeros(size, dtype=np.int64)  # exclusive or of the numbers of the keys that use a place
        for row in places:
            np.bitwise_xor.at(owners, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(uses == 1)
            if not len(single):
                return None
            peeled, at = np.unique(owners[single], return_index=True)
            rounds.append((peeled, single[at]))
            for row in places:
                np.subtract.at(uses, row[peeled], 1)
                np.bitwise_xor.at(owners, row[peeled], peeled)
            left -= len(peeled)
        cells = np.zeros(size, dtype=np.uint8)
        for peeled, at in reversed(rounds):
            # A place freed in a round is not used by keys laid down later, so a round is one step.
            spots = places[:, peeled]
            others = np.where(spots == at, 0, cells[spots])
            cells[at] = prints[peeled] ^ others[0] ^ others[1] ^ others[2]
        return cells

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the filter, and for about 1 in 256 others."""
        places, prints = _places(keys.astype(_U), self.seed, self.length, self.segments)
        cells = np.frombuffer(self.cells, dtype=np.uint8)[places]
        return (cells[0] ^ cells[1] ^ cells[2]) == prints
