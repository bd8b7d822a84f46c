from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from brute import LOWER, spaced
from hypothesis import given, settings
from hypothesis import strategies as st

from tenderlake.llm import words as W
from tenderlake.llm.fuse import BinaryFuse


@given(st.text(alphabet="aAbZ ñÄ \t\n\x0b漢😀|!", max_size=60))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, hashes, first = W.words(data, W.SPACED, (2,))
    found = [W.FOLD[data[a:b]].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == spaced(text)
    assert [len(set(zip(found, hashes.tolist())))] == [len(set(found))] == [len(set(hashes.tolist()))]
    beginnings = [w.encode()[:2] for w in found]
    assert len(set(zip(beginnings, first.tolist()))) == len(set(beginnings)) == len(set(first.tolist()))


def test_alphanumeric_words_and_null_texts():
    text = "It's 2 EUR—naïve_x\x7fY"
    starts, ends, _ = W.words(np.frombuffer(text.encode(), np.uint8), W.ALPHANUMERIC)
    found = [text.encode()[a:b].decode() for a, b in zip(starts, ends)]
    assert found == re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)
    assert [x.translate(LOWER) for x in found] == ["it", "s", "2", "eur—naïve", "x", "y"]
    assert [None if t is None else len(t) for t in W.texts(pa.array([None, "", "é"]))] == [None, 0, 2]


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 17, 400, 20_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        held = BinaryFuse.build(np.concatenate([keys, keys[: n // 2]]))
        assert held.contains(keys).all()
        others = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
        assert held.contains(others).mean() < 0.01
    assert len(held.cells) < 1.5 * n
