"""Plain versions of what the text operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

BLANKS = "\x20\x09-\x0D"
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def spaced(text: str | None) -> list[str]:
    return re.findall(f"[^{BLANKS}]+", (text or "").translate(LOWER))


def shingles(text: str | None, width: int) -> frozenset:
    w = spaced(text)
    width = min(width, len(w))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if w else frozenset()


def near_components(rows: list[tuple], width: int, percent: int) -> list[tuple[int, int]]:
    """(set size, smallest id reachable) of each (id, text); rows without a set stand alone."""
    sets = [shingles(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for k, (doc_id, _) in enumerate(rows):
        known = least[root(k)]
        least[root(k)] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return [(len(sets[k]), least[root(k)]) for k in range(len(rows))]


def contamination(texts: list, items: list[tuple], window: int) -> list[tuple]:
    """(words, hit words, items, digest of their ids) of each text; items are (id, text)."""

    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))

    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for number, (name, item) in enumerate(items):
            v = words(item)
            size = min(window, len(v))
            for at in range(len(v) - size + 1 if size else 0):
                for k in range(len(w) - size + 1):
                    if w[k : k + size] == v[at : at + size]:
                        hit.update(range(k, k + size))
                        found.add((number, name))
        names = sorted(str(name) for _, name in found if name is not None)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return out


def exact_groups(rows: list[tuple]) -> dict:
    """id -> (id that stays, group size, digest) for rows (id, text) with distinct ids."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(f"[{BLANKS}]", "", text or "")].append((doc_id, text or ""))
    out = {}
    for plain, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for doc_id, _ in members:
            out[doc_id] = (best, len(members), hashlib.sha256(plain.encode()).hexdigest())
    return out


def least_capacity(sizes: list[int], shards: int) -> int:
    def fits(capacity: int) -> bool:
        used, room = 1, capacity
        for size in sizes:
            if size > capacity:
                return False
            if size > room:
                used, room = used + 1, capacity
            room -= size
        return used <= shards

    low, high = 1, max(1, sum(sizes))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def mix_targets(sizes: dict, most: int = 3) -> dict:
    """Water levels by repeated sharing, over sources in name order with null last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        every = sum(weight[s] for s in free)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / every for s in names}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """By the definition: the best segment, then the same left and right of it."""
    best, found = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, found = total, (i, j + 1)
    if found is None:
        return []
    i, j = found
    right = [(a + j, b + j) for a, b in maximal_segments(scores[j:])]
    return maximal_segments(scores[:i]) + [found] + right


def dice(a: str, b: str) -> float:
    def grams(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return set(zip(w, w[1:]))

    x, y = grams(a), grams(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
