"""Shards by minimax contiguous partition.

Equal texts are one atomic group; groups stand in the order of their smallest doc_id. The smallest
capacity for which the ordered groups fit into the given number of shards is found by binary search
with a greedy check. Group sizes stay distributed: the driver sees, for bins of the running size, the
first and last group end in each. With these a greedy check is bounded from both sides; bins that
leave a decision open are split further, so capacity and cuts are exact while the driver holds a
bounded number of bins. The cuts then keep every shard within that capacity and, where groups
allow, near the mean of what is left, so that the last shards do not stay empty.

Only DataFrame functions touch rows. Defined cases: a null text counts no bytes and has no
checksum; null texts are one group, empty texts another. Rows with a null doc_id come first in
their group. A group larger than the mean makes its shard larger than the others; groups are never
cut. With fewer groups than shards, some shards are empty. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.ordered import indexed
from tenderlake.llm.storage import stored

ROW_OVERHEAD = 16  # bytes that a row counts besides its text
BINS = 4096  # bins of the whole, at first
SPLIT = 256  # parts of a bin that is looked at more closely


class Ends:
    """Group ends (running sizes), known by bins and looked up exactly where it matters."""

    def __init__(self, ends: DataFrame):
        self.ends = ends
        seen = ends.agg(F.max("end").alias("total"), F.max("size").alias("largest")).first()
        self.total, self.largest = seen["total"] or 0, seen["largest"] or 0
        self.widths = [max(1, -(-self.total // BINS))]
        self.bins: dict[tuple[int, int], tuple[int, int]] = {}
        self.lows, self.highs, self.keys = [], [], []
        if self.total:
            self._add(0, None)
        self.open: set[tuple[int, int]] = set()

    def _add(self, level: int, parents: list[int] | None) -> None:
        width = self.widths[level]
        rows = self.ends
        if parents is not None:
            rows = rows.where(F.expr(f"end div {self.widths[level - 1]}L").isin(parents))
        found = rows.groupBy(F.expr(f"end div {width}L").alias("bin")).agg(
            F.min("end").alias("low"), F.max("end").alias("high")
        )
        for r in found.collect():  # at most BINS, or SPLIT for each parent
            self.bins[level, r["bin"]] = r["low"], r["high"]
        ordered = sorted((low, high, key) for key, (low, high) in self.bins.items())
        self.lows = [x[0] for x in ordered]
        self.highs = [x[1] for x in ordered]
        self.keys = [x[2] for x in ordered]

    def refine(self) -> bool:
        """Split the bins that left a lookup open; False if there were none."""
        by_level = defaultdict(list)
        for key in self.open:
            by_level[key[0]].append(key[1])
        self.open = set()
        for level, parents in sorted(by_level.items()):
            if level + 1 == len(self.widths):
                self.widths.append(max(1, -(-self.widths[level] // SPLIT)))
            for parent in parents:
                del self.bins[level, parent]
            self._add(level + 1, parents)
        return bool(by_level)

    def below(self, x: int, most: bool = False) -> int:
        """The last end at or below ``x``; 0 if none. Inside an open bin: a bound from below, or with
        ``most`` from above."""
        at = bisect_right(self.lows, x) - 1
        if at < 0:
            return 0
        if self.highs[at] <= x:
            return self.highs[at]
        if self.lows[at] == x:
            return x
        self.open.add(self.keys[at])
        return x if most else self.lows[at]

    def above(self, x: int) -> int:
        """The first end at or above ``x``; inside an open bin its last."""
        at = bisect_left(self.highs, x)
        if self.lows[at] >= x:
            return self.lows[at]
        if self.highs[at] > x:
            self.open.add(self.keys[at])
        return self.highs[at]

    def fits(self, capacity: int, shards: int, start: int = 0, most: bool = False) -> bool:
        """Greedy check: do the groups after ``start`` fit into so many shards?"""
        at = start
        for _ in range(shards):
            if at >= self.total:
                return True
            end = self.below(at + capacity, most)
            if end <= at:
                return False
            at = end
        return at >= self.total


def _least(fits, low: int, high: int) -> int:
    """Smallest value in [low, high] for which ``fits`` holds; it holds for high and all above it."""
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return low


def capacity(ends: Ends, shards: int) -> int:
    """The smallest feasible shard capacity."""
    if not ends.total:
        return 0
    low, high = max(-(-ends.total // shards), ends.largest), ends.total
    while True:
        ends.open = set()
        low = _least(lambda c: ends.fits(c, shards, most=True), low, high)
        high = _least(lambda c: ends.fits(c, shards), low, high)
        if low == high:
            return low
        ends.open = set()
        for c in (low, high):
            ends.fits(c, shards)
            ends.fits(c, shards, most=True)
        ends.refine()


def cuts(ends: Ends, shards: int, most: int) -> list[int]:
    """Where shards 1, 2, ... start, as running sizes: within the capacity ``most`` and near the mean."""
    while True:
        ends.open = set()
        at, out = 0, []
        for left in range(shards, 1, -1):
            aim = at + -(-(ends.total - at) // left)
            options = [e for e in {ends.below(aim), ends.above(aim)} if at < e <= at + most] if at < ends.total else []
            options = [e for e in options if ends.fits(most, left - 1, start=e)]
            at = min(options, key=lambda e: (abs(e - aim), e)) if options else ends.below(at + most)
            out.append(at)
        if not ends.refine():
            return out


def shards(docs: DataFrame, *, shards: int = 40) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot and grown_shard."""
    text = F.col("text").cast("string")
    rows = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
        )
    )
    rows = rows.withColumn("check", F.coalesce("text_crc32", F.lit(-1)))
    key = ["hash", "size", "check"]
    # Stored, so that the join reads both sides from a shuffle and a hot group's rows can be split.
    groups = stored(rows.groupBy(*key).agg(F.min("doc_id").alias("first")))
    rows = rows.join(groups, key)
    placed = stored(indexed(rows, ["first", "hash", "check", "size", "doc_id"], "size"))
    ends = stored(
        placed.groupBy("first", "hash", "check", "size")
        .agg(F.max(F.col("row_start") + F.col("size")).alias("end"), F.sum("size").alias("bytes"))
        .select("end", F.col("bytes").alias("size"))
    )
    known = Ends(ends)
    at = cuts(known, shards, capacity(known, shards))
    # Sizes are never 0, so a row starts at or after a cut exactly if its group lies behind it.
    bounds = F.lit(at).cast("array<bigint>")
    placed = placed.withColumn("shard", F.size(F.filter(bounds, lambda cut: cut <= F.col("row_start"))))
    starts = placed.groupBy("shard").agg(F.min("row_index").alias("before"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_index") - F.col("before")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
