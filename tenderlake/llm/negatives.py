"""Hard-negative mining by length buckets with sorted coordinate lists (LEMP).

Vectors become integers (``floor(scale * x)``), so scores are exact inner products. Rows are put in
order of label and falling length, and cut into groups of ``GROUP_ROWS``, which one task can hold,
and within a group into buckets of ``BUCKET_ROWS``. A bucket keeps, for each coordinate, the sorted
list of its rows' values scaled to unit length. An anchor takes the buckets longest first. The
score it still needs (its k-th best so far, or the lower end of the wanted range) over the lengths
of anchor and bucket is the cosine that a row must reach; above 1 the bucket is passed over. Else
the cosine limits, from below and above, give a feasible range of values for each of the anchor's
``FOCUS`` largest coordinates: with unit vectors p and q, cos(a + b) <= p.q <= cos(a - b) where a
and b are the angles whose cosines are the coordinates of both. The ranges are cut out of the sorted
lists, rows found in all of them are the candidates, and these are verified by their exact score.
Where more than a quarter of a bucket is left, it is verified as one product.

Two such searches: an anchor's best rows of its own label (positives), then for each of these the
best rows of other labels whose score lies within ``low`` to ``high`` per cent of the positive's.

Scale: rows are moved once for each of ``slots`` (more than one only while there are fewer groups
than cores), anchors once for each group they can match: for positives only the groups that hold
their label. The anchors are the stated query set; nothing is broadcast but one count for each
partition. A task holds one group (about 70 MB at 64 dimensions) and a few hundred anchors, whatever
labels are hot; each gives at most ``positives`` or ``positives * negatives`` rows an anchor.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take
no part; nor do those with a component of more than ``LARGEST`` in size or over ``DIMENSIONS``
components, whose scores might not fit a long. Rows of one id count once (the least label, then the
least vector). A shorter vector is as one with zeros after it. Ties go to the smaller id. Negative
positives have no range and get no rows. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.ordered import indexed
from tenderlake.llm.storage import stored

GROUP_ROWS = 1 << 16  # rows that a task holds
BUCKET_ROWS = 4096
FOCUS = 3  # coordinates whose sorted lists are cut
CHUNK = 256  # anchors taken through the buckets at a time
LARGEST = 1 << 24
DIMENSIONS = 1 << 14
_SLACK = 1e-6  # widens every range, far beyond rounding

_ANCHOR = "anchor_id long, positive_id long, positive_score long"
_FOUND = f"{_ANCHOR}, negative_id long, negative_score long"


class Bucket:
    """Rows of similar length with a sorted list of unit values for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels, self.values = ids, labels, values
        lengths = np.sqrt((values * values).sum(axis=1))
        self.longest, self.shortest = lengths.max(), lengths.min()
        unit = values / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").astype(np.int32)
        self.lists = np.take_along_axis(unit, self.order, axis=0)

    def labelled(self, label: int) -> tuple[int, int]:
        """Where the rows of one label lie; rows are in order of label."""
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def feasible(self, unit: np.ndarray, length: float, low: float, high: float) -> np.ndarray | None:
        """Rows that may score within low and high with a vector; None stands for all of them."""
        if not length:
            return None
        # A row's cosine is its score over both lengths: the limits that hold for any row of the bucket.
        reach = length * (self.longest if low > 0 else self.shortest)
        least = low / reach if reach else (math.inf if low > 0 else -1)
        reach = length * (self.shortest if high > 0 else self.longest)
        most = high / reach if reach else (1 if high >= 0 else -math.inf)
        if least > 1 + _SLACK or most < -1 - _SLACK:
            return np.zeros(0, dtype=np.int64)
        near = math.acos(min(1, max(-1, least - _SLACK)))
        far = math.acos(min(1, max(-1, most + _SLACK)))
        if near >= math.pi and far <= 0:
            return None
        n, ranges = len(self.ids), []
        for k in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            a = math.acos(min(1, max(-1, unit[k])))
            first, last = max(0, a - near, far - a), min(math.pi, a + near, 2 * math.pi - far - a)
            if first > last + 2 * _SLACK:
                return np.zeros(0, dtype=np.int64)
            above, below = math.cos(min(math.pi, last)) - _SLACK, math.cos(max(0, first)) + _SLACK
            start, end = np.searchsorted(self.lists[:, k], (above, below))
            end = int(np.searchsorted(self.lists[:, k], below, "right"))
            if end - start < n:
                ranges.append(self.order[start:end, k])
        if not ranges:
            return None
        seen = np.zeros(n, dtype=np.uint8)
        for rows in ranges:
            seen[rows] += 1
        return np.flatnonzero(seen == len(ranges))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows of floats, shorter ones with zeros at the end; whole numbers stay exact."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.shape[1], b.shape[1])  # beyond it one of both has zeros
    return a[:, :width], b[:, :width]


def _products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats while all sums are below 2**53, else in longs."""
    a, b = _same_width(rows, anchors)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by smaller id, in order."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class _Wanted:
    """What an anchor still looks for. ``ranges`` are (key, low, high); the best k of each stay."""

    def __init__(self, ranges: list[tuple[tuple, float, float]], k: int):
        none = np.zeros(0, dtype=np.int64)
        self.ranges, self.k = ranges, k
        self.found = [(none, none)] * len(ranges)

    def limits(self) -> tuple[float, float]:
        lows = [
            max(low, scores[-1]) if len(scores) == self.k else low
            for (_, low, _), (_, scores) in zip(self.ranges, self.found)
        ]
        return min(lows), max(high for _, _, high in self.ranges)

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for n, ((_, low, high), (old, best)) in enumerate(zip(self.ranges, self.found)):
            least = max(low, best[-1]) if len(best) == self.k else low
            fit = (scores >= least) & (scores <= high)
            if fit.any():
                got = np.concatenate([old, ids[fit]]), np.concatenate([best, scores[fit]])
                self.found[n] = _best(*got, self.k)


def _search(buckets: list[Bucket], anchors: list[tuple], own_label: bool) -> None:
    """Take the anchors (id, label, vector, wanted) through the buckets, longest first."""
    vectors = np.stack([v for _, _, v, _ in anchors])
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    units = vectors / np.where(lengths > 0, lengths, 1)[:, None]
    for bucket in sorted(buckets, key=lambda b: -b.longest):
        whole, width = [], bucket.values.shape[1]
        for n, (_, label, _, wanted) in enumerate(anchors):
            first, last = bucket.labelled(label)
            if (first == last) if own_label else (last - first == len(bucket.ids)):
                continue
            low, high = wanted.limits()
            rows = bucket.feasible(units[n, :width], lengths[n], low, high)
            if rows is None or 4 * len(rows) > len(bucket.ids):
                whole.append(n)
            elif len(rows):
                scores = _products(bucket.values[rows], vectors[n : n + 1])[:, 0]
                _verified(bucket, rows, scores, anchors[n], own_label)
        if whole:
            scores = _products(bucket.values, vectors[whole])
            for column, n in enumerate(whole):
                _verified(bucket, None, scores[:, column], anchors[n], own_label)


def _verified(bucket: Bucket, rows: np.ndarray | None, scores: np.ndarray, anchor: tuple, own_label: bool) -> None:
    name, label, _, wanted = anchor
    low, high = wanted.limits()
    fit = (scores >= low) & (scores <= high)
    kept = np.flatnonzero(fit) if rows is None else rows[fit]
    scores = scores[fit]
    other = bucket.labels[kept] != label
    right = ~other & (bucket.ids[kept] != name) if own_label else other
    wanted.take(bucket.ids[kept[right]], scores[right])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """Stretches of one (group, slot) and kind; rows come in this order."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("part", "slot", "kind")])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows]):
            if end > start:
                part, slot, kind = (int(x) for x in keys[:, start])
                yield (part, slot), kind, batch.slice(start, end - start)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("ints"))


def _buckets(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[Bucket]:
    width = max(m.shape[1] for _, _, m in rows)
    values = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, _, m in rows])
    ids, labels = np.concatenate([i for i, _, _ in rows]), np.concatenate([x for _, x, _ in rows])
    cuts = range(0, len(ids), BUCKET_ROWS)
    return [Bucket(*(x[at : at + BUCKET_ROWS] for x in (ids, labels, values))) for at in cuts]


def _searcher(wanted_of, own_label: bool, columns: list[str]):
    """mapInArrow function: the rows of a group become buckets, then anchors are taken through them."""

    def run(batches):
        at, rows, buckets = None, [], []
        for key, kind, batch in _runs(batches):
            if key != at:
                at, rows, buckets = key, [], []
            if kind == 0:
                rows.append(_vectors(batch))
                continue
            if rows:
                rows, buckets = [], _buckets(rows)
            for first in range(0, batch.num_rows if buckets else 0, CHUNK):
                part = batch.slice(first, CHUNK)
                ids, labels, matrix = _vectors(part)
                wants = wanted_of(part)
                anchors = [a for a in zip(ids.tolist(), labels.tolist(), matrix, wants) if a[3].ranges]
                if not anchors:
                    continue
                _search(buckets, anchors, own_label)
                found = [
                    (name, *key, hit, score)
                    for name, _, _, wanted in anchors
                    for (key, _, _), (hits, scores) in zip(wanted.ranges, wanted.found)
                    for hit, score in zip(hits.tolist(), scores.tolist())
                ]
                if found:
                    arrays = [pa.array(c, type=pa.int64()) for c in zip(*found)]
                    yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


def _positives_wanted(k: int):
    return lambda batch: [_Wanted([((), -math.inf, math.inf)], k) for _ in range(batch.num_rows)]


def _negatives_wanted(k: int, low: int, high: int):
    def of(batch):
        return [
            _Wanted(
                [((p["id"], p["score"]), -(-low * p["score"] // 100), high * p["score"] // 100)
                 for p in positives if low * p["score"] <= high * p["score"]], k,
            )
            for positives in batch.column("positives").to_pylist()
        ]

    return of


def _searched(rows: DataFrame, anchors: DataFrame, groups: int, run, schema: str) -> DataFrame:
    """Bring each group's rows, then the anchors that look into it (``part``), to one task for each slot."""
    slots = max(1, math.ceil(2 * rows.sparkSession.sparkContext.defaultParallelism / groups))
    extra = [F.col(c) for c in anchors.columns if c == "positives"]
    sides = [
        rows.select(
            "part", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(0).alias("kind"),
            F.col("row_index").alias("at"), "vec_id", "label", "ints",
        ),
        anchors.select(
            "part", F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int").alias("slot"), F.lit(1).alias("kind"),
            F.lit(0).cast("long").alias("at"), "vec_id", "label", "ints", *extra,
        ),
    ]
    tasks = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return (
        tasks.repartition(groups * slots, "part", "slot")
        .sortWithinPartitions("part", "slot", "kind", "at", "vec_id")
        .mapInArrow(run, schema)
    )


def _ranked(found: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole_vectors(vectors: DataFrame, anchor: Column, vec_id: str, label: str, vector: str, scale: float) -> DataFrame:
    """vec_id, label, ints and whether it is an anchor, of the rows that take part, once for each id."""
    values = F.col(vector).cast("array<double>")
    fit = F.forall(values, lambda x: x.isNotNull() & (F.abs(x * scale) <= LARGEST)) & (F.size(values) <= DIMENSIONS)
    taking = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(fit, F.lit(False))
    # NaN is larger than any number in Spark, so the comparison leaves it out with the infinite ones.
    rows = vectors.where(taking).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.struct(
            F.col(label).cast("long").alias("label"),
            F.transform(values, lambda x: F.floor(x * scale).cast("int")).alias("ints"),
        ).alias("row"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    once = rows.groupBy("vec_id").agg(F.min("row").alias("row"), F.max("anchor").alias("anchor"))
    return once.select("vec_id", "row.label", "row.ints", "anchor")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    *,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = whole_vectors(vectors, anchor, vec_id, label, vector, scale)
    square = F.aggregate("ints", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    placed = indexed(rows.withColumn("square", square), ["label", F.desc("square"), "vec_id"])
    placed = placed.withColumn("part", F.expr(f"row_index div {GROUP_ROWS}").cast("int")).drop("square")
    groups = max(1, math.ceil(placed.count() / GROUP_ROWS))
    anchors = placed.where("anchor").drop("part", "row_index", "anchor")
    # Rows are in order of label, so a label fills neighbouring groups.
    spans = stored(placed.groupBy("label").agg(F.min("part").alias("first"), F.max("part").alias("last")))
    near = anchors.join(spans, "label").withColumn("part", F.explode(F.sequence("first", "last")))
    run = _searcher(_positives_wanted(positives), True, ["anchor_id", "positive_id", "positive_score"])
    best = _ranked(
        _searched(placed, near, groups, run, _ANCHOR), ["anchor_id"], "positive_score", "positive_id", positives
    )
    # At most ``positives`` structs for each anchor.
    gathered = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))))
        .alias("positives")
    )
    looking = stored(anchors.join(gathered, "vec_id"))
    wide = looking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    run = _searcher(_negatives_wanted(negatives, low, high), False, columns)
    found = _searched(placed, wide, groups, run, _FOUND)
    return _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
