"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its distinct word shingles. A signature has ``slots`` minima of 16 bits
each, cut into chunks of four. Two sets of similarity J differ in a slot with probability 1 - J, so
a distance limit is known under which all but a ``MISS`` share of the pairs at the threshold lie.
With ``limit < 2 * chunks``, such a pair has a chunk with at most one wrong slot (pigeonhole). The
allowed error is enumerated: each chunk gives four keys, one with each slot left out. So all pairs
within the limit share a key, and their full sets decide.

Pairs of a group are never emitted. Texts with the same set become one node first. Then every node
is compared with one centre, which joins a group of near copies of any size in work linear in it.
Only keys whose members are still in different components are left. Those of at most ``PAIRED``
members give their pairs across components, no more than a fixed number for each member; pairs
within the limit are confirmed by a join. The members of larger keys are laid out in blocks of
bounded size, and pairs of blocks that share such a key are compared inside a task, which returns no
more links than it takes to join their components.

Defined cases: null or empty texts, or texts without words, have no set and link with nothing; a
text of fewer words than a shingle is one shingle. Repeated rows are copies of each other. A null
doc_id is allowed; the component's id is its smallest non-null doc_id. Columns besides the id and the
text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm import words as W
from tenderlake.llm.components import components
from tenderlake.llm.ordered import indexed
from tenderlake.llm.storage import packed, stored, unpacked

CHUNK = 4  # slots in a chunk, of which one may be wrong
MISS = 1e-6  # share of links right at the threshold that the signature may lose
PAIRED = 16  # members up to which a key's pairs are listed
BLOCK_WEIGHT = 300_000  # shingles in a block, where a document counts for 100 more than it has
_ROW_WEIGHT = 100

SIGNED = "doc_id long, text_key long, n_shingles long, set_id binary, signature array<int>"


def chunks_for(similarity: float, miss: float = MISS) -> int:
    """Smallest number of chunks whose guaranteed distance is exceeded with less than ``miss``."""
    wrong, chunks = 1 - similarity, 2
    while True:
        n, limit = CHUNK * chunks, 2 * chunks - 1
        beyond = sum(math.comb(n, k) * wrong**k * (1 - wrong) ** (n - k) for k in range(limit + 1, n + 1))
        if beyond <= miss:
            return chunks
        chunks += 1


def _sign(width: int, slots: int):
    factors = W.mixed(np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            sizes, ids, signatures = [], [], []
            for data in W.texts(batch.column("text")):
                found = W.shingles(W.words(data, W.SPACED)[2], width) if data is not None else ()
                sizes.append(len(found))
                if not len(found):
                    ids.append(None)
                    signatures.append(None)
                    continue
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                lowest = np.full(slots, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(found), 4096):
                    part = found[None, at : at + 4096] * factors[:, None]
                    np.minimum(lowest, part.min(axis=1), out=lowest)
                signatures.append((W.mixed(lowest) & np.uint64(0xFFFF)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(signatures, pa.list_(pa.int32())),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_id", "signature"],
            )

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            found = [W.shingles(W.words(data, W.SPACED)[2], width).view(np.int64) for data in W.texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "items"]
            )

    return run


def _keys(chunks: int):
    """The keys of a signature: chunk, slot left out and the three other slots, in 64 bits."""
    out = []
    for c in range(chunks):
        for left_out in range(CHUNK):
            key = F.lit((c * CHUNK + left_out) << 48)
            rest = [k for k in range(CHUNK) if k != left_out]
            for place, k in enumerate(rest):
                slot = F.col("signature")[c * CHUNK + k].cast("long")
                key = key.bitwiseOR(F.shiftleft(slot, 16 * place))
            out.append(key)
    return F.explode(F.array(*out))


def _linked(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _compare_blocks(percent: int, limit: int):
    """Links that join the components met in two blocks, each confirmed on full sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        signatures = np.stack(rows["signature"].to_numpy())
        nodes, components_ = rows["node"].to_numpy(), rows["component"].to_numpy()
        items = rows["items"].to_numpy()
        sizes = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
        left = np.flatnonzero(~rows["right"].to_numpy())
        right = np.flatnonzero(rows["right"].to_numpy())
        alone = not len(right)
        parent = {c: c for c in components_.tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        links = []
        for at, i in enumerate(left):
            others = left[at + 1 :] if alone else right
            near = (signatures[others] != signatures[i]).sum(axis=1) <= limit
            near &= components_[others] != components_[i]
            low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            near &= 100 * low >= percent * high
            for j in others[near]:
                a, b = root(components_[i]), root(components_[j])
                if a == b:
                    continue
                both = len(np.intersect1d(items[i], items[j], assume_unique=True))
                if _linked(both, sizes[i], sizes[j], percent):
                    parent[max(a, b)] = min(a, b)
                    links.append((nodes[i], nodes[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each node and the centre with which it shares most keys, as (a, b)."""
    return (
        members.where("node != centre")
        .groupBy("node", "centre")
        .agg(F.count("*").alias("shared"))
        .groupBy("node")
        .agg(F.max_by("centre", "shared").alias("b"))
        .withColumnRenamed("node", "a")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    for side in ("a", "b"):
        own = sets.select(F.col("node").alias(side), F.col("items").alias(f"items_{side}"))
        pairs = pairs.join(own, side)
    a, b = F.size("items_a"), F.size("items_b")
    both = F.size(F.array_intersect("items_a", "items_b"))
    return pairs.where(100 * both >= percent * (a + b - both)).select("a", "b")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, node, component, rows) of the keys that still meet several components."""
    members = members.select("key", "node").join(labels, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    open_keys = (
        members.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"))
        .where("low != high")
    )
    return stored(members.join(stored(open_keys.select("key", "rows")), "key"))


def _listed_pairs(rest: DataFrame, nodes: DataFrame, percent: int, limit: int) -> DataFrame:
    """Pairs across components of the small keys, within the distance and size limits."""
    small = rest.where(F.col("rows") <= PAIRED).select("key", "node", "component")
    other = small.select("key", F.col("node").alias("b"), F.col("component").alias("component_b"))
    pairs = (
        small.withColumnRenamed("node", "a")
        .join(other, "key")
        .where("a < b and component != component_b")
        .select("a", "b")
        .distinct()
    )
    for side in ("a", "b"):
        pairs = pairs.join(
            nodes.select(
                F.col("node").alias(side),
                F.col("signature").alias(f"signature_{side}"),
                F.col("n_shingles").alias(f"size_{side}"),
            ),
            side,
        )
    sizes = ("size_a", "size_b")
    differs = F.zip_with("signature_a", "signature_b", lambda x, y: (x != y).cast("int"))
    distance = F.aggregate(differs, F.lit(0), lambda total, x: total + x)
    return (
        pairs.where(100 * F.least(*sizes) >= percent * F.greatest(*sizes)).where(distance <= limit).select("a", "b")
    )


def _block_links(rest: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, limit: int):
    """Links across components of the large keys, from pairs of bounded blocks."""
    rest = rest.where(F.col("rows") > PAIRED)
    placed = (
        rest.groupBy("node")
        .agg(F.max(F.struct("rows", "key")).alias("anchor"), F.first("component").alias("component"))
        .join(nodes.select("node", "n_shingles"), "node")
        .select("node", "component", (F.col("n_shingles") + _ROW_WEIGHT).alias("weight"), "anchor.rows", "anchor.key")
    )
    placed = indexed(placed, ["rows", "key", "component", "node"], "weight")
    placed = stored(placed.select("node", "component", F.floor(F.col("row_start") / BLOCK_WEIGHT).alias("block")))
    seen = (
        rest.select("key", "node")
        .join(placed, "node")
        .groupBy("key", "block")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
    )
    other = seen.select("key", *(F.col(c).alias(f"{c}_2") for c in ("block", "low", "high")))
    pairs = (
        seen.join(other, "key")
        .where("block <= block_2 and not (low = high and low = low_2 and low = high_2)")
        .select("block", "block_2")
        .distinct()
    )
    pairs = stored(pairs)
    rows = placed.join(nodes.select("node", "signature"), "node").join(sets, "node")
    left = rows.join(pairs, "block").withColumn("right", F.lit(False))
    right = (
        rows.withColumnRenamed("block", "block_2")
        .join(pairs.where("block != block_2"), "block_2")
        .withColumn("right", F.lit(True))
    )
    return (
        left.unionByName(right)
        .groupBy("block", "block_2")
        .applyInPandas(_compare_blocks(percent, limit), "a long, b long")
    )


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, n_shingles, component_id and kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets.
    ``text_key`` hashes the text; with doc_id it tells rows apart. ``kept`` marks the component's
    smallest doc_id; rows without a set are kept.
    """
    chunks = chunks_for(percent / 100)
    base = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    signed = stored(base.mapInArrow(_sign(shingle_words, CHUNK * chunks), SIGNED))

    classes = (
        signed.where("set_id is not null")
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min(F.struct("doc_id", "text_key")).alias("row"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
    )
    nodes = stored(indexed(classes, ["set_id"]).withColumnRenamed("row_index", "node"))

    keys = nodes.select("node", _keys(chunks).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("rows")).where("rows > 1")
    # Here and below aggregates are stored before rows are joined to them: only then is a hot key split.
    members = stored(keys.join(stored(shared.select("key", "centre")), "key"))
    candidates = (
        members.select("node").distinct().join(nodes, "node").select("node", "row.doc_id", "row.text_key")
    )
    wanted = candidates.withColumnRenamed("doc_id", "rep_id")
    found = base.join(
        wanted, F.col("rep_id").eqNullSafe(base["doc_id"]) & (wanted["text_key"] == base["text_key"])
    ).select("node", "text")
    # Repeated rows give a node twice.
    sets = stored(found.mapInArrow(_sets(shingle_words), "node long, items array<long>").dropDuplicates(["node"]))

    limit = 2 * chunks - 1
    links = stored(_confirmed(_star_pairs(members), sets, percent))
    rest = _open_members(members, components(links))
    listed = _confirmed(_listed_pairs(rest, nodes, percent, limit), sets, percent)
    blocks = _block_links(rest, nodes, sets, percent, limit)
    labels = components(links.unionByName(listed).unionByName(blocks))

    joined = nodes.select("node", "set_id", "doc_id").join(labels, "node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "node"))
    joined = stored(joined)
    smallest = stored(joined.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    by_set = joined.join(smallest, "component").select("set_id", "component_id")
    columns = ("doc_id", "text_key", "n_shingles", "component_id")
    out = signed.where("set_id is not null").join(by_set, "set_id").select(*columns)
    out = out.unionByName(
        signed.where("set_id is null").withColumn("component_id", F.col("doc_id")).select(*columns)
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each component, and of repeated rows."""
    decided = (
        near_duplicates(docs, shingle_words=shingle_words, percent=percent)
        .where("kept")
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (F.col("n_shingles") > 0).alias("_set"))
        .dropDuplicates(["_id", "_key"])
    )
    keyed = docs.select(packed(docs), "doc_id", F.xxhash64("text").alias("text_key"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))
    kept = keyed.join(decided, same)
    with_set = kept.where("_set").dropDuplicates(["_id", "_key"])
    return unpacked(with_set.unionByName(kept.where("not _set")), docs.columns)
