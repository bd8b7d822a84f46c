"""Exact duplicates against immutable snapshots, screened by static binary-fuse filters.

Texts are equal when they are identical without blanks (space, tab to carriage return). The digest is
the SHA-256 of what is left. A snapshot is a set of distinct digests, dealt into buckets by hash;
for each bucket a binary-fuse filter is built once and never changed. A new batch is first grouped
by digest, in which its own duplicates meet; each distinct digest is then screened by its bucket's
filter. Most new digests end there. The positives join the snapshot's exact digests, and for equal
digests the normalised texts themselves are compared. To fetch these texts, a filter over the wanted
rows is broadcast while it is small, so that few other texts are moved; beyond that the join alone does it.

A digest occurs once in each of these tables, however many copies there are, since counts and the
row that stays are combined before the shuffle. Buckets hold about ``BUCKET_KEYS`` digests; their
number grows with the snapshot.

Defined cases: a null text counts as empty, and all texts without other characters are equal.
Repeated rows are copies; of equal texts the longest original stays, then the smallest doc_id (a
null id is last). An empty snapshot or batch is allowed. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tenderlake.llm.fuse import BinaryFuse
from tenderlake.llm.storage import stored

BUCKET_KEYS = 100_000
SCREENED_KEYS = 1_000_000  # wanted rows up to which one filter over them (1.2 MB) is broadcast
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), BLANKS, "")


def _digested(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_chars and digest of each row."""
    return docs.select(
        "doc_id",
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"),
        F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2(normalised("text"), 256).alias("digest"),
    )


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each digest: how many rows have it, and the one that stays."""
    order = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    return rows.groupBy("digest").agg(F.count("*").alias("rows"), F.min(order).alias("best"))


def _key() -> Column:
    return F.xxhash64("digest")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(3)), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """Immutable: exact digest classes, and a filter for each bucket of them."""

    classes: DataFrame
    filters: DataFrame
    buckets: int


def _build_filter(rows: pd.DataFrame) -> pd.DataFrame:
    built = BinaryFuse.build(rows["key"].to_numpy().view(np.uint64))
    return pd.DataFrame(
        [(rows["bucket"].iloc[0], built.seed, built.length, built.segments, built.cells)],
        columns=["bucket", "seed", "length", "segments", "cells"],
    )


_FILTER = "bucket int, seed int, length int, segments int, cells binary"


def snapshot(rows: DataFrame) -> Snapshot:
    """A snapshot of digested rows."""
    classes = stored(_classes(rows))
    buckets = max(1, math.ceil(classes.count() / BUCKET_KEYS))
    keyed = classes.select(_bucket(buckets).alias("bucket"), _key().alias("key"))
    return Snapshot(classes, stored(keyed.groupBy("bucket").applyInPandas(_build_filter, _FILTER)), buckets)


def _screen(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(filters):
        return rows.iloc[:0][["digest"]]
    f = filters.iloc[0]
    held = BinaryFuse(int(f["seed"]), int(f["length"]), int(f["segments"]), f["cells"])
    return rows.loc[held.contains(rows["key"].to_numpy().view(np.uint64)), ["digest"]]


def positives(batch: DataFrame, known: Snapshot) -> DataFrame:
    """Digests of the batch's classes that the snapshot's filters let through."""
    # Buckets are salted so that a batch much larger than the snapshot still comes in groups of bounded size.
    parts = max(1, math.ceil(batch.count() / (BUCKET_KEYS * known.buckets)))
    salt = F.pmod(F.xxhash64("digest", F.lit(5)), F.lit(parts)).cast("int")
    rows = batch.select("digest", _key().alias("key"), _bucket(known.buckets).alias("bucket"), salt.alias("salt"))
    filters = known.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (
        rows.groupBy("bucket", "salt")
        .cogroup(filters.groupBy("bucket", "salt"))
        .applyInPandas(_screen, "digest string")
    )


def _screened(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that may be wanted, by a broadcast filter over (doc_id, text_key); all if too many are."""
    if wanted.count() > SCREENED_KEYS:
        return keyed
    keys = wanted.select(F.lit(0).alias("bucket"), F.xxhash64("_id", "_key").alias("key"))
    built = keys.groupBy("bucket").applyInPandas(_build_filter, _FILTER).collect()
    if not built:
        return keyed.where(F.lit(False))
    f = built[0]
    held = keyed.sparkSession.sparkContext.broadcast(BinaryFuse(f["seed"], f["length"], f["segments"], bytes(f["cells"])))

    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(held.value.contains(keys.to_numpy().view(np.uint64)))

    return keyed.where(F.pandas_udf(maybe, BooleanType())(F.xxhash64("doc_id", "text_key")))


def _text_of(classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The normalised text of each class's row that stays."""
    wanted = classes.select("digest", F.col("best.doc_id").alias("_id"), F.col("best.text_key").alias("_key"))
    wanted = stored(wanted)
    keyed = docs.select(
        "doc_id", "text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")
    )
    keyed = _screened(keyed, wanted).select("doc_id", "text_key", normalised("text").alias(name))
    found = wanted.join(keyed, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
    return found.select("digest", name).dropDuplicates(["digest"])


def known_classes(batch: DataFrame, known: Snapshot, batch_docs: DataFrame, known_docs: DataFrame) -> DataFrame:
    """(digest, rows, best) of snapshot classes that are also in the batch, checked byte by byte."""
    passed = positives(batch, known)
    both = stored(known.classes.join(passed, "digest"))
    ours = _text_of(batch.join(both.select("digest"), "digest", "left_semi"), batch_docs, "ours")
    theirs = _text_of(both, known_docs, "theirs")
    equal = ours.join(theirs, "digest").where("ours = theirs").select("digest")
    return both.join(equal, "digest", "left_semi")


def exact_duplicates(snapshots: list[DataFrame], batch: DataFrame) -> DataFrame:
    """One row for each row of the snapshots and the batch: doc_id, text_key, keep_id, group_size,
    kept and text_sha256. Snapshots may share digests with each other."""
    batches = [*snapshots, batch]
    digested = [stored(_digested(docs)) for docs in batches]
    earlier: list[tuple[Snapshot, DataFrame]] = []
    merged = None
    for docs, rows in zip(batches, digested):
        own = stored(_classes(rows))
        found = [known_classes(own, s, docs, s_docs) for s, s_docs in earlier]
        parts = own if merged is None else merged.unionByName(own)
        # A digest that an earlier snapshot is confirmed to hold is one class with it; others are new.
        confirmed = functools.reduce(DataFrame.unionByName, [f.select("digest") for f in found]) if found else None
        if confirmed is not None:
            confirmed = stored(confirmed.distinct())
            again = parts.join(confirmed, "digest", "left_semi")
            again = again.groupBy("digest").agg(F.sum("rows").alias("rows"), F.min("best").alias("best"))
            parts = parts.join(confirmed, "digest", "left_anti").unionByName(again)
        merged = stored(parts)
        if rows is not digested[-1]:
            earlier.append((snapshot(rows), docs))
    rows = functools.reduce(DataFrame.unionByName, digested)
    best = merged.select("digest", F.col("rows").alias("group_size"), F.col("best.doc_id").alias("keep_id"), "best")
    out = rows.join(best, "digest")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("best.text_key"))
    return out.select(
        "doc_id", "text_key", "keep_id", "group_size", same.alias("kept"), F.col("digest").alias("text_sha256")
    )
