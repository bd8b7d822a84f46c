"""Groups of linked records: connected components over links and over alternative keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tenderlake.session import written


def key_links(rows: DataFrame, record: str, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Links (a, b) from each record to the smallest record that shares one of the keys with it.

    A key with a missing part links nothing. A key of n records gives n - 1 links to its smallest
    record, found by a minimum that is combined before the shuffle. Keys travel as 128-bit digests; with
    records that are numbers, rows stay narrow and nothing is sorted for the minimum.
    """
    each = [
        F.when(
            _complete(key),
            F.unhex(F.md5(F.concat(F.lit(f"{n} "), F.to_json(F.struct(*[F.col(c) for c in key]))))),
        )
        for n, key in enumerate(keys)
    ]
    keyed = rows.select(F.col(record).alias("a"), F.explode(F.array_compact(F.array(*each))).alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b < last")
    return keyed.join(written(hubs.drop("last")), "key").where("a != b").select("a", "b").distinct()


CROWD = 200_000  # rows from which on those of a key are not brought together to be counted


def sharing(rows: DataFrame, record: str, keys: Sequence[Sequence[str]], crowd: int = CROWD) -> DataFrame:
    """Numbers of all records that share one of the keys with another, and perhaps of a few more; numbers may repeat.

    Keys travel as 64-bit hashes with the numbers alone. Hashes that very many records have count as shared
    without being brought together.
    """
    each = [F.when(_complete(key), F.xxhash64(F.lit(n), *[F.col(c) for c in key])) for n, key in enumerate(keys)]
    keyed = rows.select(F.col(record), F.explode(F.array_compact(F.array(*each))).alias("_key"))
    (common,) = keyed.agg(F.expr("approx_top_k(_key, 100, 10000)")).first()
    heavy = F.col("_key").isin([r.item for r in common if r["count"] >= crowd])
    same = Window.partitionBy("_key").orderBy(record)
    met = keyed.where(~heavy).select(record, F.row_number().over(same).alias("_rn"), F.lead(record).over(same).alias("_next"))
    return met.where("_rn > 1 or _next is not null").select(record).unionByName(keyed.where(heavy).select(record))


def _complete(key: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(c).isNotNull()
    return out


def _lowest(links: DataFrame) -> DataFrame:
    """The smaller of each node and its smallest neighbour.

    Stored, so that the join back reads both sides from a shuffle and a node with very many
    neighbours can be split over tasks.
    """
    return written(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between texts as edges between numbers in the order of the texts, and the numbers' names."""
    nodes = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct()
    # Numbers follow the sort: they grow from partition to partition, and within each.
    names = written(nodes.orderBy("a").select(F.col("a").alias("name"), F.monotonically_increasing_id().alias("n")))
    for side in ("a", "b"):
        edges = edges.join(names.toDF(side, f"{side}_n"), side)
    return edges.select(F.col("a_n").alias("a"), F.col("b_n").alias("b")), names


def linked_groups(links: DataFrame) -> DataFrame:
    """Links (a, b) to (record, root): the smallest record that can be reached.

    Alternating stars: first every node's larger neighbours are hung on the smallest record among
    the node and its neighbours, then its smaller ones. The number of rounds grows with the
    logarithm of the longest chain, and links and roots stay distributed. Records without a link to
    another are left out; nulls link nothing. Texts are numbered for the rounds.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before, names = written(edges), None, None
    if isinstance(edges.schema["a"].dataType, StringType):
        edges, names = _numbered(edges)
        edges = written(edges)
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lowest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.where("a != b").distinct())
        small = large.join(_lowest(large), "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            small.select("a", F.col("low").alias("b"))
        )
        edges = written(small.where("a != b").distinct())
    roots = edges.select(F.col("b").alias("record")).distinct().withColumn("root", F.col("record"))
    found = edges.toDF("record", "root").unionByName(roots)
    if names is None:
        return found
    found = found.toDF("record_n", "root_n")
    for side in ("record", "root"):
        found = found.join(names.toDF(side, f"{side}_n"), f"{side}_n")
    return found.select("record", "root")
