"""Latest-state deduplication: one canonical row per procurement file."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions.contract import buyer_match_key, status_rank
from tenderlake.operators.marks import bit_blocks, marked
from tenderlake.session import let_go, written

RECORD_KEY = ("source", "org_key", "id_origen")
TIE_BREAK = ("entry_id", "source_file_hash")
CROWD = 200_000  # rows from which on a key is reduced before the shuffle


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key by ``order``.

    The row-number filter lets Spark apply a group limit before the shuffle, so each map task
    sends at most one row per key; a key holding much of the data never meets in one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(window))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def with_match_keys(bronze: DataFrame) -> DataFrame:
    """The two derived columns the choice of the canonical record needs."""
    return bronze.withColumns({
        "org_key": buyer_match_key(), "status_rank": status_rank(F.col("estado")),
    })


def latest_first(tie_break: Sequence[str] = TIE_BREAK) -> list[Column]:
    """Most recent, then most advanced; ``updated`` is ISO text and sorts as text."""
    return [
        F.col("updated").desc_nulls_last(),
        F.col("status_rank").desc(),
        *[F.col(c).desc_nulls_last() for c in tie_break],
    ]


def canonical(
    bronze: DataFrame,
    *,
    tie_break: Sequence[str] = TIE_BREAK,
    keep_null_keys: bool = False,
) -> DataFrame:
    """Most recent, most advanced record per (source, buyer, file id).

    Rows without a file id form one group per buyer and collapse to one row; ``keep_null_keys``
    keeps them all instead. The tie-break columns make the result independent of the input order.

    Only the two columns the choice needs are derived here; the others follow on the surviving
    rows, several times fewer than were published.
    """
    base, order = with_match_keys(bronze), latest_first(tie_break)
    if not keep_null_keys:
        return latest_per_key(base, RECORD_KEY, order)
    # One pass: a row without an id is a key of its own.
    alone = F.when(F.col("id_origen").isNull(), F.monotonically_increasing_id())
    return latest_per_key(base.withColumn("_alone", alone), (*RECORD_KEY, "_alone"), order).drop("_alone")


def canonical_made(
    rows: DataFrame,
    make: Callable[[DataFrame], DataFrame],
    *,
    tie_break: Sequence[str] = TIE_BREAK,
    keep_null_keys: bool = False,
    crowd: int = CROWD,
) -> DataFrame:
    """``canonical(make(rows))`` without the columns of ``rows``, for rows narrower than what is made of them.

    ``make`` adds the Bronze columns to the rows it is given. Rows are stored once with a number. Hashes of the
    record keys and these numbers tell which rows share a key with another; only those move, as they were
    stored, and their texts are made where they meet. Rows without a file id, and those of keys of very many
    rows, go the way of ``canonical``, which sends one row per key and task.
    """
    own = rows.columns
    stored = written(rows.withColumn("_n", F.monotonically_increasing_id()))
    let_go(rows.sparkSession)
    unkeyed, key = F.col("id_origen").isNull(), F.xxhash64(*RECORD_KEY)
    same = Window.partitionBy("_key").orderBy("_n")
    met = with_match_keys(make(stored)).where(~unkeyed).select(key.alias("_key"), "_n").select(
        "_key", "_n", F.row_number().over(same).alias("_rn"), F.lead("_n").over(same).alias("_next")
    )
    met = written(met.where("_rn > 1 or _next is not null").select("_n", F.when(F.col("_rn") == crowd, F.col("_key")).alias("_key")))
    crowded = [r[0] for r in met.where("_key is not null").select("_key").collect()]  # one for ``crowd`` rows
    found = with_match_keys(make(marked(stored, written(bit_blocks(met, "_n")), "_n", "_shared")))
    reduced = unkeyed | key.isin(crowded) if crowded else unkeyed

    few = canonical(make(found.where(reduced).select(*own)), tie_break=tie_break, keep_null_keys=keep_null_keys)
    moved = found.where(~reduced & F.col("_shared")).select(*own, key.alias("_key")).repartition("_key")
    chosen = latest_per_key(with_match_keys(make(moved)), ("_key", *RECORD_KEY), latest_first(tie_break))
    alone = found.where(~reduced & ~F.col("_shared"))
    parts = alone.drop("_n", "_shared", *own), chosen.drop("_key", *own), few.drop(*own)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
