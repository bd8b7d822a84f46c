"""Records of the same contract under alternative keys: groups, the record that stands for each
group, and one merged row per group with the feed that each value came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.contract import lookup, status_rank
from tenderlake.operators.linked import key_links, linked_groups, sharing
from tenderlake.operators.marks import bit_blocks, marked
from tenderlake.schema import DUPLICATE_KEYS, SOURCE_PRIORITY
from tenderlake.session import scratch, written

MERGED_FIELDS = (
    "objeto", "organo_nombre", "tipo_contrato", "cpv", "territorio_code", "importe", "fecha_adjudicacion",
    "adjudicatario_nombre", "adj_id",
)


def record_key() -> Column:
    """What tells published records apart."""
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "entry_id", "source_file_hash")])


def standing() -> Column:
    """Order of records within a group, best last: feed, date, status, then ids. Nulls come first."""
    feed = F.coalesce(lookup(SOURCE_PRIORITY, F.col("source")), F.lit(0))
    return F.struct(
        feed.alias("feed"), F.col("updated"), status_rank(F.col("estado")).alias("status"), "entry_id", "source_file_hash"
    )


def duplicate_groups(rows: DataFrame, keys: Sequence[Sequence[str]] = DUPLICATE_KEYS) -> DataFrame:
    """All rows with dup_group_id, dup_rows, id_canonico and is_canonical.

    Records are of one group if they share any of the keys, directly or through others. A group is
    named by the hash of its smallest record key, ``id_canonico`` by that of its best record
    (see ``standing``). Rows repeated with the same record key count as one record. A record
    without partners is a group of its own and moves only in the last join.

    Rows are stored once with a number. Hashes of the keys tell which may have a partner; only those move, and
    links are found between their numbers. The record key is one more key there, so that repeated rows fall
    into one group. What comes between is removed at the end.
    """
    parts = ("source", "updated", "estado", "entry_id", "source_file_hash")
    linked_by = [*keys, ("_record",)]
    columns = sorted({c for key in keys for c in key} | {*parts})
    stored = written(rows.withColumn("_n", F.monotonically_increasing_id()), kept=True)
    with scratch(rows.sparkSession):
        numbers = sharing(stored.select("_n", *columns).withColumn("_record", record_key()), "_n", linked_by)
        blocks = written(bit_blocks(numbers, "_n"), kept=True)
        narrow = written(marked(stored, blocks, "_n", "_shared").where("_shared").select("_n", *columns))
        groups = key_links(narrow.withColumn("_record", record_key()), "_n", linked_by)
        groups = written(linked_groups(groups).toDF("_n", "_group"))
        placed = narrow.select("_n", *parts).join(groups, "_n")
        placed = placed.select("_group", record_key().alias("_record"), standing().alias("standing")).distinct()
        # One row for each group, combined before the shuffle; stored, so that a large group can be split.
        best = placed.groupBy("_group").agg(
            F.min("_record").alias("_root"),
            F.max(F.struct("standing", "_record")).getField("_record").alias("_best"),
            F.max("_record").alias("_last"),
            F.count("*").alias("_rows"),
        )
        best = best.where("_root < _last")  # rows of one record are no group
        best = written(best.select("_group", _digest(F.col("_root")).alias("_root"), _digest(F.col("_best")).alias("_best"), "_rows"))
        decided = written(groups.join(best, "_group").drop("_group"), kept=True)
    rows = marked(stored, blocks, "_n", "_shared").withColumn("_own", _digest(record_key()))
    own = [c for c in stored.columns if c != "_n"]
    one = F.lit(1).cast("bigint")
    alone = rows.where("not _shared").select(*own, *_named(F.col("_own"), one, F.col("_own")), F.lit(True).alias("is_canonical"))
    best = F.coalesce("_best", "_own")
    shared = rows.where("_shared").join(decided, "_n", "left").select(
        *own, *_named(F.coalesce("_root", "_own"), F.coalesce("_rows", one), best), (best == F.col("_own")).alias("is_canonical")
    )
    return alone.unionByName(shared)


def _digest(text: Column) -> Column:
    """SHA-256 as bytes: half as long on the way as the digits that are shown."""
    return F.unhex(F.sha2(text, 256))


def _named(group: Column, rows: Column, best: Column) -> list[Column]:
    shown = lambda digest: F.lower(F.hex(digest))
    return [shown(group).alias("dup_group_id"), rows.alias("dup_rows"), shown(best).alias("id_canonico")]


def merged_contracts(grouped: DataFrame, fields: Sequence[str] = MERGED_FIELDS) -> DataFrame:
    """One row per duplicate group: for each field the value of the best record that has one, and
    its feed (``<field>_fuente``).

    ``grouped`` comes from ``duplicate_groups``. Only groups of several records are aggregated, in
    one pass that is combined before the shuffle.
    """
    taken = {f: F.struct(standing().alias("standing"), F.col(f).alias("value"), "source") for f in fields}

    def columns(best: dict[str, Column]) -> list[Column]:
        parts = []
        for f in fields:
            parts += [best[f].getField("value").alias(f), best[f].getField("source").alias(f"{f}_fuente")]
        return parts

    present = {f: F.when(F.col(f).isNotNull(), s) for f, s in taken.items()}
    alone = grouped.where("dup_rows = 1").select(
        "dup_group_id", "id_canonico", F.lit(1).cast("bigint").alias("registros"),
        F.lit(1).cast("bigint").alias("fuentes"), *columns(present),
    )
    several = grouped.where("dup_rows > 1").groupBy("dup_group_id").agg(
        F.first("id_canonico").alias("id_canonico"), F.count("*").alias("registros"),
        F.size(F.collect_set("source")).cast("bigint").alias("fuentes"),
        *[F.max(s).alias(f"_{f}") for f, s in present.items()],
    )
    several = several.select(
        "dup_group_id", "id_canonico", "registros", "fuentes", *columns({f: F.col(f"_{f}") for f in fields})
    )
    return alone.unionByName(several)
