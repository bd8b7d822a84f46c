"""Price outliers against similar contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.contract import peer_group
from tenderlake.operators.quantiles import exact_median
from tenderlake.session import settle

# Fixed value: scales the median absolute deviation to a standard deviation.
_MAD_SCALE = 1.4826


def peer_statistics(rows: DataFrame, min_peers: int = 30) -> DataFrame:
    """Median and MAD of the log amount per peer group with enough members.

    Both medians are taken from the amounts counted once per peer group.
    """
    counted = settle(rows.groupBy("peer", "limp").agg(F.count("*").alias("rows")))
    medians = exact_median(counted, ["peer"], "limp", weight="rows").where(F.col("n") >= min_peers)
    medians = medians.withColumnRenamed("median", "med")
    distances = counted.join(medians, "peer").select(
        "peer", "rows", F.abs(F.col("limp") - F.col("med")).alias("dist")
    )
    spreads = exact_median(distances, ["peer"], "dist", weight="rows").select("peer", F.col("median").alias("madv"))
    return medians.join(spreads.where("madv > 0"), "peer")


def price_outliers(
    contracts: DataFrame, *, min_peers: int = 30, limit: int = 200, cheapest: bool = False
) -> DataFrame:
    """Contracts by robust z-score of their log amount within the peer group.

    ``cheapest`` looks at the other tail. Peer statistics are computed first, over two narrow
    columns; the wide rows are then scored without a shuffle as long as the statistics are small.
    """
    rows = contracts.where("importe > 0").withColumns({
        "peer": peer_group(F.col("cpv"), F.col("tipo_contrato")),
        "limp": F.ln("importe"),
    })
    stats = peer_statistics(rows.select("peer", "limp"), min_peers)
    z = (F.col("limp") - F.col("med")) / (_MAD_SCALE * F.col("madv"))
    scored = rows.join(stats, "peer").withColumn("z", z)
    first = F.col("z").asc_nulls_last() if cheapest else F.col("z").desc_nulls_last()
    return (
        scored.orderBy(first, "id_origen", "source", "organo_nombre", "link_detalle", "source_file")
        .limit(limit)
        .select(
            "id_origen", "source", "source_file", "year", "ccaa",
            F.substring("objeto", 1, 120).alias("objeto"),
            "organo_nombre", "adjudicatario_nombre", F.round("importe", 2).alias("importe"),
            "cpv", "peer", F.col("n").alias("peers"), "es_acuerdo_marco",
            F.round(F.exp("med"), 2).alias("importe_mediano_peer"),
            F.round("z", 2).alias("score"),
            "link_detalle",
        )
    )
