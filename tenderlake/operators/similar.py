"""Contracts with nearly the same subject: a similarity join in SQL expressions.

Records of one region, year and amount band with the same folded subject are one class. Two classes
of a region and year are linked if their bands are the same or neighbours and the edit distance of
their subjects is at most ``(100 - percent) %`` of the longer one. Classes, not records, are
compared, so a subject that everybody uses is one row for each band.

Candidates come from a prefix filter on numbered q-grams (the second "de" of a text is another gram
than the first). With n letters and at most k edits, n - q + 1 - qk grams survive; so if each text
puts its grams in one order, rarest first, two similar texts share one of their first qk + 1. Where
such a gram is common in a block (more than ``hot`` classes), a second one is asked for: similar
texts share two of their first qk + 2, and the pair of both is the key. Length, band and the edit
distance are then verified. Candidates meet once, at their first common key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.text import fold_accents
from tenderlake.operators.linked import linked_groups
from tenderlake.session import written

Q = 2
BAND = 1.1  # each amount band reaches from one power of it to the next
HOT = 200


def folded_subject(subject: Column) -> Column:
    """Lower case without accents, other signs as single blanks."""
    return F.btrim(F.regexp_replace(fold_accents(F.lower(subject)), "[^a-z0-9]+", " "))


def amount_band(amount: Column) -> Column:
    """Number of the logarithmic band; NULL for amounts that are not positive."""
    # Rounded, so that amounts right on a power fall into the same band everywhere.
    return F.when(amount > 0, F.floor(F.round(F.ln(amount) / math.log(BAND), 9)).cast("bigint"))


def _edits(size: Column, percent: int) -> Column:
    """Most edits that a text of this length may be away from any similar one."""
    return F.floor(size * (100 - percent) / percent).cast("int")


def _check(percent: int) -> None:
    for n in range(1, 10_000):
        k = n * (100 - percent) // percent
        if k and n - Q + 1 - Q * k < 2:
            raise ValueError(f"texts of {n} letters have too few {Q}-grams for {percent} %")


def subject_classes(contracts: DataFrame) -> DataFrame:
    """clase, ccaa, year, tramo, texto, registros: the contracts that take part, as classes."""
    rows = contracts.select(
        "ccaa", "year", amount_band(F.col("importe")).alias("tramo"), folded_subject(F.col("objeto")).alias("texto")
    ).where("ccaa is not null and year is not null and tramo is not null and texto <> ''")
    classes = rows.groupBy("ccaa", "year", "tramo", "texto").agg(F.count("*").alias("registros"))
    return classes.withColumn("clase", class_name())


def class_name(band: str = "tramo", text: str = "texto") -> Column:
    return F.sha2(F.concat_ws("|", "ccaa", F.col("year").cast("string"), F.col(band).cast("string"), text), 256)


def _ordered_grams(texts: DataFrame) -> DataFrame:
    """texto with its numbered grams, rarest first: an array of the grams' ranks."""
    places = F.sequence(F.lit(1), F.length("texto") - (Q - 1))
    pieces = F.transform(places, lambda i: F.substring(F.col("texto"), i, F.lit(Q)))
    counted = texts.where(F.length("texto") >= Q).select("texto", F.explode(pieces).alias("piece"))
    counted = counted.groupBy("texto", "piece").agg(F.count("*").alias("times"))
    each = F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda i: F.concat("piece", i.cast("string")))
    grams = written(counted.select("texto", F.explode(each).alias("gram")))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    # Numbers follow the sort, so they compare as (n, gram) does; rows carry them instead of the texts.
    ranks = written(often.orderBy("n", "gram").select("gram", F.monotonically_increasing_id().alias("rank")))
    # A text of n letters has n - 1 of them, whatever the number of texts.
    return grams.join(ranks, "gram").groupBy("texto").agg(F.sort_array(F.collect_list("rank")).alias("grams"))


def similar_pairs(classes: DataFrame, percent: int = 85, hot: int = HOT) -> DataFrame:
    """a, b, distancia of the linked classes, each pair once with a < b."""
    _check(percent)
    # One text in neighbouring bands.
    key = ["ccaa", "year", "texto"]
    low = classes.select(*key, F.col("clase").alias("x"), (F.col("tramo") + 1).alias("tramo"))
    same = low.join(classes.select(*key, F.col("clase").alias("y"), "tramo"), [*key, "tramo"])
    same = same.select("x", "y", F.lit(0).alias("distancia"))

    ordered = written(_ordered_grams(classes.select("texto").distinct()))
    edits = _edits(F.length("texto"), percent)
    # A text that allows no edit is like no other text.
    placed = classes.drop("clase", "registros").join(ordered, "texto").where(edits > 0)
    placed = placed.withColumn("grams", F.slice("grams", F.lit(1), Q * edits + 2))
    single = placed.select("*", F.posexplode("grams").alias("at", "gram")).where(F.col("at") <= Q * edits)
    single = written(single)
    # What a class meets: its own band, and as the lower one of two the next band.
    met = single.groupBy("ccaa", "year", F.col("tramo").alias("band"), "gram").agg(F.count("*").alias("n"))
    both = met.unionByName(met.withColumn("band", F.col("band") + 1)).groupBy("ccaa", "year", "band", "gram")
    crowded = written(both.agg(F.sum("n").alias("n")).where(F.col("n") > hot).drop("n").withColumn("crowded", F.lit(True)))

    none = F.lit(-1).cast("bigint")

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        """Rows under their gram, and under pairs of grams where that is crowded."""
        marked = rows.join(crowded, ["ccaa", "year", "band", "gram"], "left")
        later = F.when(F.col("crowded"), F.slice("grams", F.col("at") + 2, F.size("grams"))).otherwise(F.array(none))
        return marked.select(
            "ccaa", "year", "band", "gram", F.explode(later).alias("second"),
            *[F.col(c).alias(f"{side}_{c}") for c in ("texto", "grams", "tramo")],
        )

    upper = keyed(single.withColumn("band", F.col("tramo")), "x")
    lower = keyed(single.withColumn("band", F.explode(F.array(F.col("tramo"), F.col("tramo") + 1))), "y")
    shared = F.array_intersect("x_grams", "y_grams")
    longest = F.greatest(F.length("x_texto"), F.length("y_texto"))
    shortest = F.least(F.length("x_texto"), F.length("y_texto"))
    once = (F.col("x_tramo") > F.col("y_tramo")) | (F.col("x_texto") < F.col("y_texto"))
    found = upper.join(lower, ["ccaa", "year", "band", "gram", "second"]).where(
        once & (F.col("x_texto") != F.col("y_texto")) & (longest * percent <= shortest * 100)
        & (shared[0] == F.col("gram")) & ((F.col("second") == none) | (F.get(shared, F.lit(1)) == F.col("second")))
    )
    allowed = F.floor(longest * (100 - percent) / 100).cast("int")
    found = found.withColumn("distancia", F.levenshtein("x_texto", "y_texto")).where(F.col("distancia") <= allowed)
    # Long names are made of the links alone; candidates carry none.
    names = [class_name(f"{side}_tramo", f"{side}_texto").alias(side) for side in ("x", "y")]
    pairs = same.unionByName(found.select(*names, "distancia"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distancia")


def similar_groups(contracts: DataFrame, percent: int = 85, hot: int = HOT) -> DataFrame:
    """All contracts with clase, n_enlaces (records that theirs is linked with) and grupo_difuso.

    A group holds all classes that links lead to, and is named by the smallest. Contracts without
    region, year, positive amount or subject have none of the three.
    """
    classes = written(subject_classes(contracts))
    pairs = written(similar_pairs(classes, percent, hot))
    sizes = classes.select(F.col("clase").alias("b"), "registros")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(sizes, "b").groupBy(F.col("a").alias("clase")).agg(F.sum("registros").alias("near"))
    groups = linked_groups(pairs.select("a", "b")).toDF("clase", "grupo_difuso")
    decided = written(
        classes.join(near, "clase", "left").join(groups, "clase", "left").select(
            "ccaa", "year", "tramo", "texto", "clase",
            (F.coalesce("near", F.lit(0)) + F.col("registros") - 1).alias("n_enlaces"),
            F.coalesce("grupo_difuso", "clase").alias("grupo_difuso"),
        )
    )
    rows = contracts.withColumns({"tramo": amount_band(F.col("importe")), "texto": folded_subject(F.col("objeto"))})
    return rows.join(decided, ["ccaa", "year", "tramo", "texto"], "left").select(
        *contracts.columns, "clase", "n_enlaces", "grupo_difuso"
    )
