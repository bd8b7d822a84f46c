"""A mix of sources to target weights by a low-discrepancy schedule.

The documents of a source are shuffled by a hash and laid end to end; the words are cut into blocks
of equal length. Slot n of the schedule goes to the source in whose share of the cumulative weights
the golden-ratio point of n falls. The k-th slot of a source takes its k-th block, beginning again
after the last, until the source's target is reached; its last block is cut to meet it. Points fall
short of a source's share by a few slots at most, which follow at the end of the schedule.

Weights are 1, 2, 3, 1, ... by the order of source names, null last. A target stops at ``most`` times
the source's size; what is above it goes to the others by weight. This is solved in closed form over
the sources in the order in which they reach their limit.

Only DataFrame functions touch rows, and no task sees a whole source. Defined cases: null texts and
texts without words have size 0 and are not taken; a source without words has target 0; null is a
source of its own. Repeated rows are documents of their own. If no source has words, nothing is
taken. Other columns are not read, or pass through in ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.ordered import indexed
from tenderlake.llm.storage import packed, stored, unpacked

BLOCK_WORDS = 1024
MOST = 3  # times its size that a source gives at most
_POINTS = 1 << 31
_GOLDEN = 1_327_217_885  # odd, next to _POINTS divided by the golden ratio
_CELLS = 4096  # parts of the cumulative weights, for looking sources up by equality
_CHUNK = 1 << 16  # slots that are ranked together


@dataclass(frozen=True)
class Mix:
    documents: DataFrame  # doc_id, text_key, source_no, size, row_index, start (in its source)
    sources: DataFrame  # source, source_no, weight, size, target, goal, blocks, slots
    schedule: DataFrame  # slot, source_no, turn, block, words
    pieces: DataFrame  # slot, turn, row_index, at (word of the document), words


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _div(a: str, b: str) -> Column:
    return F.expr(f"coalesce(try_divide({a}, {b}), 0)")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size) with weight and target in words; one row for each source."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    limited = sizes.withColumn("source_no", F.row_number().over(by_name) - 1).select(
        "*",
        (F.col("source_no") % 3 + 1).cast("double").alias("weight"),
        (F.col("size") * most).cast("double").alias("limit"),
    )
    every = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    stepped = limited.select(
        "*",
        F.sum("size").over(whole).cast("double").alias("all"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("limits_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weights_before"),
    ).withColumn(
        "full",
        F.col("limit") * (F.col("weights") - F.col("weights_before"))
        <= F.col("weight") * (F.col("all") - F.col("limits_before")),
    )
    left = stepped.select(
        "*",
        (F.col("all") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(whole)).alias("rest"),
        F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole).alias("rest_weight"),
    )
    share = F.col("weight") * _div("rest", "rest_weight")
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", share))
    return left.select("source", "source_no", "weight", "size", target.alias("target"))


def _schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """Slots in order, with the source, the source's turn, the block and how many of its words."""
    spark = sources.sparkSession
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    shares = sources.select(
        "source_no", "slots", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("low")
    ).where("slots > 0")
    total = int(sources.agg(F.sum("slots")).first()[0] or 0)
    cell = lambda edge: F.least(F.floor(F.col(edge) * F.lit(_CELLS) / F.lit(max(total, 1))), F.lit(_CELLS - 1))
    shares = shares.withColumn("high", F.col("low") + F.col("slots"))
    cells = shares.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))

    point = (F.col("slot") % _POINTS * _GOLDEN % _POINTS).cast("double") / _POINTS
    drawn = (
        spark.range(total)
        .withColumnRenamed("id", "slot")
        .withColumn("point", point)
        .withColumn("cell", F.least(F.floor(F.col("point") * _CELLS), F.lit(_CELLS - 1)))
        .join(cells, "cell")
        .where(F.floor(F.col("point") * F.lit(total)).between(F.col("low"), F.col("high") - 1))
        .select("slot", "source_no", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    )
    drawn = stored(drawn)
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    counts = counts.withColumn("turns_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    in_chunk = Window.partitionBy("source_no", "chunk").orderBy("slot")
    turns = drawn.withColumn("in_chunk", F.row_number().over(in_chunk) - 1).join(counts, ["source_no", "chunk"])
    turns = turns.select("slot", "source_no", (F.col("turns_before") + F.col("in_chunk")).alias("turn"))

    # The few slots by which points fell short of a share, source after source in each round.
    got = drawn.groupBy("source_no").agg(F.count("*").alias("got"))
    short = sources.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    tail = short.select(
        "source_no", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("turn"), "got"
    ).select((total + (F.col("turn") - F.col("got")) * (1 << 20) + F.col("source_no")).alias("slot"), "source_no", "turn")

    own = sources.select("source_no", "slots", "blocks", F.col("size").alias("source_size"), "goal")
    out = turns.unionByName(tail).join(own, "source_no").where("turn < slots")
    block = F.col("turn") % F.col("blocks")
    taken_before = F.expr("turn div blocks") * F.col("source_size") + block * block_words
    length = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    return out.select(
        "slot", "source_no", "turn", block.alias("block"), F.least(length, F.col("goal") - taken_before).alias("words")
    )


def mix(docs: DataFrame, *, block_words: int = BLOCK_WORDS, most: int = MOST) -> Mix:
    """Plan the mix of all ``docs``."""
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("text_key"),
        word_count("text").alias("size"),
    )
    shuffled = F.xxhash64("doc_id", "text_key", F.lit(11))
    placed = stored(indexed(sized, [F.asc_nulls_last("source"), shuffled, "doc_id", "text_key"], "size"))
    found = placed.groupBy("source").agg(F.sum("size").alias("size"), F.min("row_start").alias("source_start"))
    starts = found.select("source", "source_start")
    planned = targets(found.select("source", "size"), most)
    planned = planned.join(starts, planned["source"].eqNullSafe(starts["source"])).drop(starts["source"])
    rest = "goal - goal div greatest(size, 1) * size"
    sources = stored(
        planned.withColumn("goal", F.round("target").cast("long"))
        .withColumn("blocks", F.expr(f"(size + {block_words - 1}) div {block_words}"))
        .withColumn(
            "slots",
            F.expr(f"goal div greatest(size, 1) * blocks + ({rest} + {block_words - 1}) div {block_words}"),
        )
    )
    numbers = sources.select(F.col("source").alias("name"), "source_no", "source_start")
    documents = placed.join(numbers, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "text_key", "source_no", "size", "row_index", (F.col("row_start") - F.col("source_start")).alias("start")
    )
    schedule = _schedule(sources, block_words)
    end = F.col("start") + F.col("size")
    in_blocks = (
        documents.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))))
        .select(
            "source_no",
            "block",
            "row_index",
            "start",
            F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)).alias("low"),
            F.least(end - F.col("block") * block_words, F.lit(block_words)).alias("high"),
        )
    )
    pieces = (
        schedule.join(in_blocks, ["source_no", "block"])
        .withColumn("words", F.least("words", "high") - F.col("low"))
        .where("words > 0")
        .select(
            "slot", "turn", "row_index", (F.col("block") * block_words + F.col("low") - F.col("start")).alias("at"), "words"
        )
    )
    return Mix(documents, sources, schedule, pieces)


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, text_key, size, source_size, target and taken (words)."""
    plan = mix(docs, **options)
    words = plan.pieces.groupBy("row_index").agg(F.sum("words").alias("taken"))
    own = plan.sources.select("source_no", F.col("size").alias("source_size"), "target")
    return (
        plan.documents.join(words, "row_index", "left")
        .join(own, "source_no")
        .select(
            "doc_id", "text_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, rounded to whole documents."""
    copies = F.round(F.expr("try_divide(taken, size)")).cast("int")
    decided = (
        taken(docs, **options)
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.coalesce(F.sum(copies), F.lit(0)).alias("_copies"), F.count("*").alias("_rows"))
        .where("_copies > 0")
    )
    keyed = docs.select(packed(docs), "doc_id", F.xxhash64("text").alias("text_key"))
    found = keyed.join(decided, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
    # Repeated rows share what their document got.
    rank = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_id")) - 1
    share = F.expr("_copies div _rows") + (F.col("_rank") < F.col("_copies") % F.col("_rows")).cast("int")
    single = found.where("_rows = 1")
    repeated = found.where("_rows > 1").withColumn("_rank", rank).withColumn("_copies", share).drop("_rank")
    every = single.unionByName(repeated).where("_copies > 0")
    return unpacked(every.withColumn("_copy", F.explode(F.expr("sequence(1, int(_copies))"))), docs.columns)
