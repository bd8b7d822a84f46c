"""Sets of row numbers as bits, and rows marked by them without being moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK, _WORD = 1 << 15, 64  # numbers in a block, and in one of its words


def bit_blocks(numbers: DataFrame, number: str) -> DataFrame:
    """A set of numbers from zero on as one row for each block that has any: its words, a bit for each number."""
    n = F.col(number)
    words = numbers.groupBy(
        F.expr(f"{number} div {_BLOCK}").alias("block"), (n % _BLOCK / _WORD).cast("int").alias("word")
    ).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (n % _WORD).cast("int"))).alias("bits"))
    blocks = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    every = F.sequence(F.lit(0), F.lit(_BLOCK // _WORD - 1))
    return blocks.select("block", F.transform(every, lambda i: F.coalesce(F.col("words")[i], F.lit(0).cast("bigint"))).alias("words"))


def marked(rows: DataFrame, blocks: DataFrame, number: str, name: str) -> DataFrame:
    """Rows with whether their number is in the set. It takes a bit for each row, so that every task can hold it."""
    n = F.col(number)
    word = F.get("words", (n % _BLOCK / _WORD).cast("int"))
    isin = F.coalesce(F.getbit(word, (n % _WORD).cast("int")) == 1, F.lit(False))
    found = rows.join(F.broadcast(blocks), F.expr(f"{number} div {_BLOCK}") == F.col("block"), "left")
    return found.select(*rows.columns, isin.alias(name))
