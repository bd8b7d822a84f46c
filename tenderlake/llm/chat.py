"""Conversations from messages that quote each other.

A message's lines have a quote level (the number of > at their start). Runs of lines of one level,
cut at blank lines, are passages; a passage is normalised to its words and hashed, and so is each of
its lines of at least ``LEAST_WORDS`` words. A quoted hash is joined to the message of the same
conversation that has it unquoted first, if that is an earlier turn. A message answers the latest
original among its least nested linked quotes, or else simply follows the turn before.

Reply order is depth-first: after a message comes the one that follows it, and the whole of what
answers that; then the messages that quote it, by turn. So a run of plain turns stays together, and
runs that quote are hung below the quoted message. A run's place is the chain of the runs above it;
chains are completed by doubling, so the number of rounds is the logarithm of their depth. Positions
come from one global order, and no task sees a whole conversation.

Defined cases: null and empty texts are messages without passages. Rows that repeat a turn are kept,
next to each other. Messages without a conversation or turn are ordered with null first and link to
nothing. Original quotes that are not found leave the message where it is; quoted lines and the line
that introduces them are taken out of the text either way. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.ordered import indexed
from tenderlake.llm.storage import stored

LEAST_WORDS = 3

_MARK = re.compile(r"^((?:[ \t]*>)+)[ \t]?")
# How mail programs introduce a quotation, in the languages of the data.
_INTRODUCES = re.compile(r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)\b[^\n]{0,80}:\s*$")
_WORDS = re.compile(r"\w+")

_PARSED = (
    "conv_id long, turn long, role string, text_key long, text string, n_quotes int, "
    "own array<string>, quoted array<struct<level:int,hash:string>>"
)


def split_levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line."""
    out = []
    for line in text.split("\n"):
        mark = _MARK.match(line)
        out.append((mark[1].count(">"), line[mark.end() :]) if mark else (0, line))
    return out


def _hash(text: str) -> str | None:
    found = _WORDS.findall(text.lower())
    return hashlib.sha256(" ".join(found).encode()).hexdigest()[:32] if found else None


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(level, hash) of every passage, and of its longer lines, in order and without repeats."""
    out: list[tuple[int, str]] = []
    run: list[str] = []

    def close(level: int) -> None:
        if run:
            for part in (" ".join(run), *(x for x in run if len(_WORDS.findall(x)) >= LEAST_WORDS)):
                found = _hash(part)
                if found and (level, found) not in seen:
                    seen.add((level, found))
                    out.append((level, found))
            run.clear()

    seen: set[tuple[int, str]] = set()
    before = 0
    for level, line in lines:
        if level != before or not line.strip():
            close(before)
        if line.strip():
            run.append(line)
        before = level
    close(before)
    return out


def without_quotes(lines: list[tuple[int, str]]) -> str:
    """The lines of level 0, without those that introduce a quotation."""
    kept = []
    for k, (level, line) in enumerate(lines):
        introduces = k + 1 < len(lines) and lines[k + 1][0] > 0 and _INTRODUCES.search(line)
        if level == 0 and not introduces:
            kept.append(line)
    return "\n".join(kept).strip("\n")


def _parse(batches):
    for rows in batches:
        parsed = []
        for text in rows["text"]:
            lines = split_levels(text) if isinstance(text, str) else []
            found = passages(lines)
            quoted = [(level, h) for level, h in found if level]
            plain = without_quotes(lines) if any(level for level, _ in lines) else text
            parsed.append((plain, len(quoted), [h for level, h in found if not level], quoted))
        new = pd.DataFrame(parsed, columns=["text", "n_quotes", "own", "quoted"], index=rows.index)
        yield pd.concat([rows[["conv_id", "turn", "role", "text_key"]], new], axis=1)


def _parents(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked) of the messages with a linked quote."""
    originals = (
        parsed.select("conv_id", "turn", F.explode("own").alias("hash"))
        .groupBy("conv_id", "hash")
        .agg(F.min("turn").alias("original"))
    )
    quotes = parsed.select("conv_id", "turn", F.explode("quoted").alias("quote"))
    quotes = quotes.select("conv_id", "turn", "quote.level", "quote.hash")
    linked = quotes.join(originals, ["conv_id", "hash"]).where("original < turn")
    return linked.groupBy("conv_id", "turn").agg(
        F.min(F.struct("level", (-F.col("original")).alias("latest"))).alias("best"),
        F.countDistinct("hash").alias("n_linked"),
    ).select("conv_id", "turn", (-F.col("best.latest")).alias("parent_turn"), "n_linked")


def _chains(runs: DataFrame) -> DataFrame:
    """(run, chain): for each run the sort keys of the runs above it and of itself."""
    runs = stored(runs)
    while runs.where("above is not null").limit(1).count():
        upper = runs.select(
            F.col("run").alias("above"), F.col("chain").alias("upper_chain"), F.col("above").alias("further")
        )
        runs = runs.join(upper, "above", "left").select(
            "run",
            F.col("further").alias("above"),
            F.when(F.col("upper_chain").isNull(), F.col("chain")).otherwise(F.concat("upper_chain", "chain")).alias("chain"),
        )
        runs = stored(runs)
    return runs.select("run", "chain")


def conversations(messages: DataFrame) -> DataFrame:
    """One row for each message: conv_id, position (0-based, in reply order), turn, role, text without
    quotes, parent_turn (of the quoted original, else of the turn before, null for a first turn),
    n_quotes and n_linked (quoted passages, and how many were found)."""
    text = F.col("text").cast("string").alias("text")
    parsed = messages.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), text, F.xxhash64("text").alias("text_key")
    ).mapInPandas(_parse, _PARSED)
    parsed = stored(parsed)
    first = parsed.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    headed = (
        parsed.drop("own", "quoted")
        .join(stored(_parents(parsed)), ["conv_id", "turn"], "left")
        .join(first.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        .drop("_conv")
        .withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))
    )
    starts = F.col("parent_turn").isNotNull() | F.col("turn").eqNullSafe(F.col("first_turn"))
    # A run starts once, even if rows repeat its first turn: only the first of them counts.
    order = ["conv_id", "turn", "role", "text_key"]
    placed = stored(indexed(headed, order))
    leads = placed.groupBy("conv_id", "turn").agg(F.min("row_index").alias("lead"))
    leads = leads.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "lead")
    placed = placed.join(
        leads, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
    ).drop("_conv", "_turn")
    heads = (starts & (F.col("row_index") == F.col("lead"))).cast("long")
    placed = stored(indexed(placed.withColumn("head", heads).withColumnRenamed("row_index", "row"), ["row"], "head"))
    placed = placed.withColumn("run", F.col("row_start") + F.col("head")).drop("row_start", "row_index")

    lead = placed.where("head = 1").select("conv_id", "turn", "run", "parent_turn")
    original = placed.where("row = lead").select(
        "conv_id", F.col("turn").alias("parent_turn"), F.col("run").alias("above")
    )
    key = F.struct(F.coalesce(-F.col("parent_turn"), F.lit(0)).alias("place"), F.coalesce("turn", F.lit(0)).alias("turn"))
    runs = lead.join(original, ["conv_id", "parent_turn"], "left").select("run", "above", F.array(key).alias("chain"))
    placed = placed.join(_chains(runs), "run", "left")
    ordered = stored(indexed(placed, ["conv_id", "chain", "turn", "row"]))
    begins = ordered.groupBy("conv_id").agg(F.min("row_index").alias("begin")).withColumnRenamed("conv_id", "_conv")
    before = F.when(F.col("turn").eqNullSafe(F.col("first_turn")), None).otherwise(F.col("turn") - 1)
    return ordered.join(begins, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id",
        (F.col("row_index") - F.col("begin")).alias("position"),
        "turn",
        "role",
        "text",
        F.coalesce("parent_turn", before).alias("parent_turn"),
        "n_quotes",
        F.col("n_linked").cast("int").alias("n_linked"),
    )
