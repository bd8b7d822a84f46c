"""Benchmark decontamination by a prefix-filtered join of item windows with document words.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of any character beyond ASCII. An
item's windows are its runs of ``window`` words; an item of fewer words is one window. To contain a
window means to hold every word of it, so by the prefix rule for containment its single rarest word
is a sufficient prefix: a document without that word cannot match. Rarity is the number of times a
word occurs in all documents, counted in a pass of its own. A document word that is some window's
prefix proposes one place for it; the window's length and the prefix's position in it must fit
between the document's ends; then all its words are compared, first by hash and then as text.

The benchmark is a stated query set. It is cut into blocks of at most ``BLOCK`` windows, and each
block is broadcast in its turn, so the broadcast is bounded whatever the benchmark's size; documents
are never shuffled.

Defined cases: null and empty texts and texts without words have no words and no hits; such items
have no windows. Repeated documents each get their row; repeated items, and null item ids, are
handled as items of their own (a null id is left out of the listed ids but counted). Other columns
are not read, or pass through where documents are filtered.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm import words as W
from tenderlake.llm.ordered import indexed
from tenderlake.llm.storage import packed, stored, unpacked

BLOCK = 50_000  # windows in one broadcast block

_WINDOW = "item_no long, item_id string, at int, hashes array<long>, text array<string>"


def _as_text(data: np.ndarray, start: int, end: int) -> str:
    return W.FOLD[data[start:end]].tobytes().decode("utf-8", "replace")


def _windows(width: int):
    def run(batches):
        for batch in batches:
            out = {"item_no": [], "item_id": [], "at": [], "hashes": [], "text": []}
            numbers, names = batch.column("item_no").to_pylist(), batch.column("item_id").to_pylist()
            for number, name, data in zip(numbers, names, W.texts(batch.column("text"))):
                if data is None:
                    continue
                starts, ends, hashes = W.words(data, W.ALPHANUMERIC)
                size = min(width, len(hashes))
                for at in range(len(hashes) - size + 1 if size else 0):
                    out["item_no"].append(number)
                    out["item_id"].append(name)
                    out["at"].append(at)
                    out["hashes"].append(hashes[at : at + size].view(np.int64))
                    out["text"].append([_as_text(data, starts[k], ends[k]) for k in range(at, at + size)])
            yield pa.RecordBatch.from_pydict(
                out,
                schema=pa.schema(
                    [
                        ("item_no", pa.int64()),
                        ("item_id", pa.string()),
                        ("at", pa.int32()),
                        ("hashes", pa.list_(pa.int64())),
                        ("text", pa.list_(pa.string())),
                    ]
                ),
            )

    return run


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """The windows of all items, numbered, stored."""
    items = indexed(
        benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")), ["item_id", "text"]
    ).withColumnRenamed("row_index", "item_no")
    found = items.mapInArrow(_windows(window), _WINDOW)
    return stored(indexed(found, ["item_no", "at"]).withColumnRenamed("row_index", "window_no"))


def _count_words(vocabulary):
    """Occurrences of the vocabulary's words, one row a word and batch."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            total = np.zeros(len(known) + 1, dtype=np.int64)
            for data in W.texts(batch.column("text")):
                if data is None:
                    continue
                hashes = W.words(data, W.ALPHANUMERIC)[2].view(np.int64)
                place = np.searchsorted(known, hashes)
                hit = known[np.minimum(place, len(known) - 1)] == hashes
                total += np.bincount(place[hit], minlength=len(known) + 1)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known[used], pa.int64()), pa.array(total[used], pa.int64())], names=["word", "n"]
            )

    return run


class _Block:
    """Windows by their rarest word; what one pass over the documents compares with."""

    def __init__(self, rows, counts: dict[int, int]):
        self.prefixes = defaultdict(list)
        for r in rows:
            hashes = np.array(r["hashes"], dtype=np.int64)
            offset = min(range(len(hashes)), key=lambda k: (counts.get(int(hashes[k]), 0), int(hashes[k]), k))
            self.prefixes[int(hashes[offset])].append((offset, hashes, r["text"], r["item_no"], r["item_id"]))
        self.words = np.array(sorted(self.prefixes), dtype=np.int64)


def _match(block: _Block, data, starts, ends, hashes) -> list[tuple]:
    """(first word, number of words, item number, item id) of every occurrence of a window."""
    if not len(hashes) or not len(block.words):
        return []
    place = np.searchsorted(block.words, hashes)
    place[place == len(block.words)] = 0
    found = []
    for at in np.flatnonzero(block.words[place] == hashes).tolist():
        for offset, window, text, number, name in block.prefixes[int(hashes[at])]:
            first = at - offset
            if first < 0 or first + len(window) > len(hashes):
                continue
            if not np.array_equal(hashes[first : first + len(window)], window):
                continue
            if all(_as_text(data, starts[first + k], ends[first + k]) == text[k] for k in range(len(window))):
                found.append((first, len(window), number, name))
    return found


_SPAN = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("item_no", pa.int64()), ("item_id", pa.string())])
_SPANS = "spans array<struct<first:int,words:int,item_no:bigint,item_id:string>>"


def _find(block):
    """Adds the block's occurrences to ``spans``; the other columns pass through."""

    def run(batches):
        for batch in batches:
            counts, spans = [], []
            earlier = batch.column("spans").to_pylist()
            for data, known in zip(W.texts(batch.column("text")), earlier):
                starts, ends, hashes = W.words(data if data is not None else np.zeros(0, np.uint8), W.ALPHANUMERIC)
                counts.append(len(hashes))
                more = _match(block.value, data, starts, ends, hashes.view(np.int64))
                known = [tuple(s.values()) for s in known or ()]
                spans.append([dict(zip(("first", "words", "item_no", "item_id"), s)) for s in known + more])
            done = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(_SPAN))}
            yield pa.RecordBatch.from_arrays(
                [done.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names
            )

    return run


def occurrences(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """``docs`` (which needs ``text``) with ``n_words`` and ``spans``: each place where a window occurs,
    as first word, number of words, item number and item id. These two names must be free."""
    spark = docs.sparkSession
    windows = item_windows(benchmark, window)
    out = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn(
        "spans", F.lit(None).cast(_SPANS.removeprefix("spans "))
    )
    last = windows.agg(F.max("window_no")).first()[0]
    for low in range(0, (-1 if last is None else last) + 1, BLOCK):
        rows = windows.where(F.col("window_no").between(low, low + BLOCK - 1)).collect()
        vocabulary = np.unique(np.concatenate([np.array(r["hashes"], dtype=np.int64) for r in rows]))
        counted = docs.select("text").mapInArrow(
            _count_words(spark.sparkContext.broadcast(vocabulary)), "word long, n long"
        )
        # At most one row for each word of the block.
        counts = dict(map(tuple, counted.groupBy("word").agg(F.sum("n")).collect()))
        block = spark.sparkContext.broadcast(_Block(rows, counts))
        out = out.mapInArrow(_find(block), out.schema)
    if last is None:
        out = out.mapInArrow(_find(spark.sparkContext.broadcast(_Block([], {}))), out.schema)
    return out


def _digest(batches):
    for batch in batches:
        hit, items, ids = [], [], []
        for spans in batch.column("spans").to_pylist():
            covered = set()
            for s in spans:
                covered.update(range(s["first"], s["first"] + s["words"]))
            hit.append(len(covered))
            items.append(len({s["item_no"] for s in spans}))
            names = sorted({(s["item_no"], s["item_id"]) for s in spans if s["item_id"] is not None}, key=lambda x: x[1])
            ids.append(hashlib.sha256(",".join(name for _, name in names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array(items, pa.int64()),
                pa.array(ids, pa.string()),
                pa.array([n > 0 for n in hit], pa.bool_()),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """One row for each document: how many of its words lie in windows of how many items, and which."""
    found = occurrences(docs.select("doc_id", F.col("text").cast("string")), benchmark, window=window)
    return found.mapInArrow(
        _digest,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, "
        "items_sha256 string, contaminated boolean",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    named = docs.select(packed(docs, leave_out="text"), F.col("text").cast("string"))
    found = occurrences(named, benchmark, window=window)
    return unpacked(found.where(F.size("spans") == 0), docs.columns, apart="text")
