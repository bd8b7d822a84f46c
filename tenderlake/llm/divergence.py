"""Source divergence audit: how far the words of each source are from those of others of its language.

Terms are runs of ASCII letters (A-Z lower-cased) and of any character beyond ASCII; texts are cut
into them once, with numpy on whole Arrow buffers, and stored by language, with a blank between terms.
A language keeps the terms that occur in at least ``LEAST_DOCUMENTS`` of its documents: a Spark ML
``CountVectorizer`` for each language with that minDF turns each document into an exact sparse vector.
It is fitted to combined documents: those a task reads are reduced to fewer, in which a term of k
documents occurs min(k, ``LEAST_DOCUMENTS``) times, so that minDF keeps the same terms. The vectors' entries are
summed for each source and term, combined before the shuffle as a Summarizer does, but sparse: a
Summarizer's buffers are as wide as the vocabulary.

A fitted CountVectorizer passes its vocabulary through the driver and broadcasts it. So it is used
in up to ``LANGUAGES`` languages with ``VOCABULARY`` kept terms in all: its vocabSize is the largest
integer, but for this bound plus one, so that no fit brings more than that to the driver; if a
vocabulary comes back full, it is not used. Then the same counts come from exploded terms joined to
a stored vocabulary. This switches the plan only; results are equal and nothing is left out on
either side.

A probability is ``1 + floor(SCALE * (count + 1) / (N + V))``; a divergence is the sum over terms of
``floor((p - q)^2 / q)``. Terms are numbered in their order and dealt by hash into blocks of about
``TERMS``, sources of a language are numbered and cut into blocks of ``SOURCES``. One task takes two blocks of sources over one block of
terms, as two small matrices, and gives one partial sum for each ordered pair. Terms that none of
its sources has cost nothing: they are all alike and added as a number. No task sees a whole
language, and a source or term that is everywhere is one row or one column of such a matrix. The
result has every ordered pair of a language's sources, as asked for; copies of documents count.

Defined cases: a null text, language or source is ''. A language without kept terms gives pairs of
value 0. Repeated rows count as documents of their own. An empty table gives no rows. Other columns
are not read. Exact up to 9e15 words in a source.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.ordered import indexed
from tenderlake.llm.storage import stored
from tenderlake.session import shared_folder

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
VOCABULARY = 1 << 20  # kept terms up to which CountVectorizer may hold them
LANGUAGES = 16  # one pass over the documents for each
SOURCES = 256
TERMS = 2048
PIECE = 2 << 20  # bytes of text cut at a time
HELD = 1 << 20  # terms of pieces, about which are combined at a time
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Bytes as they count: A-Z lower-cased, whatever separates terms a blank. Bytes beyond ASCII stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[: 0x41] = _FOLD[0x5B : 0x61] = _FOLD[0x7B : 0x80] = 32
_FOLD[0x41 : 0x5B] += 32

_PARTIAL = "no long, other long, value long, seen long"


def _cut(texts: pa.Array) -> pa.ListArray:
    """The terms of each text, by byte: all terms of a batch are one buffer without what lies between."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b"", dtype=np.uint8)
    offsets = offsets - offsets[0]
    data = _FOLD[data]
    inside = data != 32
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    limits = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(data[inside])]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets), type=pa.int32()), words.cast(pa.string()))


def _frequencies(langs: pa.Array, lists: pa.ListArray) -> pa.Table:
    """In how many of these documents of each language a term is."""
    coded, tongue = lists.values.dictionary_encode(), langs.dictionary_encode()
    names, size = coded.dictionary, max(len(coded.dictionary), 1)
    row = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(lists.offsets.to_numpy()))
    once = np.sort(row * size + coded.indices.to_numpy())  # several times faster than by a hash table
    once = once[np.diff(once, prepend=-1) > 0]
    of_row = tongue.indices.to_numpy().astype(np.int64)
    found, docs = np.unique(of_row[once // size] * size + once % size, return_counts=True)
    columns = [tongue.dictionary.take(pa.array(found // size)), names.take(pa.array(found % size)), pa.array(docs)]
    return pa.table(columns, names=["lang", "name", "docs"])


def _combined(parts: list[pa.Table], least: int) -> tuple[pa.Array, pa.ListArray]:
    """Languages and terms of fewer documents that keep the same terms: one that is in k documents of a
    language is in the first min(k, ``least``) of these, so sums over tasks reach ``least`` alike."""
    total = pa.concat_tables(parts)
    coded, tongue = (pa.concat_arrays(total[c].chunks).dictionary_encode() for c in ("name", "lang"))
    names, size = coded.dictionary, max(len(coded.dictionary), 1)
    key = tongue.indices.to_numpy().astype(np.int64) * size + coded.indices.to_numpy()
    found, at = np.unique(key, return_inverse=True)
    docs = np.zeros(len(found), dtype=np.int64)
    np.add.at(docs, at, total["docs"].to_numpy())
    held, starts, chosen = [], [0], []
    for copy in range(max(least, 1)):
        found, docs = found[docs > copy], docs[docs > copy]
        if not len(found):
            break
        edges = np.searchsorted(found, size * np.arange(len(tongue.dictionary) + 1))
        some = np.flatnonzero(np.diff(edges))
        held.extend(some)
        starts.extend(starts[-1] + edges[some + 1])
        chosen.append(found % size)
    words = names.take(pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *chosen])))
    lists = pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), words)
    return tongue.dictionary.take(pa.array(held, type=pa.int64())), lists


def _rows(langs: pa.Array, sources: pa.Array, lists: pa.ListArray, combined: bool) -> pa.RecordBatch:
    columns = [langs, sources, pc.binary_join(lists, " "), pa.repeat(combined, len(lists))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "words", "combined"])


def _terms(batches: Iterator[pa.RecordBatch], least: int | None) -> Iterator[pa.RecordBatch]:
    """In pieces of a few megabytes of text, as the work takes several times their size; with ``least``
    also the combined documents of the pieces."""
    parts: list[pa.Table] = []
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes) // PIECE
        edges = np.flatnonzero(piece[1:] != piece[:-1]) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows]):
            part = batch.slice(start, end - start)
            lists = _cut(part.column("text"))
            yield _rows(part.column("lang"), part.column("source"), lists, False)
            if least is None:
                continue
            parts.append(_frequencies(part.column("lang"), lists))
            if sum(len(p) for p in parts) > HELD:
                langs, lists = _combined(parts, least)
                parts = []
                yield _rows(langs, pa.repeat("", len(langs)), lists, True)
    if parts:
        langs, lists = _combined(parts, least)
        yield _rows(langs, pa.repeat("", len(langs)), lists, True)


def _listed() -> Column:
    """The terms of ``words``, where one blank is between two of them."""
    return F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " "))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), by long division in steps of a thousand."""
    rest, out = np.asarray(count, dtype=np.int64), np.zeros(np.broadcast(count, total).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _share(count: Column, total: Column) -> Column:
    """The same as a column; ``div`` of longs is exact."""
    rest, out = count.cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = (rest * 1000) % total
    return out + 1


def _vocabulary(own: DataFrame, least: int, bound: int) -> CountVectorizerModel | None:
    """Fitted to one language's documents, given or combined; None if no term is kept."""
    size = min(2**31 - 1, bound + 1)
    try:
        return CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least), vocabSize=size).fit(own)
    except IllegalArgumentException as problem:
        if "vocabulary size should be > 0" not in str(problem):
            raise
        return None


def _by_vectors(
    docs: DataFrame, sources: DataFrame, langs: list[str], least: int
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Counts, names of terms and sizes from count vectors; None beyond the bound for vocabularies, and
    should two sources of a language share their key."""
    spark, left = docs.sparkSession, VOCABULARY
    sources = sources.withColumn("source_key", F.xxhash64("source"))
    if sources.groupBy("lang", "source_key").count().where("count > 1").limit(1).count():
        return None
    docs = docs.select("part", F.xxhash64("source").alias("source_key"), _listed().alias("terms"))
    parts, names, sizes = [], [], []
    for number, lang in enumerate(langs):
        own = docs.where(F.col("part") == number)
        model = _vocabulary(docs.where(F.col("part") == -1 - number), least, left)
        if model is None:
            continue
        # Read from the saved model, so that the names do not pass through the driver's Python.
        path = f"{shared_folder(spark).rstrip('/')}/vocabulary-{uuid.uuid4().hex}"
        model.write().save(path)
        vocabulary = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("i", "name"))
        # Numbers go on from language to language, so that a term's number says its language too.
        term = (F.col("row_index") + (VOCABULARY - left)).alias("term")
        named = stored(indexed(vocabulary, ["name"]).select("i", "name", term))
        size = named.count()
        left -= size
        if left < 0:
            return None
        places = named.select("i", "term")  # at most VOCABULARY pairs of numbers
        vector = F.unwrap_udt("vector")
        vectors = model.transform(own).select("source_key", vector["indices"].alias("places"), vector["values"].alias("n"))
        # Places are exploded alone and the counts looked up, which makes no struct for each entry. The outer
        # form has no inferred filter, which would be pushed below the vectors and make each of them three times;
        # the place it gives to an empty vector is null and meets none below.
        entries = vectors.select("source_key", "n", F.posexplode_outer("places").alias("at", "i"))
        entries = entries.select("source_key", "i", F.get("n", F.col("at")).alias("n"))
        # Keys of numbers only are summed several times faster than with a text among them.
        sums = entries.groupBy("source_key", "i").agg(F.sum("n").cast("long").alias("n"))
        sums = sums.join(sources.where(F.col("lang") == lang).select("no", "source_key"), "source_key")
        # Stored language by language, so that the driver holds one vocabulary at a time.
        parts.append(stored(sums.join(F.broadcast(places), "i").select("no", "term", "n")))
        names.append(named.select("term", "name"))
        sizes.append((lang, size))
        # A model's broadcast ends with the model itself, so let it go before the next one is fitted.
        del model
        gc.collect()
        spark._jvm.System.gc()
    parts = parts or [spark.createDataFrame([], "no long, term long, n long")]
    names = names or [spark.createDataFrame([], "term long, name string")]
    return (
        reduce(DataFrame.unionByName, parts),
        reduce(DataFrame.unionByName, names),
        spark.createDataFrame(sizes, "lang string, terms long"),
    )


def _by_join(docs: DataFrame, sources: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from exploded terms and a stored vocabulary."""
    in_docs = docs.select("lang", F.explode(F.array_distinct(_listed())).alias("name"))
    kept = in_docs.groupBy("lang", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    placed = stored(indexed(kept, ["lang", "name"]).withColumnRenamed("row_index", "term"))
    sizes = stored(placed.groupBy("lang").agg(F.count("*").alias("terms")))
    words = docs.select("lang", "source", F.explode(_listed()).alias("name"))
    counts = words.groupBy("lang", "source", "name").agg(F.count("*").alias("n")).join(placed, ["lang", "name"])
    counts = counts.join(sources, ["lang", "source"])
    return stored(counts.select("no", "term", "n")), placed.select("term", "name"), sizes


def source_counts(
    docs: DataFrame, least: int = LEAST_DOCUMENTS
) -> tuple[bool, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of documents (lang, source, text): whether count vectors could be used, how often each group has each kept term of its language
    (no, term, n), the names of terms (term, name), how many there are (lang, terms), and the occurring
    groups (lang, source, no). Groups and terms are numbered over all languages, terms of each in their order."""
    langs = [r["lang"] for r in docs.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    few = len(langs) <= LANGUAGES
    number = F.coalesce(*[F.when(F.col("lang") == x, F.lit(n)) for n, x in enumerate(langs)]) if few and langs else F.lit(0)
    cut = docs.mapInArrow(
        partial(_terms, least=least if few else None), "lang string, source string, words string, combined boolean"
    )
    part = F.when(F.col("combined"), -1 - number).otherwise(number).alias("part")
    cut = stored(cut.select("lang", "source", "words", part), "part" if few else None, codec="snappy")
    given = cut.where("part >= 0")
    occurring = given.groupBy("lang", "source").agg(F.count("*").alias("docs")).drop("docs")
    occurring = stored(indexed(occurring, ["lang", "source"]).withColumnRenamed("row_index", "no"))
    found = _by_vectors(cut, occurring, langs, least) if few else None
    counts, names, sizes = found or _by_join(given, occurring, least)
    return bool(found), counts, names, sizes, occurring


def _pair_sums(key: tuple, entries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one block of terms for all ordered pairs of two blocks of sources."""
    low, high = key[2], key[3]
    members = members.sort_values("no")
    numbers, totals = members["no"].to_numpy(), members["total"].to_numpy(dtype=np.int64)
    at = np.searchsorted(numbers, entries["no"].to_numpy())
    names, column = np.unique(entries["term"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(numbers), len(names)), dtype=np.int64)
    counts[at, column] = entries["n"].to_numpy(dtype=np.int64)
    p = share(counts + 1, totals[:, None])
    block = members["mine"].to_numpy()
    out = []
    for row in range(len(numbers)):
        others = np.flatnonzero(block == (high if block[row] == low else low))
        others = others[others != row]
        gap = p[row] - p[others]
        out.append((np.full(len(others), numbers[row]), numbers[others], (gap * gap // p[others]).sum(axis=1)))
    no, other, value = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"no": no, "other": other, "value": value, "seen": len(names)})


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """no, lang, source, item, value of every ordered pair of a language's sources."""
    block = F.expr(f"(no - first) div {SOURCES}").cast("int")
    last = F.expr(f"(sources - 1) div {SOURCES}").cast("int")
    partners = F.explode(F.sequence(F.lit(0), last))
    halves = F.expr(f"explode(sequence(0, cast(terms div {TERMS} as int)))")
    # A pair of source blocks is met from both sides, or once by its own two sides.
    meeting = [F.least("mine", "partner").alias("low"), F.greatest("mine", "partner").alias("high")]
    each = groups.withColumn("mine", block).withColumn("partner", partners)
    # Dealt by hash, since neighbouring terms can all be frequent ones.
    number = F.pmod(F.xxhash64("term"), F.expr(f"terms div {TERMS} + 1")).cast("int").alias("block")
    entries = counts.join(groups.select("no", "first", "sources", "terms"), "no")
    entries = entries.withColumn("mine", block).withColumn("partner", partners)
    entries = entries.select("first", number, *meeting, "term", "no", "n")
    members = each.select("first", *meeting, "no", "mine", "total", halves.alias("block"))
    members = members.toDF(*members.columns)  # both sides come from ``groups``
    keys = ["first", "block", "low", "high"]
    sums = (
        entries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(_pair_sums, _PARTIAL)
        .groupBy("no", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    )
    here = groups.select("no", "lang", "source", "terms", F.col("total").alias("m"))
    there = groups.select(F.col("no").alias("other"), F.col("source").alias("item"), F.col("total").alias("k"))
    one = F.lit(1)
    unseen = (F.col("terms") - F.col("seen")) * _divergence(_share(one, F.col("m")), _share(one, F.col("k")))
    value = F.when(F.col("terms") > 0, F.col("value") + unseen).otherwise(0)
    return (
        sums.join(here, "no").join(there, "other")
        .select("no", "lang", "source", "item", value.cast("long").alias("value"))
    )


def _over_terms(groups: DataFrame, counts: DataFrame, bounded: bool) -> DataFrame:
    """no, term, value of terms that a source has more often than its language."""
    own = stored(counts.groupBy("term").agg(F.sum("n").alias("all")))
    # With count vectors there are at most VOCABULARY terms.
    joined = counts.join(F.broadcast(own) if bounded else own, "term").join(groups, "no")
    p, q = _share(F.col("n") + 1, F.col("total")), _share(F.col("all") + 1, F.col("whole"))
    shares = joined.select("no", "term", p.alias("p"), q.alias("q")).where("p > q")
    return shares.select("no", "term", _divergence(F.col("p"), F.col("q")).alias("value"))


def source_divergence(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
    least_documents: int = LEAST_DOCUMENTS, top_terms: int = 200,
) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""

    def filled(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)

    docs = docs.select(filled(lang, "lang"), filled(source, "source"), filled(text, "text"))
    bounded, counts, names, sizes, occurring = source_counts(docs, least_documents)
    sums = counts.groupBy("no").agg(F.sum("n").alias("words"))
    of_lang = Window.partitionBy("lang")
    groups = (
        occurring.join(sums, "no", "left").join(sizes, "lang", "left").na.fill(0, ["words", "terms"])
        # Of a language without terms no probability is used; one keeps the divisions defined.
        .withColumn("total", F.greatest(F.col("words") + F.col("terms"), F.lit(1)))
        .withColumn("whole", F.greatest(F.sum("words").over(of_lang) + F.col("terms"), F.lit(1)))
        .withColumn("first", F.min("no").over(of_lang))
        .withColumn("sources", F.count("*").over(of_lang))
    )
    groups = stored(groups.drop("words"))
    best = Window.partitionBy("no").orderBy(F.desc("value"), "item")
    pairs = _pairs(groups.drop("whole"), counts).withColumn("rank", F.row_number().over(best).cast("int"))
    # Terms are numbered in the order of their names.
    first = Window.partitionBy("no").orderBy(F.desc("value"), "term")
    over = _over_terms(groups.select("no", "total", "whole"), counts, bounded)
    over = over.withColumn("rank", F.row_number().over(first).cast("int")).where(F.col("rank") <= top_terms)
    over = over.join(names, "term").withColumnRenamed("name", "item").join(occurring, "no")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).select(*columns)
        .unionByName(over.withColumn("part", F.lit("term")).select(*columns))
    )
