"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule names a host and a path beginning, fits that host and its subdomains, and the longest fitting
rule decides. URLs without a rule are judged by boosted trees over the URL's length, depth, digit
ratio, entropy, parameter counts and the like, and over how often hosts of the same suffix (last part
of the host) were blocked among all labelled URLs. Training is Spark's own, on a bounded sample.

A suffix is counted by hosts: each adds the share of its labelled URLs that are blocked, beside
``SMOOTHING`` hosts of average rate. So one host, or a rule about one, hardly speaks for its suffix. For the
URLs that are learnt from, a suffix is counted without the URLs of their own of ``FOLDS`` folds (by hash).
Otherwise a URL's own label would stand in its rate, and the trees would trust rates that unseen
suffixes do not have.

Defined cases: a null URL or one without :// has an empty host and path, and still gets a verdict.
Rules are a parameter of bounded length. With labels of one kind only that verdict is given to all;
without labels everything is allowed. If only the sample is of one kind, all get the labelled URLs' rate
of blocking as their score. Repeated rows each get their row; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.storage import stored

SAMPLE_ROWS = 20_000  # labelled URLs to learn from
TREES = 10
DEPTH = 4
BROADCAST_SUFFIXES = 100_000  # a larger table of suffixes is joined as Spark sees fit
SMOOTHING = 10.0  # hosts of average rate added to each suffix
FOLDS = 5
_WHOLE = -1  # stands for no fold left out
_UNIT = 1_000_000_000  # shares are summed as whole numbers, the same in any order

FEATURES = (
    "url_chars", "host_chars", "path_chars", "depth", "host_parts", "digit_ratio", "entropy", "parameters",
    "query_chars", "hyphens", "suffix_rate", "suffix_share",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str) -> Column:
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: dict[str, str]) -> Column:
    """The longest rule that fits ``host`` and ``path``; of equally long ones the first in text order."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        at = (F.col("host") == name) | F.endswith(F.col("host"), F.lit(f".{name}"))
        fits.append(F.when(at & F.startswith(F.col("path"), F.lit(f"/{rest}")), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _entropy(text: Column) -> Column:
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    bits = F.transform(F.filter(counts, lambda k: k > 0), lambda k: k / n * F.log2(n / k))
    return F.coalesce(F.aggregate(bits, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def _suffix() -> Column:
    return F.substring_index("host", ".", -1)


def lexical(pages: DataFrame) -> DataFrame:
    """Features of a URL's text; needs ``url``, ``host`` and ``path``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = F.length(url)
    return pages.select(
        "*",
        size.cast("double").alias("url_chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_parts"),
        F.coalesce(F.try_divide(F.regexp_count(url, F.lit("[0-9]")).cast("double"), size), F.lit(0.0)).alias("digit_ratio"),
        _entropy(url).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double").alias("parameters"),
        F.length(query).cast("double").alias("query_chars"),
        F.regexp_count(F.col("host"), F.lit("-")).cast("double").alias("hyphens"),
        _suffix().alias("suffix"),
    )


def fold(url: str) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(FOLDS)), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """suffix, fold, shares, hosts, urls: the labelled URLs (url, host, label) counted without those of a
    fold, and once without leaving out any (fold -1). One aggregation by host, then one by suffix."""
    own = fold("url")
    each = [
        part
        for k in range(FOLDS)
        for part in (F.sum(F.when(own == k, F.col("label")).otherwise(0.0)).alias(f"b{k}"), F.count_if(own == k).alias(f"n{k}"))
    ]
    hosts = labelled.groupBy(_suffix().alias("suffix"), "host").agg(F.sum("label").alias("b"), F.count("*").alias("n"), *each)
    without = [F.struct(F.lit(_WHOLE).alias("fold"), F.col("b").alias("blocked"), F.col("n").alias("urls"))]
    without += [
        F.struct(F.lit(k).alias("fold"), (F.col("b") - F.col(f"b{k}")).alias("blocked"), (F.col("n") - F.col(f"n{k}")).alias("urls"))
        for k in range(FOLDS)
    ]
    rest = hosts.select("suffix", F.inline(F.array(*without))).where("urls > 0")
    share = F.round(F.col("blocked") / F.col("urls") * _UNIT).cast("long")
    return rest.groupBy("suffix", "fold").agg(
        F.sum(share).alias("shares"), F.count("*").alias("hosts"), F.sum("urls").alias("urls")
    )


def verdicts(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None, *, rows: int = SAMPLE_ROWS):
    """One row for each page: page_id, host, path, rule, verdict and score (of blocking, null where a
    rule decides).

    ``labelled`` has url and blocked (boolean). Left out, the URLs that a rule decides are the labels.
    At most ``rows`` of them are learnt from, by hash order; equal URLs count once. The suffixes are
    counted over all of them.
    """
    url = F.col("url").cast("string").alias("url")
    known = pages.select("page_id", url).withColumn("host", host("url")).withColumn("path", path("url"))
    known = known.withColumn("rule", fitting_rule(rules))
    blocks = F.lit([r for r, verdict in rules.items() if verdict == "block"]).cast("array<string>")
    by_rule = F.array_contains(blocks, F.col("rule"))
    if labelled is None:
        labelled = known.where("rule is not null").select("url", by_rule.alias("blocked"))
    distinct = stored(
        labelled.select(url, F.col("blocked").cast("boolean").alias("blocked"))
        .where("url is not null and blocked is not null")
        .groupBy("url")
        .agg(F.max("blocked").cast("double").alias("label"))
        .withColumn("host", host("url"))
        .withColumn("path", path("url"))
    )
    sample = stored(lexical(distinct.orderBy(F.xxhash64("url"), "url").limit(rows)))
    both = sample.agg(F.min("label") < F.max("label")).first()[0]
    blocked, n = distinct.agg(F.sum("label"), F.count("*")).first()
    rate = blocked / n if n else 0.0
    rest = lexical(known.where("rule is null"))
    if both:
        counted = stored(suffix_counts(distinct))
        whole = F.create_map(*[F.lit(x) for r in counted.groupBy("fold").agg(F.sum("urls")).collect() for x in r])
        suffixes = counted.select(
            "suffix", "fold",
            ((F.col("shares") / _UNIT + SMOOTHING * rate) / (F.col("hosts") + SMOOTHING)).alias("suffix_rate"),
            (F.col("urls") / F.try_element_at(whole, F.col("fold"))).alias("suffix_share"),
        )
        if counted.count() <= BROADCAST_SUFFIXES:
            suffixes = F.broadcast(suffixes)
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")

        def features(urls: DataFrame, left_out: Column) -> DataFrame:
            joined = urls.withColumn("fold", left_out).join(suffixes, ["suffix", "fold"], "left")
            return assembled.transform(joined.fillna({"suffix_rate": rate, "suffix_share": 0.0}))

        trained = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=17, labelCol="label", featuresCol="features").fit(
            features(sample, fold("url")).select("features", "label")
        )
        scored = trained.transform(features(rest, F.lit(_WHOLE)))
        score = vector_to_array("probability")[1]
    else:
        scored, score = rest, F.lit(float(rate))
    names = ("page_id", "host", "path", "rule")
    word = lambda blocked: F.when(blocked, "block").otherwise("allow").alias("verdict")
    by_model = scored.select(*names, score.alias("score")).select(*names, word(F.col("score") >= 0.5), "score")
    ruled = known.where("rule is not null").select(*names, word(by_rule), F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(by_model)
