"""URL filters: host rules first, then gradient-boosted trees over lexical features.

Features are built-in expressions over the url: lengths, depth, digit ratio, entropy of characters,
parameter counts, and for the host's suffix how common it is and how often labelled urls of it were blocked.
Trees are trained by Spark's library on labelled urls and scored in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsense.functions.names import field
from gridsense.llm.base import columns, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled urls used for training at most, chosen by hash.
SAMPLE = 50_000
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "symbol_ratio", "entropy",
    "parameters", "has_fragment", "is_https", "suffix_blocked", "suffix_log_count",
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A struct of the longest fitting rule and its verdict; null where none fits. Equal lengths: the first listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(enumerate(rules), key=lambda x: (len(x[1][0]), -x[0]))
    for _, (rule, verdict) in ordered:
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits per character, from the counts of the characters present."""
    size = F.length(text).cast("double")
    letters = F.split(text, "")
    return F.when(size > 0, F.aggregate(
        F.array_distinct(letters),
        F.lit(0.0),
        lambda total, c: total + F.when(F.length(c) > 0, _share(text, c, size)).otherwise(0.0),
    )).otherwise(0.0)


def _share(text: Column, c: Column, size: Column) -> Column:
    p = (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def with_parts(pages: DataFrame) -> DataFrame:
    """Host, path, suffix and the features that need no other rows. Null urls are treated as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    return parts.select(
        "*",
        F.substring_index("host", ".", -1).alias("suffix"),
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        F.regexp_count("host", F.lit(r"[^.]+")).cast("double").alias("labels"),
        (F.regexp_count(url, F.lit("[0-9]")) / size).alias("digit_ratio"),
        (F.regexp_count(url, F.lit("[^A-Za-z0-9]")) / size).alias("symbol_ratio"),
        _entropy(url).alias("entropy"),
        F.regexp_count(query, F.lit("[^&]+")).cast("double").alias("parameters"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.lower(F.substring(url, 1, 8)).eqNullSafe("https://").cast("double").alias("is_https"),
    )


def suffix_statistics(parts: DataFrame) -> DataFrame:
    """Per host suffix: labelled urls blocked (smoothed share) and how many urls of all have it (log)."""
    overall = F.lit(0.5)
    blocked = F.sum(F.when(F.col("labelled") == "block", 1.0).otherwise(0.0))
    seen = F.count("labelled")
    return parts.groupBy("suffix").agg(
        ((blocked + 5 * overall) / (seen + 5)).alias("suffix_blocked"), F.log1p(F.count("*")).alias("suffix_log_count")
    )


def filtered(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None,
             sample: int = SAMPLE, trees: int = 20, depth: int = 4, seed: int = 4, key: str = "page_id",
             url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, score (the trees' probability of ``block``; null under a rule).

    ``labelled`` has columns url and verdict; without it the urls that rules decide serve as labels. At
    most about ``sample`` of them, chosen by hash, train the trees. Null urls, and those without ``://``,
    have empty host and path and are judged by the trees. Equal rows are judged alike, each for itself.
    If the labels hold one verdict only, the trees are left out and that verdict holds; without any labels
    it is ``allow``. No rows give no rows. Other columns are not looked at.
    """
    named = pages.select(*columns(pages, key=key, url=url)).withColumn("url", F.col("url").cast("string"))
    parts = with_parts(named)
    parts = parts.withColumn("decided", rule_for(F.col("host"), F.col("path"), rules))
    given = None if labelled is None else labelled.select(field("url").alias("url"), field("verdict").alias("labelled"))
    parts = parts.withColumn("labelled", F.col("decided.verdict") if given is None else F.lit(None).cast("string"))
    learn = parts if given is None else with_parts(given)
    stats = settle(suffix_statistics(parts if given is None else parts.select("suffix", "labelled").unionByName(
        learn.select("suffix", "labelled"))), "suffixes")
    known = learn.where(F.col("labelled").isin("allow", "block"))
    verdicts = {r["labelled"]: r["n"] for r in known.groupBy("labelled").agg(F.count("*").alias("n")).collect()}
    featured = parts.join(stats, "suffix", "left")
    plain = [F.col("key"), F.col("host"), F.col("path"), F.col("decided.rule").alias("rule")]
    if len(verdicts) < 2:
        only = next(iter(verdicts), "allow")
        verdict = F.coalesce(F.col("decided.verdict"), F.lit(only)).alias("verdict")
        return featured.select(*plain, verdict, F.lit(None).cast("double").alias("score"))
    share = min(1.0, sample / sum(verdicts.values()))
    chosen = F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(1_000_000)) < int(share * 1_000_000)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    target = (F.col("labelled") == "block").cast("double").alias("label")
    training = known.where(chosen).join(stats, "suffix", "left").fillna(0.0, list(FEATURES)).select("*", target)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=seed, cacheNodeIds=False).fit(
        settle(assembler.transform(training).select("features", "label"), "labelled-urls")
    )
    scored = model.transform(assembler.transform(featured.fillna(0.0, list(FEATURES))))
    score = vector_to_array(F.col("probability"))[1]
    by_trees = F.when(score > 0.5, "block").otherwise("allow")
    return scored.select(
        *plain,
        F.coalesce(F.col("decided.verdict"), by_trees).alias("verdict"),
        F.when(F.col("decided").isNull(), score).alias("score"),
    )
