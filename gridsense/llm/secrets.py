"""Secret scans: fixed patterns, then a battery of randomness tests over token-like strings.

For each candidate string an encoding is inferred (the narrowest alphabet that holds it). Under the
hypothesis "drawn uniformly from that alphabet" three tests give p-values: chi-squared of the character
counts, number of runs above and below the alphabet's middle, and serial correlation of neighbours. A
candidate fits randomness unless three times the smallest falls below ``FITS``. That alone would accept
short strings, which no test can reject. So each string is also held against how the corpus spells: which
character follows which in all its words of letters or of digits, shorter than any candidate. The chance of the
string in that spelling over its chance in a uniform draw is a p-value for "spelled like text" (by Markov's
inequality, as the inverse has the mean 1 there). A candidate is reported
if that p-value survives Benjamini and Hochberg's control of false discoveries at ``RATE`` within its length
class. All counts cover all documents; only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsense.llm.base import columns, packed, settle, text_of, unpacked

#: The base kinds in their order, their patterns, the shortest match that counts and the group measured.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]{14,}", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
)
RANDOM = "random"
#: Token-like: 16 characters or more with a digit or a letter among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
#: What the corpus's spelling is learnt from.
WORD = r"(?<![A-Za-z0-9])(?:[A-Za-z]{1,15}|[0-9]{1,15})(?![A-Za-z0-9])"
#: Encodings from the narrowest alphabet to the widest; the first that holds all characters is inferred.
ENCODINGS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: The characters of words; all others are one, the border of words.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BORDER, BORDERS = len(LETTERS), 4
#: Fixed value: the share of characters that follow none of the corpus's habits.
FREE = 0.1
FITS = 0.001
RATE = 0.01
STEPS = 400
PLACEHOLDER = "[secret]"
SPAN = "struct<kind:string,begin:int,stop:int,value:string>"


def spans_of(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """All matches from left to right as spans in code points, without those whose group is shorter than ``least``.

    The text between matches gives their places: a match begins after all that stands before it.
    """
    regex = F.lit(pattern)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, regex, F.lit(0))
    measured = F.transform(F.regexp_extract_all(text, regex, F.lit(group)), F.length) if group else F.transform(found, F.length)
    zipped = F.arrays_zip(between.alias("a"), found.alias("m"), measured.alias("n"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["a"])
        stop = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), stop.alias("stop"), x["m"].alias("value"))
        kept = F.when(x["n"] >= least, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(stop.alias("at"), kept.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    walked = F.aggregate(zipped, start, step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column, order: Sequence[str]) -> Column:
    """``kind:start:end``, by start, then kind as listed, comma-joined."""
    rank = F.array(*map(F.lit, order))
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["begin"].alias("begin"), F.array_position(rank, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")
        ),
    )
    said = lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(keyed), said), ",")


def tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (a fixed rational approximation, error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    #: Fixed values.
    weights = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    series = F.lit(0.0)
    for weight in reversed(weights):
        series = t * (weight + series)
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * tail(F.abs(z)))


def encoding_of(value: Column) -> Column:
    """Name and alphabet of the narrowest encoding; padding does not count."""
    found = F.lit(None).cast("struct<encoding:string,alphabet:string>")
    for name, alphabet in reversed(ENCODINGS):
        fits = F.length(F.translate(value, alphabet, "")) == 0
        found = F.when(fits, F.struct(F.lit(name).alias("encoding"), F.lit(alphabet).alias("alphabet"))).otherwise(found)
    return found


def spelling(texts: DataFrame) -> np.ndarray:
    """Logarithms of the chance of each character (column) after each (row), from all words of ``text``."""
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").count()
    pairs = F.expr("transform(sequence(1, length(word) + 1), i -> substring(concat(' ', word, ' '), i, 2))")
    held = words.select(F.explode(pairs).alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("n"))
    times = np.zeros((BORDER + 1, BORDER + 1))
    for pair, n in held.collect():  # at most one row for each two characters
        times[tuple(LETTERS.index(c) if c != " " else BORDER for c in pair)] = n
    single = (times.sum(axis=0) + 1) / (times.sum() + BORDER + 1)
    habit = (times + single) / (times.sum(axis=1, keepdims=True) + 1)
    chance = (1 - FREE) * habit + FREE * (single + 1 / (BORDER + 1)) / 2
    chance[:, BORDER] /= BORDERS
    return np.log(chance)


def battery(candidates: DataFrame, spelt: np.ndarray) -> DataFrame:
    """Adds encoding, length and p-values (uniform, runs, serial, text) of ``bare``, the value without padding."""
    rows = candidates.withColumn("found", encoding_of(F.col("bare"))).select(
        "*", F.col("found.encoding").alias("encoding"), F.col("found.alphabet").alias("alphabet")
    )
    codes = F.expr("transform(filter(split(bare, ''), c -> length(c) > 0), c -> cast(locate(c, alphabet) - 1 as double))")
    rows = rows.withColumn("codes", codes).withColumn("n", F.size("codes").cast("double"))
    k = F.length("alphabet").cast("double")
    counts = F.expr(
        "aggregate(array_distinct(codes), 0D, (s, c) -> s + power(cast(size(filter(codes, x -> x = c)) as double), 2D))"
    )
    chi = counts * k / F.col("n") - F.col("n")
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is close to normal.
    freedom = k - 1
    z_uniform = (F.cbrt(F.greatest(chi, F.lit(0.0)) / freedom) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    # One constant; an array of literals would make a plan of thousands of nodes.
    logs = F.split(F.lit(",".join(f"{x:.6f}" for x in spelt.ravel())), ",").cast("array<double>")
    places = F.expr(f"transform(filter(split(bare, ''), c -> length(c) > 0), c -> (locate(c, '{LETTERS}') + {BORDER}) % {BORDER + 1})")
    rows = rows.withColumn("places", F.concat(F.array(F.lit(BORDER)), places))
    steps = F.transform("places", lambda x, i: F.when(i > 0, F.get("places", i - 1) * (BORDER + 1) + x))
    text = F.aggregate(F.slice(steps, 2, F.size("places")), F.lit(0.0), lambda total, x: total + F.get(logs, x))
    p_text = F.exp(F.least(F.lit(0.0), text + F.col("n") * F.log(k)))
    above = F.expr("aggregate(codes, 0D, (s, c) -> s + if(c * 2 >= length(alphabet), 1D, 0D))")
    runs = F.expr(
        "1D + aggregate(sequence(1, cast(n as int) - 1), 0D, (s, i) -> s + if("
        "(codes[i] * 2 >= length(alphabet)) != (codes[i - 1] * 2 >= length(alphabet)), 1D, 0D))"
    )
    below = F.col("n") - F.col("above")
    mean = 2 * F.col("above") * below / F.col("n") + 1
    spread = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    z_runs = F.when(spread > 0, (F.col("runs") - mean) / F.sqrt(spread)).otherwise(F.sqrt("n"))
    centre = F.expr("aggregate(codes, 0D, (s, c) -> s + c) / n")
    variance = F.expr("aggregate(codes, 0D, (s, c) -> s + (c - centre) * (c - centre))")
    lagged = F.expr(
        "aggregate(sequence(1, cast(n as int) - 1), 0D, (s, i) -> s + (codes[i] - centre) * (codes[i - 1] - centre))"
    )
    z_serial = F.when(F.col("variance") > 0, (F.col("lagged") / F.col("variance") + 1 / F.col("n")) * F.sqrt("n"))
    return (
        rows.withColumns({"above": above, "runs": runs, "centre": centre, "p_uniform": tail(z_uniform), "p_text": p_text})
        .withColumns({"variance": variance, "lagged": lagged, "p_runs": two_sided(z_runs)})
        .withColumn("p_serial", two_sided(F.coalesce(z_serial, F.sqrt("n"))))
        .drop("found", "alphabet", "codes", "places", "above", "runs", "centre", "variance", "lagged")
    )


def discoveries(tested: DataFrame, steps: int = STEPS, rate: float = RATE) -> DataFrame:
    """Candidates whose ``p_text`` survives the step-up rule within their length class.

    p-values are counted on a grid of ``steps`` logarithmic steps (rounded up, so the control holds); the
    grid bounds what the thresholds are found from: classes times steps.
    """
    step = F.least(F.lit(steps), F.floor(-F.log10(F.greatest("p_text", F.lit(1e-40))) * 10)).cast("int")
    graded = tested.withColumn("class", F.floor(F.log2("n") * 2).cast("int")).withColumn("step", step)
    counts = graded.groupBy("class", "step").agg(F.count("*").alias("held"))
    upto = Window.partitionBy("class").orderBy(F.desc("step"))
    total = F.sum("held").over(Window.partitionBy("class"))
    passing = F.pow(F.lit(10.0), -F.col("step") / 10) <= F.lit(rate) * F.sum("held").over(upto) / total
    least = counts.select("class", "step", passing.alias("passes")).where("passes")
    least = least.groupBy("class").agg(F.min("step").alias("least"))
    return graded.join(F.broadcast(least), "class").where("step >= least")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, check (the text's hash), base (spans of the fixed kinds), found (those of the tests).

    Null texts are empty. Null keys, shared keys and equal rows are documents of their own. No rows give no
    rows. Spans of the tests that overlap a base span are left out. Other columns are not looked at.
    """
    named = docs.select(*columns(docs, key=key, text=text))
    rows = named.select(F.monotonically_increasing_id().alias("row"), F.col("key"), text_of().alias("text"))
    rows = rows.withColumn("check", F.xxhash64("text"))
    base = F.concat(*(spans_of(F.col("text"), *kind) for kind in BASE))
    first = rows.select("*", base.alias("base"), spans_of(F.col("text"), RANDOM, CANDIDATE, 16, 0).alias("candidates"))
    first = settle(first.drop("text"), "secret-spans")
    apart = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["begin"] < c["stop"]) & (c["begin"] < b["stop"])))
    candidates = first.where(F.size("candidates") > 0).select("row", F.explode(apart).alias("span"))
    tested = battery(candidates.withColumn("bare", F.rtrim(F.col("span.value"), F.lit("="))), spelling(rows))
    fits = 3 * F.least("p_uniform", "p_runs", "p_serial") >= FITS
    found = discoveries(settle(tested, "token-tests")).where(fits)
    found = found.groupBy("row").agg(F.collect_list("span").alias("found"))
    return first.join(found, "row", "left").select(
        "key", "check", "base", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found")
    )


KINDS = [kind for kind, *_ in BASE]


def report(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and the list of all spans."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    digest = F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256")
    every = joined(F.concat("base", "found"), [*KINDS, RANDOM]).alias("spans")
    return scanned.select("key", *counts, digest, every)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by ``[secret]``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["stop"].alias("stop"))))

    def step(state: Column, s: Column) -> Column:
        between = F.substr(text, state["at"] + 1, s["begin"] - state["at"])
        said = F.when(s["begin"] >= state["at"], F.concat(state["said"], between, F.lit(PLACEHOLDER)))
        said = said.otherwise(state["said"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), said.alias("said"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("said"))
    finish = lambda s: F.concat(s["said"], F.substr(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, finish)).otherwise(text)


def without_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with all their columns; in the text every span that ``scan`` finds is replaced."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    spans = scan(docs, key, text).where(F.size("base") + F.size("found") > 0)
    spans = spans.select(name(F.col("key")).alias("k1"), F.col("check").alias("k2"), F.concat("base", "found").alias("k3"))
    spans = spans.dropDuplicates(["k1", "k2"])
    own = packed(docs, key=key, text=text)
    marked = own.withColumns({"k1": name(F.col("key")), "k2": F.xxhash64(name(F.col("text")))}).drop("key", "text").join(spans, ["k1", "k2"], "left")
    given = F.col("row").getField(text)
    return unpacked(marked, docs.columns, **{text: F.when(F.col("k3").isNull(), given).otherwise(redacted(given, F.col("k3")))})
