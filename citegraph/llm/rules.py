"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Texts are measured; fixed base rules reject the hopeless.  Further rules compare a ratio in
parts per thousand with a cutoff that is chosen per stratum (language) from labelled texts.
The cutoffs to choose from are fixed beforehand, so all labels serve as the holdout.

For a cutoff, let k of the n good labelled texts of a stratum be rejected.  The exact
binomial tail ``P(Bin(n, risk / rules) <= k)`` is the p-value of "it rejects more than
``risk / rules`` of the good texts".  Cutoffs of a rule are tested from the mildest on, and the
sequence ends at the first that is not proven, so it needs no correction of its own; the
strata x rules sequences share the error ``delta`` equally (Bonferroni).  With probability
``1 - delta`` all rules together reject at most ``risk`` of the good texts of every stratum.
A stratum with too few labels gets no cutoff and rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegraph.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
RISK = 0.05
DELTA = 0.05
#: Rule name -> (numerator, denominator, cutoffs in parts per thousand, mildest first).
RULES = {
    "symbols": ("n_symbols", "word_chars", (900, 600, 400, 300, 200, 150, 100, 70, 50, 30, 20)),
    "capitals": ("n_capitals", "word_chars", (950, 900, 800, 700, 600, 500, 400, 300, 200)),
    "dup_lines": ("n_dup_lines", "n_lines", (900, 700, 500, 400, 300, 200, 150)),
    "repeats": ("n_repeat_words", "n_words", (450, 400, 350, 300, 250, 200, 150)),
}
#: Up to so many words a window's hash and place share one number.
PACKED_WORDS = 1 << 16


def window_keys(words: Column, count: Column) -> tuple[Column, Column]:
    """The 3-word windows of a text, sorted by hash: packed longs, or pairs in long texts.

    48 bits of the hash and the place share a long in texts of up to 65,536 words.
    """
    def window_hash(i):
        return F.xxhash64(words[i], words[i + 1], words[i + 2])

    starts = F.when(count >= 3, F.sequence(F.lit(0), count - 3)).otherwise(
        F.array().cast("array<int>"))
    packed = F.sort_array(F.transform(starts, lambda i: window_hash(i).bitwiseAND(
        F.lit(-PACKED_WORDS)).bitwiseOR(i.cast("long"))))
    paired = F.sort_array(F.transform(
        starts, lambda i: F.struct(window_hash(i).alias("h"), i.cast("long").alias("i"))))
    return F.when(count <= PACKED_WORDS, packed), F.when(count > PACKED_WORDS, paired)


def repeat_places(items: Column, key, place) -> Column:
    """Sorted places of the windows that share their key with a neighbour in ``items``."""
    last = F.size(items) - 1
    found = F.filter(items, lambda x, j: (
        ((j > 0) & (key(items[F.greatest(j - 1, F.lit(0))]) == key(x)))
        | ((j < last) & (key(items[F.least(j + 1, last)]) == key(x)))))
    return F.sort_array(F.transform(found, place))


def covered(places: Column) -> Column:
    """Words in 3-word windows that start at the sorted ``places``."""
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))

    def step(state, place):
        gap = F.least(place - state["last"], F.lit(3).cast("long"))
        return F.struct(place.alias("last"), (state["n"] + gap).alias("n"))

    return F.aggregate(places, start, step, lambda s: s["n"])


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, stratum, n_words, word_chars, ..., base_failed)`` of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    packed, paired = window_keys(F.col("words"), F.size("words"))
    low = F.lit(PACKED_WORDS - 1)
    # Each step reads columns of the one before: a lambda would compute an expression anew
    # for every element.
    found = split.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        packed.alias("packed"), paired.alias("paired"))
    places = found.withColumn("places", F.coalesce(
        repeat_places(F.col("packed"), lambda x: x.bitwiseAND(F.lit(-PACKED_WORDS)),
                      lambda x: x.bitwiseAND(low)),
        repeat_places(F.col("paired"), lambda x: x["h"], lambda x: x["i"]))).drop("packed", "paired")
    return places.withColumn("n_repeat_words", covered(F.col("places"))).drop("places").withColumn(
        "base_failed",
        (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def exceeds(rule: str, cutoff: Column) -> Column:
    above, below, _ = RULES[rule]
    return F.col(above) * 1000 > cutoff * F.col(below)


def binomial_tail(rejected: Column, trials: Column, rate: float) -> Column:
    """``P(Bin(trials, rate) <= rejected)``, summed in logarithms; 1 beyond the mean, where no
    cutoff could be proven."""
    ratio = math.log(rate / (1 - rate))
    start = F.struct((trials * math.log(1 - rate)).alias("term"),
                     F.exp(trials * math.log(1 - rate)).alias("total"))

    def step(state, i):
        term = state["term"] + F.log((trials - i + 1) / i.cast("double")) + ratio
        return F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total"))

    terms = F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), rejected)).otherwise(
        F.array().cast("array<long>"))
    tail = F.aggregate(terms, start, step, lambda s: s["total"])
    return F.when(rejected > trials * rate, F.lit(1.0)).otherwise(tail)


def proven_cutoffs(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(stratum, rule, cutoff)``: the strictest proven cutoff from good texts as ``measured``."""
    choices = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(cutoff).alias("cutoff"),
                 exceeds(rule, F.lit(cutoff)).cast("long").alias("rejected"))
        for rule, (_, _, cutoffs) in RULES.items() for cutoff in cutoffs])
    counts = (
        holdout.select("stratum", F.explode(choices).alias("c"))
        .groupBy("stratum", "c.rule", "c.cutoff")
        .agg(F.sum("c.rejected").alias("rejected"), F.count(F.lit(1)).alias("good")))
    # One row per stratum, rule and cutoff from here on.
    strata = Window.partitionBy("rule", "cutoff")
    tested = counts.withColumn("strata", F.count(F.lit(1)).over(strata)).withColumn(
        "p", binomial_tail(F.col("rejected"), F.col("good"), risk / len(RULES)))
    sequence = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    proven = F.max((F.col("p") * F.col("strata") * len(RULES) > delta).cast("int")).over(sequence) == 0
    return tested.withColumn("proven", proven).where("proven").groupBy("stratum", "rule").agg(
        F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Measures and verdict of every row of ``docs``.

    A null text has no word and fails the base rules; a null language is a stratum of its own.
    Of several labels of a text the worst counts; labels without id or quality are left, and
    a text whose id repeats is labelled in each of its rows.  Without labels only the base
    rules reject.  Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    texts = scratch.save(measured(docs))
    good = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    holdout = texts.where("not base_failed").join(good.where("quality = 1"), "doc_id")
    cutoffs = proven_cutoffs(holdout, risk, delta).groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"max_{rule}") for rule in RULES])
    # A row per stratum; read back, its measured size decides how it is joined.
    table = scratch.save(cutoffs)
    failed = F.lit(False)
    for rule in RULES:
        failed = failed | F.coalesce(exceeds(rule, F.col(f"max_{rule}")), F.lit(False))
    return texts.join(table, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~failed).alias("kept"))
