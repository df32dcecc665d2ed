"""From abstracts to words that set clusters apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph import fixed_values as fixed
from citegraph.functions.stem import stem_vocabulary
from citegraph.functions.text import strip_before_filter, strip_punctuation, words
from citegraph.operators.relational import top_with_ties
from citegraph.scratch import Scratch


def clean_text(df: DataFrame, col: str, drop_containing=fixed.DROP_CONTAINING,
               replace=fixed.WORD_REPLACEMENTS) -> DataFrame:
    """Cleaned, lower-case text; rows without usable text are dropped.

    The text passes through a generator of at most one row, so it is cleaned
    once: a plain filter would be pushed below the cleaning and repeat it.
    """
    def usable(text):
        keep = text.isNotNull()
        for part in drop_containing:
            keep = keep & ~F.contains(text, F.lit(part))
        return keep

    others = [c for c in df.columns if c != col]
    once = F.explode(F.filter(F.array(strip_before_filter(col)), usable)).alias(col)
    kept = df.select(*others, once)
    return kept.withColumn(col, strip_punctuation(F.col(col), replace)).select(*df.columns)


def tokenize(df: DataFrame, col: str, out: str = "word") -> DataFrame:
    """One row per word; the text column goes, the others stay."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(words(col)).alias(out))


def remove_stop_words(tokens: DataFrame, stop: DataFrame, col: str = "word") -> DataFrame:
    """Anti join on a stop list; tokens without a word are dropped first."""
    listed = stop.select(F.col("word").alias(col)).distinct()
    return tokens.where(F.col(col).isNotNull()).join(listed, col, "left_anti")


#: Tokens of a word that one task takes.
WORD_TOKENS = 100_000


def stem_stop_words(tokens: DataFrame, stop: DataFrame, col: str = "word",
                    word_tokens: int = WORD_TOKENS) -> DataFrame:
    """Drop tokens whose stem is the stem of a stop word; adds ``stemmed``.

    Only the distinct vocabulary is stemmed.  The tokens of a word that has more than
    ``word_tokens`` are dealt over several tasks, by their other columns.
    """
    words = Scratch(tokens.sparkSession, "vocabulary").save(
        tokens.where(F.col(col).isNotNull()).groupBy(col).agg(F.ceil(F.count(F.lit(1)) / word_tokens).alias("_pieces")))
    listed = stem_vocabulary(stop.select("word").distinct()).select("stemmed").distinct()
    kept = stem_vocabulary(words, col).join(listed, "stemmed", "left_anti").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    # At most one word in so many tokens, so the list of them is short.
    frequent = F.broadcast(words.where("_pieces > 1"))
    piece = F.pmod(F.xxhash64(*tokens.columns), F.coalesce("_pieces", F.lit(1)))
    dealt = tokens.join(frequent, col, "left").withColumn("_piece", piece).drop("_pieces")
    return kept.join(dealt, [col, "_piece"]).drop("_piece").select(
        col, *[c for c in tokens.columns if c != col], "stemmed")


def term_counts(tokens: DataFrame, by, term: str = "word", n: str = "n") -> DataFrame:
    """Occurrences per group and word."""
    by = [by] if isinstance(by, str) else list(by)
    return tokens.groupBy(*by, term).agg(F.count(F.lit(1)).alias(n))


#: Documents beyond which their totals are looked up by hash.
MANY_DOCS = 100_000


def tf_idf(counts: DataFrame, term: str = "word", doc: str = "ut", n: str = "n",
           many_docs: int = MANY_DOCS) -> DataFrame:
    """Add ``tf``, ``idf`` and ``tf_idf``.

    A row without a document counts as a row that holds the term, but not as a
    document, and has no score of its own.  The counts are read three times, so
    they are kept in a scratch table rather than counted again from the texts.
    Holders, and totals of many documents, are looked up by hash, so the counts
    are not sorted.
    """
    scratch = Scratch(counts.sparkSession, "counts")
    counts = scratch.save(counts)
    totals, seen = scratch.save_observed(
        counts.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.sum(n).alias("_total")),
        docs=F.count(F.lit(1)))
    # A few totals are broadcast, and a few large groups would meet them in a few tasks.
    if seen["docs"] > many_docs:
        totals = totals.hint("shuffle_hash")
    holders = counts.groupBy(term).agg(F.count(F.lit(1)).alias("_holders"))
    return (
        counts.join(holders.hint("shuffle_hash"), term)
        .join(totals, doc, "left")
        .withColumn("tf", F.col(n) / F.col("_total"))
        .withColumn(
            "idf", F.when(F.col(doc).isNotNull(), F.log(F.lit(seen["docs"]) / F.col("_holders")))
        )
        .withColumn("tf_idf", F.col("tf") * F.col("idf"))
        .select(*counts.columns, "tf", "idf", "tf_idf")
    )


def papers_per_cluster(tokens: DataFrame, level: str, paper: str = "ut") -> DataFrame:
    """Papers with at least one surviving word, per cluster."""
    return tokens.groupBy(level).agg(F.countDistinct(paper).alias("npapers"))


def top_terms_by_cluster(tokens: DataFrame, level: str, carry=(), n: int = fixed.TOP_TERMS,
                         paper: str = "ut") -> DataFrame:
    """The words with the n highest tf-idf per cluster, ties kept.

    ``carry`` names parent levels.  NULL clusters take part in the counts and
    drop out of the ranking.  Words are first counted per paper, in one pass over
    the texts; everything else follows from that smaller table.
    """
    per_paper = Scratch(tokens.sparkSession, "words").save(
        term_counts(tokens, [*carry, level, paper])
    )
    counts = per_paper.groupBy(*carry, level, "word").agg(F.sum("n").alias("n"))
    best = top_with_ties(tf_idf(counts, "word", level), [level], "tf_idf", n)
    return best.join(papers_per_cluster(per_paper, level, paper), level)


def words_in_line(top: DataFrame, level: str, carry=(), order: str = "n") -> DataFrame:
    """One row per cluster: ``npapers`` and its words, highest first."""
    arranged = F.sort_array(
        F.collect_list(F.struct((-F.col(order)).alias("rank"), F.col("word")))
    )
    line = F.array_join(F.transform(arranged, lambda w: w["word"]), ", ")
    return top.groupBy(level).agg(
        *[F.max(c).alias(c) for c in carry], F.max("npapers").alias("npapers"), line.alias("words")
    )
