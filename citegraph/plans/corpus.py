"""Selecting a corpus and the tables around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph import fixed_values as fixed
from citegraph.functions.text import contains_any


def extract_corpus(text_data: DataFrame, terms=fixed.CORPUS_TERMS,
                   columns=fixed.CORPUS_COLUMNS) -> DataFrame:
    """Distinct rows with one of the words in one of the columns, from one scan."""
    return text_data.where(contains_any(columns, terms)).distinct()


def enrich_corpus(corpus: DataFrame, pub_detail: DataFrame, clustering: DataFrame,
                  journal_code: DataFrame, journals: DataFrame,
                  disciplines: DataFrame) -> DataFrame:
    """Publication details plus classification, journal discipline and specialty."""
    texts = corpus.select("ut", "abstract", "keyword", "keyword_plus")
    journal_facts = journals.join(disciplines, "discipline_code", "left").select(
        "journal_code", "nsf_discipline", "nsf_specialty"
    )
    return (
        pub_detail.join(texts, "ut")
        .join(clustering, "ut", "left")
        .join(journal_code, "ut", "left")
        .join(journal_facts, "journal_code", "left")
        .drop("journal_code")
    )


def noun_phrase_table(corpus: DataFrame, title_np: DataFrame, abstract_np: DataFrame,
                      noun_phrase: DataFrame) -> DataFrame:
    """Distinct noun phrases of titles and abstracts, tagged by where they stand."""
    def tagged(phrases: DataFrame, source: str) -> DataFrame:
        return phrases.select("ut", "noun_phrase_id", "freq", F.lit(source).alias("source"))

    both = tagged(title_np, "title").unionByName(tagged(abstract_np, "abstract"))
    return (
        both.join(corpus.select("ut"), "ut", "left_semi")
        .join(noun_phrase, "noun_phrase_id")
        .select("ut", "noun_phrase", "freq", "source")
        .distinct()
    )


def citation_links(corpus: DataFrame, citation: DataFrame) -> DataFrame:
    """Distinct links from or to a paper of the corpus.

    Each link is looked up under both of its ends, in one pass over the links.
    """
    links = citation.select(
        "citing_ut", "cited_ut", F.explode(F.array_distinct(F.array("citing_ut", "cited_ut"))).alias("ut")
    )
    papers = corpus.select("ut").distinct()
    return links.join(papers, "ut", "left_semi").select("citing_ut", "cited_ut").distinct()


def altmetric_links(corpus: DataFrame, pub_detail: DataFrame, pub_citation: DataFrame,
                    pub_counts: DataFrame) -> DataFrame:
    """Attention counts of every paper of the corpus, found through its DOI."""
    counts = pub_citation.join(pub_counts, "record_id", "left")
    papers = corpus.select("ut").join(pub_detail.select("ut", "doi"), "ut")
    return papers.join(counts, "doi", "left").select(
        "ut", "doi", *[c for c in counts.columns if c != "doi"]
    )
