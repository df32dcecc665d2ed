"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph import fixed_values as fixed
from citegraph.functions.nulls import mean_of, not_in_keep_null, standardise, sum_of
from citegraph.operators.relational import (
    grouped_median, top_numbered, value_flags, with_extent, with_group_totals,
)
from citegraph.operators.text import top_terms_by_cluster, words_in_line

# Report names of the indicator columns.
INDICATORS = {
    "twitter": "tweets", "news": "news", "policy": "policy", "total": "all_indicators",
}
INDICATORS_WITH_CITATIONS = {"n_cits": "citations", **INDICATORS}


def scored_papers(papers: DataFrame, altmetrics: DataFrame, noise=(),
                  noise_level: str = "macro_cluster") -> DataFrame:
    """Papers with indicators, minus listed clusters; papers without cluster stay."""
    return (
        papers.join(altmetrics, "ut", "left")
        .where(F.col("total").isNotNull())
        .where(not_in_keep_null(noise_level, noise))
    )


def impact_by_cluster(scored: DataFrame, level: str, indicators=None, with_count: bool = True,
                      round_digits: int | None = None, drop_null_cluster: bool = False,
                      null_policy: str = "skip") -> DataFrame:
    """Sums, means and standardised means of the indicators per cluster.

    The group of papers without cluster takes part in the standardisation and is
    dropped, if at all, afterwards.  With ``round_digits`` means are rounded
    before they are standardised and scores once more.
    """
    indicators = INDICATORS if indicators is None else indicators
    count = [F.count(F.lit(1)).alias("n_articles")] if with_count else []
    table = scored.groupBy(level).agg(
        *count,
        *[sum_of(c, null_policy).alias(f"n_{name}") for c, name in indicators.items()],
        *[mean_of(c, null_policy, round_digits).alias(f"avg_{n}") for c, n in indicators.items()],
    )
    names = indicators.values()
    table = standardise(table, {f"avg_{n}": f"z_{n}" for n in names}, round_digits)
    return table.where(F.col(level).isNotNull()) if drop_null_cluster else table


def cluster_words(tokens: DataFrame, level: str, carry=(), n: int = fixed.TOP_TERMS,
                  order: str = "n", paper: str = "ut") -> DataFrame:
    """Papers and distinguishing words of every cluster."""
    top = top_terms_by_cluster(tokens, level, carry, n, paper)
    return words_in_line(top, level, carry, order)


def cluster_profile(words: DataFrame, impact: DataFrame, level: str,
                    key: str = "z_all_indicators") -> DataFrame:
    """Words and impact side by side, for clusters that have a score."""
    scores = [c for c in impact.columns if c.startswith("z_")]
    joined = words.join(impact, level, "outer")
    return joined.where(F.col(key).isNotNull()).select(level, "npapers", *scores)


def topics_by_community(vertices: DataFrame, k: int = fixed.N_TOPICS,
                        min_gamma: float = fixed.MIN_GAMMA) -> DataFrame:
    """Per community: papers, topics, commonest topic and medians of shares.

    ``vertices`` is (name, community, topic, gamma, gamma1..gammaK).  A share
    below ``min_gamma`` is left out of its median.
    """
    groups = vertices.groupBy("community").agg(
        F.countDistinct("name").alias("npapers"),
        F.countDistinct("topic").alias("ntopic"),
        F.mode("topic", True).alias("most_topic"),
    )
    shares = [f"gamma{i}" for i in range(1, k + 1)]
    melted = vertices.unpivot(["community"], ["gamma", *shares], "_name", "_value").where(
        (F.col("_name") == "gamma") | (F.col("_value") >= min_gamma)
    )
    medians = grouped_median(melted, ["community", "_name"], "_value", "_median")
    wide = medians.groupBy("community").pivot("_name", ["gamma", *shares]).agg(F.max("_median"))
    wide = wide.withColumnRenamed("gamma", "most_topic_median")
    return with_extent(groups, wide, ["community"])


def topic_histogram(vertices: DataFrame, community=None) -> DataFrame:
    """Papers per topic, of one community or of all."""
    chosen = vertices if community is None else vertices.where(F.col("community") == community)
    return chosen.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def institution_flags(papers: DataFrame, institutions=None) -> DataFrame:
    """Papers with a 0/1 column per institution.

    ``papers`` is (id_art, Title, Year, Affiliation); affiliation codes are
    separated by blanks.
    """
    institutions = fixed.INSTITUTIONS if institutions is None else institutions
    codes = papers.where(F.col("Affiliation") != "").select(
        "id_art", F.explode(F.split("Affiliation", " ")).alias("code")
    )
    flags = value_flags(codes.where(F.col("code") != ""), "id_art", "code", institutions)
    labels = papers.select("id_art", F.col("Title").alias("label"), "Year").distinct()
    return (
        labels.join(flags, "id_art", "left")
        .fillna(0, list(institutions.values()))
        .withColumnRenamed("id_art", "id")
    )


def cluster_sizes(clusters: DataFrame, min_size: int = fixed.MIN_CLUSTER_SIZE) -> DataFrame:
    """Papers per cluster, small clusters left out."""
    sizes = clusters.groupBy("cluster").agg(F.countDistinct("id_art").alias("n"))
    return sizes.where(F.col("n") >= min_size)


def people_in_clusters(people: DataFrame, clusters: DataFrame,
                       min_size: int = fixed.MIN_CLUSTER_SIZE) -> DataFrame:
    """Distinct people-paper rows with the cluster of the paper, large clusters only."""
    return (
        people.join(clusters, "id_art")
        .join(cluster_sizes(clusters, min_size), "cluster")
        .select("PersonID", "id_art", "Title", "Affiliation", "Year", "cluster")
        .distinct()
    )


def person_cluster_share(people_clusters: DataFrame, clusters: DataFrame) -> DataFrame:
    """Share of each person's papers per cluster, next to affiliation and year.

    ``clusters`` has one row per paper, so a person's papers are the sum over the clusters.
    """
    papers = people_clusters.select("PersonID", "id_art").distinct()
    counted = papers.join(clusters, "id_art", "left").groupBy("PersonID", "cluster").agg(
        F.count(F.lit(1)).alias("papers")
    )
    shares = with_group_totals(counted, ["PersonID"], person_total=F.sum("papers")).select(
        "PersonID", "cluster", (F.col("papers") / F.col("person_total")).alias("pct_cluster")
    )
    facts = people_clusters.select("PersonID", "Affiliation", "Year", "cluster").distinct()
    return facts.join(shares, ["PersonID", "cluster"], "left").select(
        "PersonID", "Affiliation", "Year", "cluster", "pct_cluster"
    )


def institution_cluster_share(shares: DataFrame, dedupe: bool = True) -> DataFrame:
    """Person shares added up per institution and cluster.

    With ``dedupe`` equal shares of different people at one institution count once.
    """
    rows = shares.select("Affiliation", "cluster", "pct_cluster")
    if dedupe:
        rows = rows.distinct()
    return rows.groupBy("Affiliation", "cluster").agg(F.sum("pct_cluster").alias("total"))


def cluster_keywords(tfidf: DataFrame, clusters: DataFrame,
                     min_tf_idf: float = fixed.MIN_KEYWORD_TF_IDF,
                     top: int = fixed.TOP_KEYWORDS) -> DataFrame:
    """The words found in most papers of each cluster."""
    strong = tfidf.where(F.col("tf_idf") >= min_tf_idf).select("id_art", "word")
    counts = strong.join(clusters, "id_art").groupBy("cluster", "word").agg(
        F.countDistinct("id_art").alias("n")
    )
    return top_numbered(counts, ["cluster"], [F.col("n").desc(), F.col("word")], top)


def present(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Chosen columns in order, under their report labels."""
    return df.select(*[F.col(c).alias(label) for c, label in labels.items()])
