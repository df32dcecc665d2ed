"""From a network to the report of its nested communities, in one dependent plan."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.operators.graph.louvain import nested_louvain
from citegraph.plans import reports
from citegraph.scratch import Scratch

LEVELS = ("macro_cluster", "meso_cluster", "micro_cluster")


def level_links(edges: DataFrame, membership: DataFrame, levels=LEVELS, vertex: str = "ut") -> DataFrame:
    """``(level, src, dst, weight)``: links between the clusters of each level, ``dst >= src``.

    A row with equal ends is the weight inside a cluster.  All levels come from one
    pass over the links: both ends are placed once, and the weights are summed per
    pair of lowest clusters before the levels are told apart.
    """
    def side(end):
        return membership.select(F.col(vertex).alias(end), F.struct(*levels).alias(f"_{end}"))

    placed = (
        edges.select("src", "dst", "weight")
        .join(side("src"), "src").join(side("dst"), "dst")
        .groupBy("_src", "_dst").agg(F.sum("weight").alias("weight"))
    )
    each = F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(f"_src.{level}").alias("a"), F.col(f"_dst.{level}").alias("b"))
        for level in levels]))
    rows = placed.select(each.alias("_at"), "weight").where("_at.a IS NOT NULL AND _at.b IS NOT NULL")
    return rows.groupBy(
        F.col("_at.level").alias("level"), F.least("_at.a", "_at.b").alias("src"),
        F.greatest("_at.a", "_at.b").alias("dst")).agg(F.sum("weight").alias("weight"))


def cluster_reports(membership: DataFrame, links: DataFrame, tokens: DataFrame, altmetrics: DataFrame,
                    levels=LEVELS) -> DataFrame:
    """A row per cluster of every level: parent, size, weight inside and to others, words, impact.

    ``membership`` is ``(ut, <levels>)`` with clusters numbered through a level,
    ``links`` as by ``level_links``, ``tokens`` ``(ut, word)`` and ``altmetrics`` the
    indicators per paper.  Papers without cluster take part in the scores, as a group,
    but have no row.  A cluster without words or indicators has NULL there.
    """
    known = tokens.join(membership, "ut")
    scored = reports.scored_papers(membership, altmetrics)
    ends = links.select("level", F.explode(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(
        F.array("src", "dst"))).alias("cluster"), "weight", (F.col("src") == F.col("dst")).alias("_in"))
    weights = ends.groupBy("level", "cluster").agg(
        F.sum(F.when(F.col("_in"), F.col("weight")).otherwise(0)).alias("inside"),
        F.sum(F.when(~F.col("_in"), F.col("weight")).otherwise(0)).alias("outside"))
    parts = []
    for number, level in enumerate(levels):
        kind = membership.schema[level].dataType
        parent = F.min(levels[number - 1]) if number else F.lit(None)
        sizes = membership.where(F.col(level).isNotNull()).groupBy(level).agg(
            parent.cast(kind).alias("parent"), F.count(F.lit(1)).alias("n_members"))
        words = reports.cluster_words(known, level).select(level, "npapers", "words")
        impact = reports.impact_by_cluster(scored, level, drop_null_cluster=True)
        parts.append(
            sizes.join(words, level, "left").join(impact, level, "left")
            .withColumnRenamed(level, "cluster").withColumn("level", F.lit(level)))
    rows = functools.reduce(DataFrame.unionByName, parts).join(weights, ["level", "cluster"], "left")
    return rows.fillna(0, ["inside", "outside"])


def network_map(articles: DataFrame, edges: DataFrame, tokens: DataFrame, altmetrics: DataFrame,
                levels=LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Communities found in a network, the links between them, and their reports.

    Each is a table that later readers share: the membership ``(ut, <levels>)``,
    ``level_links`` and ``cluster_reports`` of the same membership.
    """
    scratch = Scratch(edges.sparkSession, "map")
    edges = scratch.save(edges.select("src", "dst", "weight"))
    membership = scratch.save(nested_louvain(articles, edges, levels))
    links = scratch.save(level_links(edges, membership, levels))
    return membership, links, cluster_reports(membership, links, tokens, altmetrics, levels)
