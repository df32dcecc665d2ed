"""Connected components by contraction, and the main component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.operators.networks import both_directions, vertices_of
from citegraph.scratch import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` where the component is its smallest vertex id.

    Each round points every vertex at its smallest neighbour, follows the
    pointers to their roots and replaces the edges by edges between roots.  The
    graph shrinks geometrically, so the first round dominates.
    """
    scratch = Scratch(edges.sparkSession, "components")
    labels = scratch.save(vertices_of(edges)).withColumn("component", F.col("id"))
    # Links that come twice do no harm, so the first round does not sort them out.
    graph, left = _save_counted(edges.where("src <> dst").select("src", "dst"), scratch)
    while left:
        roots = _roots(graph, scratch)
        labels = labels.join(
            roots.withColumnRenamed("id", "component"), "component", "left"
        ).select("id", F.coalesce("root", "component").alias("component"))
        contracted, left = _save_counted(_contract(graph, roots), scratch)
        scratch.drop(graph)
        graph = contracted
    return labels


def _save_counted(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    table, seen = scratch.save_observed(df, rows=F.count(F.lit(1)))
    return table, seen["rows"]


def _roots(graph: DataFrame, scratch: Scratch) -> DataFrame:
    """Follow smallest-neighbour pointers until each one ends at a root."""
    pointers = (
        both_directions(graph)
        .groupBy(F.col("src").alias("id"))
        .agg(F.min("dst").alias("_least"))
        .select("id", F.least("id", "_least").alias("root"))
    )
    table = scratch.save(pointers)
    while True:
        ahead = table.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        further = ahead.toDF("_next", "_last")
        jumped = table.join(ahead, "root").join(further, "_next").select(
            "id", F.col("_last").alias("root"), (F.col("_last") != F.col("root")).alias("_moved")
        )
        following, seen = scratch.save_observed(
            jumped, moved=F.coalesce(F.sum(F.col("_moved").cast("long")), F.lit(0))
        )
        scratch.drop(table)
        table = following.select("id", "root")
        if not seen["moved"]:
            return table


def _contract(graph: DataFrame, roots: DataFrame) -> DataFrame:
    return (
        graph.join(roots.withColumnRenamed("id", "src"), "src")
        .select(F.col("root").alias("_src"), "dst")
        .distinct()  # few are left where roots have many vertices
        .join(roots.withColumnRenamed("id", "dst"), "dst")
        .where(F.col("_src") != F.col("root"))
        .select(F.least("_src", "root").alias("src"), F.greatest("_src", "root").alias("dst"))
        .distinct()
    )


def main_component(edges: DataFrame, which: str = "largest",
                   parents: DataFrame | None = None) -> DataFrame:
    """Vertices ``(id[, parent])`` of the kept component, one per parent if given.

    ``largest`` keeps the biggest component (ties: smallest id); ``first`` keeps
    the one that holds the smallest source.  ``parents`` is ``(id, parent)`` for
    edges that never leave their parent.
    """
    labelled = connected_components(edges)
    by = ["parent"] if parents is not None else []
    if by:
        labelled = labelled.join(parents, "id")
    # Read twice below.
    labelled = Scratch(edges.sparkSession, "labelled").save(labelled)
    sizes = labelled.groupBy("component", *by).agg(F.count(F.lit(1)).alias("_size"))
    if which == "largest":
        order = F.struct((-F.col("_size")).alias("size"), F.col("component"))
    elif which == "first":
        order = F.struct(F.col("component"))
    else:
        raise ValueError(f"unknown choice {which!r}")
    kept = (
        sizes.groupBy(*by).agg(F.min(order).alias("_best")).select("_best.component", *by)
    )
    return labelled.join(kept.select("component"), "component", "left_semi").select("id", *by)


def keep_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges of the kept components; a component is closed, so one end decides."""
    return edges.join(vertices.select(F.col("id").alias("src")), "src", "left_semi")
