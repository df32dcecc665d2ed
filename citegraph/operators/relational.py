"""Ranking, numbering and reshaping steps shared by the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph import fixed_values as fixed
from citegraph.scratch import running_total


def top_with_ties(df: DataFrame, by: list[str], score: str, n: int) -> DataFrame:
    """The n best rows of every group, ties at the border kept.

    The rank filter sits directly on the window, so Spark cuts each group down
    before the shuffle (window group limit).
    """
    best = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last())
    ranked = df.where(F.col(score).isNotNull()).withColumn("_rank", F.rank().over(best))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def top_numbered(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rk") -> DataFrame:
    """The first n rows of every group with their row number."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def with_group_totals(df: DataFrame, by: list[str], **totals) -> DataFrame:
    """Add group aggregates to every row.

    Aggregated first and joined back: a window would put a whole group, however
    large, into one task.
    """
    sums = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in totals.items()])
    return with_extent(df, sums, by)


def rows_at_group_max(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows holding the maximum of their group, ties kept."""
    return top_with_ties(df, [by], value, 1)


def grouped_median(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Exact median per group, however large the group.

    Equal values are counted first; one distributed sort over (group, value)
    with running counts then shows which value stands in the middle.  NULL
    values are skipped.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_total(counts, [*by, value], "_n", "_last")
    extent = ranked.groupBy(*by).agg(
        F.sum("_n").alias("_rows"), (F.max("_last") - F.sum("_n")).alias("_before")
    )
    placed = with_extent(ranked, extent, by)
    low = F.col("_before") + F.floor((F.col("_rows") + 1) / 2)
    high = F.col("_before") + F.floor(F.col("_rows") / 2) + 1
    first = F.col("_last") - F.col("_n") + 1

    def stands_at(position):
        return F.when((first <= position) & (position <= F.col("_last")), F.col(value))

    return placed.groupBy(*by).agg(
        ((F.max(stands_at(low)) + F.max(stands_at(high))) / 2).alias(out)
    )


def with_extent(rows: DataFrame, extent: DataFrame, by: list[str]) -> DataFrame:
    """Join group facts to rows; NULL is a group like any other."""
    same = F.lit(True)
    for column in by:
        same = same & F.col(f"_rows_.{column}").eqNullSafe(F.col(f"_facts_.{column}"))
    facts = [c for c in extent.columns if c not in by]
    return rows.alias("_rows_").join(extent.alias("_facts_"), same, "left").select(
        *[F.col(f"_rows_.{c}") for c in rows.columns], *[F.col(f"_facts_.{c}") for c in facts]
    )


def recode(df: DataFrame, column: str, mapping=None) -> DataFrame:
    """Replace listed values of one column, leave the others."""
    mapping = fixed.CLUSTER_RECODE if mapping is None else mapping
    return df.replace(dict(mapping), subset=[column])


def to_integer(df: DataFrame, column: str) -> DataFrame:
    """Cast ids to whole numbers; text that is no number becomes NULL."""
    return df.withColumn(column, F.col(column).try_cast("bigint"))


def value_flags(df: DataFrame, key: str, value: str, flags: dict[str, str]) -> DataFrame:
    """One row per key with a 0/1 column for each listed value."""
    return df.groupBy(key).agg(
        *[
            F.max(F.coalesce((F.col(value) == code).cast("int"), F.lit(0))).alias(name)
            for code, name in flags.items()
        ]
    )


def long_to_wide(df: DataFrame, key: str, name: str, value: str, names, prefix: str) -> DataFrame:
    """One column per listed name, from one pivot."""
    wide = df.groupBy(key).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))
    return wide.toDF(key, *[f"{prefix}{n}" for n in names])


def running_numbers(pairs: DataFrame, parent: str, local: str, out: str) -> DataFrame:
    """Global ids for local ids: each parent continues where the previous one ended.

    ``local`` counts 1..n inside each parent and ``parent`` counts 1..p, so the
    offset of a parent is a sum over parents only.  It is taken in two levels of
    blocks to keep every window bounded.
    """
    block = 1 << 15
    sizes = pairs.groupBy(parent).agg(F.max(local).alias("_size")).withColumn(
        "_block", F.floor((F.col(parent) - 1) / block)
    )
    inside = (
        Window.partitionBy("_block").orderBy(parent).rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = sizes.groupBy("_block").agg(F.sum("_size").alias("_block_size"))
    across = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "_block", F.coalesce(F.sum("_block_size").over(across), F.lit(0)).alias("_start")
    )
    offsets = (
        sizes.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .join(starts, "_block")
        .select(parent, (F.col("_inside") + F.col("_start")).alias("_offset"))
    )
    return (
        pairs.join(offsets, parent)
        .withColumn(out, F.col(local) + F.col("_offset"))
        .drop("_offset")
    )
