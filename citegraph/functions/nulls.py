"""Column expressions for NULL rules that differ from Spark's own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in_keep_null(column: str | Column, values: Iterable) -> Column:
    """``column NOT IN values``; a NULL is in no list, so it stays."""
    col = F.col(column) if isinstance(column, str) else column
    values = list(values)
    return col.isNull() | ~col.isin(values) if values else F.lit(True)


def sum_of(column: str, null_policy: str = "skip") -> Column:
    """Sum that skips NULL, or is NULL as soon as one member is."""
    return _policy(F.sum(column), column, null_policy)


def mean_of(column: str, null_policy: str = "skip", digits: int | None = None) -> Column:
    """Mean with the same policies; rounds halves to even when asked."""
    mean = _policy(F.avg(column), column, null_policy)
    return mean if digits is None else F.bround(mean, digits)


def _policy(aggregate: Column, column: str, null_policy: str) -> Column:
    if null_policy == "skip":
        return aggregate
    if null_policy == "propagate":
        return F.when(F.count(column) == F.count(F.lit(1)), aggregate)
    raise ValueError(f"unknown null policy {null_policy!r}")


def distinct_with_null(column: str) -> Column:
    """Number of different values where all NULLs together are one value."""
    any_null = F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
    return F.countDistinct(column) + any_null


def unite(*columns: str, sep: str = "_") -> Column:
    """Concatenation in which a missing value becomes the text NA."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])


def standardise(df: DataFrame, columns: dict[str, str], digits: int | None = None) -> DataFrame:
    """Add ``(x - mean) / sd`` over the whole table for each ``source: target``.

    Mean and sample deviation come from one scalar subquery; with no spread or
    a single row the score is NULL.
    """
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns],
        ).alias("moments")
    ).scalar()
    scored = df.withColumn("_moments", moments)
    for source, target in columns.items():
        z = F.try_divide(
            F.col(source) - F.col("_moments")[f"mean_{source}"],
            F.col("_moments")[f"sd_{source}"],
        )
        scored = scored.withColumn(target, z if digits is None else F.bround(z, digits))
    return scored.drop("_moments")
