"""Scratch tables in the cluster's shared folder.

Iterative jobs cut their lineage by writing each round as a Parquet table under
the folder named by ``spark.checkpoint.dir``.  Files on shared storage outlive
any executor, carry real sizes for adaptive planning, and superseded rounds can
be deleted as soon as the next one is complete.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the shared scratch folder.

    That is ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given; a local one is
    made only for local masters, and goes when Python ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = context._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _LOCAL_ROOTS:
            folder = tempfile.mkdtemp(prefix="citegraph-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL_ROOTS[context.applicationId] = folder
        root = _LOCAL_ROOTS[context.applicationId]
    return f"{root.rstrip('/')}/citegraph-{context.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that read them end with them."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._tables: dict[int, tuple[DataFrame, str]] = {}
        self._count = 0

    def new_path(self) -> str:
        self._count += 1
        return f"{self.folder}/{self._count:04d}"

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back."""
        return self._write(df)

    def save_observed(self, df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
        """Write ``df``; the metrics are gathered by the same job."""
        seen = Observation()
        observed = df.observe(seen, *[m.alias(k) for k, m in metrics.items()])
        return self._write(observed), seen.get

    def _write(self, df: DataFrame) -> DataFrame:
        path = self.new_path()
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._tables[id(table)] = (table, path)
        return table

    def write_by(self, df: DataFrame, key: str, tasks: int) -> str:
        """Write ``df`` with a folder ``key=value`` per value; the folder's URI, which tasks read by Arrow."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.new_path())
        df.repartition(tasks, key).write.partitionBy(key).parquet(path.toString())
        full = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
        scheme = {"s3a": "s3"}.get(full.getScheme(), full.getScheme())
        return f"{scheme}://{full.getAuthority() or ''}{full.getPath()}"

    def drop(self, table: DataFrame | None) -> None:
        """Delete a superseded table returned by ``save``."""
        if id(table) not in self._tables:
            return
        _, path = self._tables.pop(id(table))
        _delete(self.spark, path)


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Consecutive numbers 1..n in the given order, without a one-task sort.

    Rows are range-partitioned and sorted inside their partition; a second,
    partition-sized table holds the offsets, one row per partition.
    """
    placed = _placed(df, order)
    offsets = _offsets(placed, F.count(F.lit(1)))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within + 1)
        .drop("_place", "_part", "_offset")
    )


def running_total(df: DataFrame, order: list, amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over all rows up to and including each one, as above."""
    placed = _placed(df, order)
    offsets = _offsets(placed, F.sum(amount))
    so_far = Window.partitionBy("_part").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        placed.withColumn("_within", F.sum(amount).over(so_far))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_within"))
        .drop("_place", "_part", "_offset", "_within")
    )


def _placed(df: DataFrame, order: list) -> DataFrame:
    """Globally sorted rows with their partition, frozen in a scratch table."""
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = Scratch(df.sparkSession, "numbering").save(ranged.withColumn("_place", place))
    return table.withColumn("_part", F.shiftright("_place", 33))


def _offsets(placed: DataFrame, size) -> DataFrame:
    """Total size of all earlier partitions, for each partition."""
    sizes = placed.groupBy("_part").agg(size.alias("_size"))
    # One row per partition, never one per data row, so this window stays small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
