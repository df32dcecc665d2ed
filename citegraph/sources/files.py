"""Tables in and out.  Schemas are passed in, never inferred."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_tsv(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """Tab-separated text with a header; see ``read_csv``."""
    return _delimited(spark, path, schema, "\t", **options)


def read_csv(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """Comma-separated text with a header.

    Files are read in parts.  With ``multi_line`` quoted cells may hold line breaks, but then
    every file is one task.  ``escaped_breaks`` undoes what the sinks do to line breaks.
    """
    return _delimited(spark, path, schema, ",", **options)


def _delimited(spark, path, schema, sep, multi_line: bool = False,
               escaped_breaks: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("sep", sep)
    rows = reader.option("multiLine", multi_line).option("escape", '"').csv(path)
    return _texts(rows, _unescaped) if escaped_breaks else rows


def _texts(df: DataFrame, change) -> DataFrame:
    return df.withColumns({c: change(F.col(c)) for c, kind in df.dtypes if kind == "string"})


#: What stands for a backslash while escapes are undone; it cannot occur in a cell of text.
_MARK = "\x00"


def _escaped(text):
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _unescaped(text):
    for written, plain in (("\\\\", _MARK), ("\\n", "\n"), ("\\r", "\r"), (_MARK, "\\")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def read_sheet(spark: SparkSession, workbook: str, sheet: str, schema) -> DataFrame:
    """One sheet of an unpacked workbook: a folder with one CSV table per sheet."""
    return read_csv(spark, f"{workbook}/{sheet}", schema)


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """A catalogue table, or a Parquet folder when the source is a path."""
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low, high,
              partitions: int) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions
    )


def keep_as_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """Replace a stored table by the result of a query, which may read that table.

    The new table is complete before the old one goes and its name is taken over.
    """
    spark = df.sparkSession
    made = f"{name}_{uuid.uuid4().hex}"
    df.write.option("path", path).saveAsTable(made)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {made} RENAME TO {name}")
    return spark.table(name)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated, with header, without row numbers; line breaks and backslashes in texts
    are written as escapes, so that every row is a line."""
    _write(df, path, ",")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, with header; otherwise as ``write_csv``."""
    _write(df, path, "\t")


def _write(df: DataFrame, path: str, sep: str) -> None:
    _texts(df, _escaped).write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
