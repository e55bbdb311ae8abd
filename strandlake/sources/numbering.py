"""Numbers for the lines of files, without a task that sees them all.

Spark splits files into blocks, and a block's lines lie in one task, in order. So the lines
of each block are counted, the counts of the blocks before it are added up, and a line's number is that sum plus its
place in its block. Only the table of blocks is ordered as a whole; lines stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.lineage import few


def lines(spark: SparkSession, paths: list[str] | str, separator: str | None = None) -> DataFrame:
    """(file, block, value): lines (or pieces between separators) with the file and block that they begin in."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(paths).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "value")


def numbered(rows: DataFrame, name: str, per_file: bool = True) -> DataFrame:
    """Add the number of each row of ``lines``, from 0 in its file or in all files in order of their names.

    Rows may have been filtered or changed one by one, but not moved.
    """
    placed = rows.withColumn("__i", F.monotonically_increasing_id())
    counts = placed.groupBy("file", "block").agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    order = Window.partitionBy("file").orderBy("block") if per_file else Window.orderBy("file", "block")
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.select("file", "block", (before - F.col("__first")).alias("__shift"))  # a row a block
    return placed.join(few(blocks), ["file", "block"]).withColumn(name, (F.col("__i") + F.col("__shift")).cast("long")).drop("__i", "__shift")
