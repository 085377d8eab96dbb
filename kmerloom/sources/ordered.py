"""Tables of text in a total order whose bytes do not depend on how the work was cut.

Rows are sorted by range over all tasks and written once; the place of a row is its place in its sorted file and
the rows of the files before it, so nothing is sorted in one task.  Files of a fixed number of rows are then
written by Spark, one each under its number.  Equal tables give equal bytes, gzip included (members have a fixed
header), whatever the number of tasks; the files in order of their numbers, put end to end, are the table.  The
output appears when the write job commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch

PLACE, FILE = "__place", "file"


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``__place``, their place from 0 in ``order``; rows equal in all of ``order`` are told
    apart by their other columns, and equal rows need not be."""
    spark = rows.sparkSession
    by = [*order, *(c for c in rows.columns if c not in order)]
    at = scratch(spark, "ordered")
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(at)
    stored = spark.read.schema(rows.schema).parquet(at)
    named = stored.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = named.groupBy("__file").agg(F.count("*").alias("__n"))  # a row for each file; their names sort as their ranges
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__file", before.alias("__before"))
    return named.join(F.broadcast(starts), "__file").withColumn(PLACE, F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


def write_ordered(rows: DataFrame, order: list[str], path: str, per_file: int = 1_000_000, compress: bool = True) -> None:
    """TSV with a header in folders ``file=0``, ``file=1``, ... of ``per_file`` rows each, in order."""
    placed = numbered(rows, order).withColumn(FILE, F.floor(F.col(PLACE) / per_file).cast("long"))
    dealt = placed.repartition(FILE).sortWithinPartitions(FILE, PLACE).drop(PLACE)
    writer = dealt.write.mode("overwrite").partitionBy(FILE).option("sep", "\t").option("header", True)
    writer.option("compression", "gzip" if compress else "none").csv(path)


def read_ordered(spark, path: str, schema: str) -> DataFrame:
    """The rows that `write_ordered` wrote, with the number of their file."""
    return spark.read.schema(f"{schema}, {FILE} long").option("sep", "\t").option("header", True).csv(path)
