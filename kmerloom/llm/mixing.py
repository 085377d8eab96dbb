"""Mixing sources to target weights by systematic sampling.

Each source gets a target by water-filling.  A document of a source expects
``rate = target / source size`` copies; the expected copies are prefix-summed within the
source in order of (size, bucket, id), one random offset is added, and a document is emitted
once for each integer boundary that its interval crosses.  Sorting by size keeps the words
taken within about one document of the target.

Texts are read once, for their sizes.  The prefix sum is distributed: counts of (source, size,
bucket) are summed up in two windows over *counts* and joined back, so no task ever sorts a
whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, materialize

#: Hexadecimal digits of the digest of an id that name the bucket among the rows of one source and size,
#: and buckets for rows without an id.
DIGITS, WITHOUT = 3, 64


def unit_offset(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the seed and a key, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of (source, source_size) rows: ``min(weight * level, cap * size)`` with the level
    at which the targets add up to ``share`` of all sizes.  That level is where resharing the
    excess of capped sources ends.  Sorting by cap * size / weight makes it a prefix sum.

    The windows span the table of sources, one row each, never documents.
    """
    every = Window.partitionBy()
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("weight", pick.cast("long"))
        .withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("full")) / F.col("left"))
    )
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("cut", level).select(
        "source", "source_size", "weight",
        F.when(F.col("cut").isNull() | (F.col("ratio") < F.col("cut")), F.col("ceiling")).otherwise(F.col("cut") * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken, and the
    columns ``keep``.

    Size counts the words of the text; null text is size 0, a null source is a source of its
    own (ordered last), a null id sorts first.  A source of size 0 has target 0 and no copies.
    Rows that repeat id and text are sampled one by one; such rows, and rows without an id, differ
    in nothing that the result shows, so their order is free.  An empty table gives no rows; other
    columns are ignored.  ``copies`` is at most ``ceil(cap)``; reruns agree for one seed.
    """
    bucket = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, DIGITS), 16, 10).cast("long")
    rows = docs.select(
        *[F.col(c).alias(f"__keep_{c}") for c in keep], F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("bucket", F.coalesce(bucket, -1 - F.spark_partition_id() % WITHOUT)).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    rows = materialize(rows, "mix-sizes")
    counts = rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    upto = Window.unboundedPreceding
    in_size = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(upto, -1)
    in_source = Window.partitionBy("key").orderBy("size").rowsBetween(upto, -1)
    sizes = counts.groupBy("key", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    totals = sizes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(totals, weights, share, cap).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    sizes = sizes.select("key", "size", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("before_size")).join(targets.drop("source"), "key")
    offsets = counts.select("key", "size", "bucket", F.coalesce(F.sum("n").over(in_size), F.lit(0)).alias("before_bucket")).join(sizes, ["key", "size"])
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy(F.col("id").asc_nulls_first()))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    last = F.col("place") + F.col("before_bucket") + F.col("before_size")
    crossed = F.floor(last * F.col("rate") + F.col("offset")) - F.floor((last - 1) * F.col("rate") + F.col("offset"))
    return (
        rows.withColumn("place", place).join(offsets, ["key", "size", "bucket"])
        .withColumn("rate", rate).withColumn("offset", unit_offset(seed, F.col("key")))
        .withColumn("copies", crossed.cast("long"))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"__keep_{c}").alias(c) for c in keep])
    )
