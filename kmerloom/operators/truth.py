"""Exact truth of query and collection lists as tables of text, in list order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .kmers import nearest


def fixed(value: Column, digits: int) -> Column:
    """A double with ``digits`` decimals, rounded from its exact binary value (halves to even), as C prints
    it; built-in formatting rounds the shortest decimal form instead."""

    @F.pandas_udf("string")
    def show(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f"{v:.{digits}f}", na_action="ignore")

    return show(value)


def all_pairs(found: DataFrame, queries: DataFrame, base: DataFrame, exclude: Column | None = None, block: int = 1_000) -> DataFrame:
    """``found`` (query, db, inter, n1, n2, jaccard) with a row for every other pair of ``queries`` and ``base``
    (id, n) too, Jaccard 0.  The result holds every pair by definition: queries are sent to each block of
    about ``block`` base entries, which are joined by its number."""
    blocks = max(1, base.count() // block)
    q = queries.select(F.col("id").alias("query"), F.col("n").alias("n1"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__b"))
    d = base.select(F.col("id").alias("db"), F.col("n").alias("n2"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("__b"))
    every = q.join(d, "__b").drop("__b")
    every = every if exclude is None else every.filter(~exclude)
    rows = every.join(found.select("query", "db", "inter", "jaccard"), ["query", "db"], "left")
    return rows.select("query", "db", F.coalesce("inter", F.lit(0)).alias("inter"), "n1", "n2", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def nearest_listed(found: DataFrame, queries: DataFrame, base: DataFrame) -> DataFrame:
    """(query, place, nn_true, jaccard): the nearest base entry of each listed query, ties to the first place in
    the list.  ``queries`` and ``base`` are (id, place).  A query that shares nothing has the first entry, with 0."""
    placed = found.join(base.select(F.col("id").alias("db"), F.col("place").alias("at")), "db")
    first = base.agg(F.min_by("id", "place").alias("first"))  # one row
    best = nearest(placed, "at")
    rows = queries.select(F.col("id").alias("query"), "place").join(best, "query", "left").join(F.broadcast(first))
    return rows.select("query", "place", F.coalesce("nn", "first").alias("nn_true"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def pair_text(pairs: DataFrame, queries: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of the pair table with the places of query and db, Jaccard with ten decimals."""
    placed = pairs.join(queries.select(F.col("id").alias("query"), F.col("place").alias("q_place")), "query").join(base.select(F.col("id").alias("db"), F.col("place").alias("d_place")), "db")
    return placed.select("q_place", "d_place", "query", "db", "inter", "n1", "n2", fixed(F.col("jaccard"), 10).alias("jaccard_true"))


def write_pairs(text: DataFrame, path: str, block: int = 100) -> None:
    """TSV with a header, in folders of ``block`` queries; the files of a folder, by name, are in list order."""
    rows = text.withColumn("block", F.floor(F.col("q_place") / block).cast("long"))
    dealt = rows.repartitionByRange("q_place", "d_place").sortWithinPartitions("block", "q_place", "d_place").drop("q_place", "d_place")
    dealt.write.mode("overwrite").partitionBy("block").option("sep", "\t").option("header", True).csv(path)


def write_nearest(rows: DataFrame, path: str) -> None:
    """TSV with a header in list order: query, nn_true, jaccard_true."""
    text = rows.repartitionByRange("place").sortWithinPartitions("place").select("query", "nn_true", fixed(F.col("jaccard"), 10).alias("jaccard_true"))
    text.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
