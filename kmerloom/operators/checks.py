"""Expectation checks: rows that break a rule, and a wrapper that fails on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


class CheckFailed(ValueError):
    pass


def require(violations: DataFrame, shown: int = 3) -> None:
    found = violations.take(shown)
    if found:
        raise CheckFailed("; ".join(f"{r.rule}: {r.detail}" for r in found))


def _rule(df: DataFrame, rule: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def observation_violations(rows: DataFrame, replicates: int, pairs: int, sizes: list[int], numeric: list[str], unit: list[str], payload: str | None = None) -> DataFrame:
    """(rule, detail) of everything wrong with an observation table, in one aggregate pass per
    kind: finite numbers, expected rows, unique keys, complete ids, ranges, payload sizes."""
    bad_number = reduce(lambda x, y: x | y, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in numeric])
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in ("replicate", "sketch_size", "pair_id")])
    groups = rows.groupBy("replicate", "sketch_size").agg(F.count("*").alias("n"), F.countDistinct("pair_id").alias("d"), F.min("pair_id").alias("lo"), F.max("pair_id").alias("hi"))
    out_of = reduce(lambda x, y: x | y, [~F.col(c).between(0.0, 1.0) for c in unit])
    every = replicates * pairs * len(sizes)
    parts = [
        _rule(rows.filter(bad_number), "finite", key),
        _rule(rows.agg(F.count("*").alias("n")).filter(F.col("n") != every), "rows", F.col("n")),
        _rule(rows.groupBy("replicate", "sketch_size", "pair_id").count().filter("count > 1"), "unique", key),
        _rule(groups.filter((F.col("n") != pairs) | (F.col("d") != pairs) | (F.col("lo") != 1) | (F.col("hi") != pairs)), "pairs", F.concat_ws("/", F.col("replicate").cast("string"), F.col("sketch_size").cast("string"))),
        _rule(rows.filter(~F.col("sketch_size").isin(sizes) | ~F.col("replicate").between(1, replicates)), "design", key),
        _rule(rows.filter(out_of), "range", key),
        _rule(rows.filter(~F.col("clipped").isin(0, 1)), "clipped", key),
    ]
    if payload:
        parts.append(_rule(rows.filter(F.col(payload) != F.col("sketch_size")), "payload", key))
    return reduce(DataFrame.unionByName, parts)


def truth_mismatches(rows: DataFrame, exact: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(rule, detail) where truth differs from the exact table, or ids are on one side only."""
    e = exact.select("pair_id", F.col("jaccard_true").alias("exact"))
    joined = rows.join(e, "pair_id", "full_outer")
    off = joined.filter(F.col("exact").isNull() | F.col("jaccard_true").isNull() | (F.abs(F.col("exact") - F.col("jaccard_true")) > tolerance))
    return _rule(off, "truth", F.col("pair_id"))


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def resumable(spark, path: str, check) -> DataFrame | None:
    """The Parquet table at ``path`` if it exists and ``check(df)`` finds no violations."""
    try:
        df = spark.read.parquet(path)
        require(check(df))
        return df
    except Exception as e:  # an absent or invalid intermediate is computed again
        if isinstance(e, CheckFailed) or "PATH_NOT_FOUND" in str(e) or "UNRESOLVED_COLUMN" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
