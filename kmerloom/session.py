"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def session(app: str = "kmerloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; ``conf`` adds or replaces settings."""
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of few partitions over all cores, ahead of work that multiplies its rows.
    Tables with as many partitions as cores stay where they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``rows`` rows; else as it is, so that
    a join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
