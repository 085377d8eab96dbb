"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word is a maximal run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of texts handed to a kernel at once: as many rows as Arrow allows would hold 64 MB for each task, in the JVM and in Python.
TEXTS = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent a local session (tests) gets one of its own; a cluster
    session is refused, because a machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    spark.conf.set("spark.checkpoint.dir", "/tmp/checkpoints")
    return "/tmp/checkpoints"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage, survives lost executors and, unlike ``checkpoint()``, computes the
    last stage once.  The files stay until the folder is emptied, since results are lazy;
    `discard` removes those of a loop's earlier rounds.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    if (told := _recorder.get()) is not None:
        told.append(path)
    return out


_recorder: ContextVar[list[str] | None] = ContextVar("recorder", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that are materialized inside, for `remove` once nothing reads them."""
    paths: list[str] = []
    token = _recorder.set(paths)
    try:
        yield paths
    finally:
        _recorder.reset(token)


def remove(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    remove(df.sparkSession, df._written_at)


@contextmanager
def few_texts(spark: SparkSession) -> Iterator[None]:
    """What is executed inside hands TEXTS bytes at once to a kernel."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, TEXTS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Returns freed memory of a worker to the system, where the libraries can: idle workers keep it otherwise, beside
    whatever the executor does next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def attach(rows: DataFrame, values: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined with ``values``, a materialized table with one row for each ``key`` and the
    number ``n`` of rows that have it.

    Keys with more than a thousandth of these rows are broadcast, and fewer than a thousand keys
    can have that many; so no task gathers the rows of a frequent key."""
    total = values.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * 1000 > total
    hot = values.filter(often)
    if not hot.limit(1).count():
        return rows.join(values, key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.filter(~often), key)
    return rows.join(F.broadcast(hot), key).unionByName(others)
