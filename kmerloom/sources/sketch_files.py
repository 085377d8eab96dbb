"""Binary sketch files: a 32-byte header and 64-bit words, or words alone (legacy).

The primary store of sketches is Parquet; these functions exchange them with other tools.
"""

from __future__ import annotations

import struct
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

HEADER = "<4sIQQd"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"ODSK"  # fixed value of the file format
SKETCHES = "path string, words array<long>, nbits long, kbuckets long, j0 double"


def encode(words: list[int], nbits: int, kbuckets: int, j0: float) -> bytes:
    return struct.pack(HEADER, MAGIC, 1, nbits, kbuckets, j0) + struct.pack(f"<{len(words)}q", *words)


def decode(content: bytes, path: str = "") -> tuple[list[int], int, int, float]:
    """(words, nbits, kbuckets, j0).  Files without a valid header hold words alone: no bucket
    count, threshold 0.75.  Bodies that are empty or not whole words are errors."""
    kbuckets, nbits, j0, body = 0, 0, 0.75, content
    if len(content) >= HEADER_BYTES:
        magic, version, bits, buckets, threshold = struct.unpack_from(HEADER, content)
        if magic == MAGIC and version >= 1:
            nbits, kbuckets, body = bits, buckets, content[HEADER_BYTES :]
            j0 = threshold if 0.0 < threshold < 1.0 else 0.75
    if len(body) % 8 or (body is content and not body):
        raise ValueError(f"invalid sketch size: {path}")
    words = list(struct.unpack(f"<{len(body) // 8}q", body))
    return words, nbits or 64 * len(words), kbuckets, j0


def read_sketches(files: DataFrame) -> DataFrame:
    """SKETCHES of (path, content) rows."""

    def run(batches):
        for b in batches:
            got = [decode(c, p) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.float64())],
                names=["path", "words", "nbits", "kbuckets", "j0"],
            )

    return files.select("path", "content").mapInArrow(run, SKETCHES)


def to_files(sketches: DataFrame) -> DataFrame:
    """(path, content) of SKETCHES rows."""

    def run(batches):
        for b in batches:
            data = [encode(*x) for x in zip(*(b.column(i).to_pylist() for i in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["path", "content"])

    return sketches.select("path", "words", "nbits", "kbuckets", "j0").mapInArrow(run, "path string, content binary")


def write_files(sketches: DataFrame) -> None:
    """Write every sketch to its path; tasks write, so the folder must be shared."""

    def run(rows):
        for r in rows:
            target = Path(r.path)
            target.parent.mkdir(parents=True, exist_ok=True)
            temporary = target.with_name(target.name + ".tmp")
            temporary.write_bytes(bytes(r.content))
            temporary.replace(target)

    to_files(sketches).foreachPartition(run)


def intact(files: DataFrame, nbits: int, kbuckets: int, j0: float) -> DataFrame:
    """(path): the (path, content) rows that hold a whole sketch with these parameters."""
    head = HEADER, HEADER_BYTES, (MAGIC, nbits, kbuckets, j0)

    def run(batches):
        layout, size, (magic, *want) = head
        for b in batches:
            ok = []
            for c in b.column(1).to_pylist():
                good = len(c) == size + nbits // 8
                if good:
                    found, version, *rest = struct.unpack_from(layout, c)
                    good = found == magic and version >= 1 and rest == want
                ok.append(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_()))], names=["path"])

    return files.select("path", "content").mapInArrow(run, "path string")


def pending(outputs: DataFrame, folders: list[str], nbits: int, kbuckets: int, j0: float) -> DataFrame:
    """Rows whose ``output`` is not yet a whole sketch with these parameters in one of the ``folders``: a
    damaged one, or one of another size, is made again."""
    if not folders:
        return outputs
    files = outputs.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.sketch").load(folders).filter("length > 0")
    named = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content").join(outputs.select(F.col("output").alias("path")).distinct(), "path", "left_semi")
    return outputs.join(intact(named, nbits, kbuckets, j0).withColumnRenamed("path", "output"), "output", "left_anti")


def reject_duplicates(outputs: DataFrame) -> DataFrame:
    """(idx, output) rows unchanged; two inputs with one output fail the query with both numbers."""
    first = outputs.groupBy("output").agg(F.sort_array(F.collect_set("idx")).alias("__i"))
    said = F.concat(F.lit("duplicate output "), "output", F.lit(" (inputs "), (F.col("__i")[0] + 1).cast("string"), F.lit(" and "), (F.element_at("__i", 2) + 1).cast("string"), F.lit(")"))
    bad = first.withColumn("__ok", F.when(F.size("__i") > 1, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    return outputs.join(bad.filter("__ok").select("output"), "output", "left_semi").select(outputs.columns)


def duplicate_outputs(outputs: DataFrame) -> DataFrame:
    """(output, n, first_idx, second_idx): outputs that several inputs claim."""
    got = outputs.groupBy("output").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("idx")).alias("i")).filter("n > 1")
    return got.select("output", "n", F.col("i")[0].alias("first_idx"), F.col("i")[1].alias("second_idx"))
