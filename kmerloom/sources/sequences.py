"""Sequence files (FASTA, FASTQ-like, optionally gzip) as DataFrames.

Three readings of a sequence coexist: ``segments`` (for sketches: records and any character
outside ACGT break a segment, case is folded), ``concat`` (for exact truth: records are joined,
characters are kept) and the windows of ``concat`` that hold ACGT alone.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SEGMENTS = "path string, record_id int, header string, segment_id int, seq string"


def parse_lines(content: bytes) -> Iterator[tuple[int, str, int, str]]:
    """(record, header, segment, bases) of every maximal ACGT run.

    A line whose first visible character is > or @ starts a record; + hides the next visible
    line (qualities).  Blank lines do nothing.  White space inside a line is skipped.
    """
    record, header, segment, run, hidden = -1, "", 0, [], False
    table = {c: chr(c).upper() for c in b"ACGTacgt"}

    def flush():
        nonlocal segment
        if run:
            yield max(record, 0), header, segment, "".join(run)
            segment += 1
            run.clear()

    for raw in content.split(b"\n"):
        line = raw.decode("latin-1")
        visible = line.strip(" \t\v\f\r\n")
        if not visible:
            continue
        if hidden:
            hidden = False
            yield from flush()
        elif visible[0] in ">@":
            yield from flush()
            record, header, segment = record + 1, visible[1:], 0
        elif visible[0] == "+":
            yield from flush()
            hidden = True
        else:
            for c in line:
                base = table.get(ord(c))
                if base:
                    run.append(base)
                elif c not in " \t\v\f\r\n":
                    yield from flush()
    yield from flush()


def file_contents(spark: SparkSession, paths: DataFrame | list[str]) -> DataFrame:
    """(idx, path, content) of listed files, decompressed when the name ends in .gz.

    ``paths`` keeps its order and its repetitions.  A listed file that cannot be read fails the
    query, and so does a damaged gzip stream.
    """
    rows = paths if isinstance(paths, DataFrame) else spark.createDataFrame(list(enumerate(paths)), "idx long, path string")
    names = sorted({r.path for r in rows.select("path").distinct().toLocalIterator()})
    strip = lambda c: F.regexp_replace(c, "^file:/+", "/")
    empty = spark.createDataFrame([], "__uri string, raw binary")
    found = spark.read.format("binaryFile").load(names).select(strip(F.col("path")).alias("__uri"), F.col("content").alias("raw")) if names else empty

    def inflate(batches):
        for b in batches:
            data = [gzip.decompress(c) if p.endswith(".gz") else c for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["idx", "path", "content"])

    joined = rows.join(found, strip(F.col("path")) == F.col("__uri"), "left")
    joined = joined.withColumn("raw", F.when(F.col("raw").isNull(), F.raise_error(F.concat(F.lit("cannot open "), "path")).cast("binary")).otherwise(F.col("raw")))
    return joined.select("idx", "path", "raw").mapInArrow(inflate, "idx long, path string, content binary")


def read_segments(files: DataFrame) -> DataFrame:
    """SEGMENTS of (path, content) rows."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = list(parse_lines(content))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(got), pa.string()), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()),
                     pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.string())],
                    names=["path", "record_id", "header", "segment_id", "seq"],
                )

    return files.select("path", "content").mapInArrow(run, SEGMENTS)


def concat_records(files: DataFrame) -> DataFrame:
    """(path, seq): all lines but those that start with > joined as they are, less one trailing
    carriage return each."""
    lines = F.split(F.col("content").cast("string"), "\n", -1)
    kept = F.filter(F.transform(lines, lambda l: F.regexp_replace(l, "\r$", "")), lambda l: ~l.startswith(">"))
    return files.select("path", F.array_join(kept, "").alias("seq"))


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    """(header, seq) rows as FASTA text files in a folder."""
    from ..functions.sequences import wrap_fasta

    records.select(F.regexp_replace(wrap_fasta(F.col("header"), F.col("seq"), width), "\n$", "").alias("value")).write.mode("overwrite").text(path)
