"""Manifests of downloaded files: addresses, integrity, provenance, totals."""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import basename, genomic_url


def with_urls(assemblies: DataFrame) -> DataFrame:
    """Adds genomic_fna_url and local_filename."""
    return assemblies.withColumn("genomic_fna_url", genomic_url(F.col("ftp_path"))).withColumn("local_filename", basename(F.col("genomic_fna_url")))


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds sha256 and file_size of a binary column."""
    return files.withColumn("sha256", F.sha2(content, 256)).withColumn("file_size", F.length(content).cast("long"))


def gzip_integrity(files: DataFrame) -> DataFrame:
    """(path, status, error, file_size, content_size, content_sha256) of (path, content) rows:
    status ok or invalid; content is inflated in pieces, never whole."""

    def one(raw: bytes) -> tuple[str, str | None, int | None, str | None]:
        import io

        digest, size = hashlib.sha256(), 0
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(raw)) as f:
                while piece := f.read(1 << 20):
                    digest.update(piece)
                    size += len(piece)
        except (OSError, EOFError, zlib.error) as e:
            return "invalid", type(e).__name__, None, None
        return "ok", None, size, digest.hexdigest()

    def run(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            got = [one(r) for r in raw]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
            s, e, n, h = (pa.array([g[i] for g in got], kinds[i]) for i in range(4))
            yield pa.RecordBatch.from_arrays([b.column(0), s, e, pa.array([len(r) for r in raw], pa.int64()), n, h], names=["path", "status", "error", "file_size", "content_size", "content_sha256"])

    return files.select("path", "content").mapInArrow(run, "path string, status string, error string, file_size long, content_size long, content_sha256 string")


def provenance(assemblies: DataFrame, downloads: DataFrame) -> DataFrame:
    """The five provenance columns: downloads joined with the summary by accession.  A download
    whose address differs from the summary's, or that the summary lacks, fails the query."""
    known = with_urls(assemblies).select("assembly_accession", "ftp_path", F.col("genomic_fna_url").alias("expected"))
    got = downloads.join(known, "assembly_accession", "left")
    wrong = F.col("expected").isNull() | (F.col("expected") != F.col("genomic_fna_url"))
    said = F.concat(F.lit("address differs from the summary: "), F.col("assembly_accession"))
    url: Column = F.when(wrong, F.raise_error(said)).otherwise(F.col("genomic_fna_url"))
    return got.select("assembly_accession", "ftp_path", url.alias("genomic_fna_url"), "local_filename", "file_size")


def status_totals(manifest: DataFrame, status: str = "status", size: str = "file_size") -> DataFrame:
    return manifest.groupBy(status).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def staged_links(inputs: DataFrame, folder: str) -> DataFrame:
    """(idx, path, alias): a collision-free name for each input."""
    return inputs.select("idx", "path", F.concat(F.lit(folder.rstrip("/") + "/"), F.lpad(F.col("idx").cast("string"), 8, "0"), F.lit("_"), basename(F.col("path"))).alias("alias"))
