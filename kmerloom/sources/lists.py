"""Lists of files as distributed tables: numbered lines, genome lists, download manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.paths import absolute, folder
from ..operators.checks import one_sided
from .tables import last_by_key, pairs_of_lines, read_tsv

FAILED = ("assembly_accession", "ftp_path", "genomic_fna_url", "error")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a text file, or of a folder's files in order of their names, from 1.

    Lines are numbered where they are read: by their place in their block of the file and the lines of the blocks
    before it.  Only the counts of blocks are gathered, one row each; lines are neither sorted nor shuffled.
    """
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("at")
    rows = spark.read.text(path).select("value", at, F.monotonically_increasing_id().alias("row"))
    blocks = rows.groupBy("at").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("at", (before - F.col("first") + 1).alias("shift"))
    return rows.join(F.broadcast(starts), "at").select((F.col("row") + F.col("shift")).alias("line_no"), "value")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair_idx, left, right) of a pair list, parsed and checked where its lines are read; pair_idx is the
    line, and an error names it."""
    return pairs_of_lines(numbered_lines(spark, path))


def sides(pairs: DataFrame) -> DataFrame:
    """(idx, path): every path of a pair list once."""
    both = pairs.select(F.col("left").alias("path")).union(pairs.select("right")).distinct()
    return both.select(F.lit(0).cast("long").alias("idx"), "path")


def read_genome_list(spark: SparkSession, path: str, existing: DataFrame | None = None, home: str = "") -> DataFrame:
    """(idx, name, path) of a list of genomes: blank lines and lines that start with # say nothing, relative
    paths start at the list's folder, ~ is ``home``.

    idx is the number of the line, comments counted, and name is local_ and idx in six digits; repeated
    paths keep a row each.  ``existing`` (path) is a listing: an entry that it lacks fails the query.
    """
    value = F.trim(F.regexp_replace("value", r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", ""))
    lines = numbered_lines(spark, path).withColumn("value", value).filter("value <> '' AND NOT startswith(value, '#')")
    rows = lines.select(F.col("line_no").alias("idx"), F.format_string("local_%06d", "line_no").alias("name"), absolute(F.col("value"), folder(path), home).alias("path"))
    if existing is None:
        return rows
    found = existing.select(absolute(F.col("path")).alias("path"), F.lit(True).alias("found")).distinct()
    checked = F.when(F.col("found"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("genome not found: "), "path")))
    return rows.join(found, "path", "left").select("idx", "name", checked.alias("path"))


def listing(spark: SparkSession, folder_path: str) -> DataFrame:
    """(path, length) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder_path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def download_manifest(spark: SparkSession, path: str, base: str = "", home: str = "") -> DataFrame:
    """The rows of a download manifest (TSV) with ``resolved``, the key by which files find theirs.
    Rows without a gzip_path go; of equal keys the last row of the file stays."""
    rows = read_tsv(spark, path)
    kept = rows.filter("gzip_path IS NOT NULL AND gzip_path <> ''").withColumns(
        {"resolved": absolute(F.col("gzip_path"), base or folder(path), home), "__at": F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())}
    )
    return last_by_key(kept, "resolved", "__at").drop("__at")


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (path) with the accession and address of their manifest rows; empty where there is none."""
    known = manifest.select("resolved", "assembly_accession", "genomic_fna_url")
    joined = files.withColumn("resolved", absolute(F.col("path"))).join(known, "resolved", "left").drop("resolved")
    return joined.fillna("", ["assembly_accession", "genomic_fna_url"])


def failed_assemblies(spark: SparkSession, path: str) -> DataFrame:
    """The four columns that describe a failure; columns that the file lacks are empty."""
    rows = read_tsv(spark, path)
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in FAILED])


def failures_against(failed: DataFrame, excluded: DataFrame) -> DataFrame:
    """(assembly_accession, side): failures that are not excluded (left) and exclusions that did not
    fail (right); a finished collection has none."""
    return one_sided(failed.select("assembly_accession"), excluded.select("assembly_accession"), "assembly_accession")
