"""Keeps the manifest of a growing collection of sequence texts.

    python -m jobs.collection_manifest --input documents.parquet --output out [--config jobs/collection_manifest.json]

Before a collection is sketched its users need to know of every file whether it is usable, how
large it is, and whether its content is there already.  A file stream takes what the collection got since
the last run (``availableNow``; its checkpoint is ``<output>/checkpoint``) and adds to
``<output>/manifest``, partitioned by batch and status, a row for each text:

    doc_id, sha256, file_size (bytes), n_segments, bases (in ACGT runs), duplicate_of, batch, status

status is ``empty``, ``no_bases``, ``duplicate`` or ``ok``; duplicate_of is the id that had the content first:
of the earliest batch, then the smallest.  A batch writes its own folder as a whole and looks
at earlier batches only, so one that failed half-way is written again with the same rows.

Null texts count as empty.  Rows without an id are listed, are duplicates of any row with an id, and name no
original.  An id that comes again is a new row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.functions.sequences import segments
from kmerloom.operators.manifest import digests, status_totals
from kmerloom.session import small

from .common import log, main

DEFAULTS = {"id": "doc_id", "text": "text", "max_files": 1000}
ROWS = "doc_id long, sha256 string, file_size long, n_segments long, bases long, duplicate_of long, batch long, status string"


def read_manifest(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{output}/manifest").select("doc_id", "sha256", "file_size", "n_segments", "bases", "duplicate_of", "batch", "status")


def _glob(path: str) -> str:
    """A pattern that ``path`` alone matches: a stream takes a single file under a pattern only."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def described(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sha256, file_size, n_segments, bases) of each text."""
    texts = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = digests(texts.select("doc_id", F.col("t").cast("binary").alias("content"), segments(F.col("t")).alias("runs")))
    bases = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + F.length(r))
    return found.select("doc_id", "sha256", "file_size", F.size("runs").cast("long").alias("n_segments"), bases.alias("bases"))


def judged(new: DataFrame, known: DataFrame) -> DataFrame:
    """``new`` with duplicate_of and status; ``known`` are the manifest's earlier rows.

    Of the earlier rows only those with a content of the batch move.  Ids of a content are merged before
    the shuffle, and only contents that some other row has are joined back, so a content that a third of
    the rows share is one row of the smaller side."""
    now = new.groupBy("sha256").agg(F.min("doc_id").alias("here"), F.count("*").alias("n"))
    known = known.filter("status <> 'duplicate' AND doc_id IS NOT NULL").join(small(now.select("sha256")), "sha256", "left_semi")
    before = known.groupBy("sha256").agg(F.min(F.struct("batch", "doc_id")).alias("b")).select("sha256", F.col("b.doc_id").alias("there"))
    firsts = now.join(before, "sha256", "left").filter("n > 1 OR there IS NOT NULL").select("sha256", F.coalesce("there", "here").alias("first"), "there")
    of = F.when(F.col("there").isNotNull() | F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")), F.col("first"))
    rows = new.join(small(firsts), "sha256", "left").withColumn("duplicate_of", F.when(F.col("file_size") > 0, of))
    status = F.when(F.col("file_size") == 0, "empty").when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("bases") == 0, "no_bases").otherwise("ok")
    return rows.withColumn("status", status).select("doc_id", "sha256", "file_size", "n_segments", "bases", "duplicate_of", "status")


def run(spark: SparkSession, source: str, output: str, config: dict = DEFAULTS) -> DataFrame:
    """Takes what is new under ``source`` and returns the manifest."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files"]).parquet(_glob(source))

    def add(batch: DataFrame, number: int) -> None:
        at, own = f"{output}/manifest", batch.sparkSession
        new = described(batch, config["id"], config["text"]).persist()  # texts are read once
        empty = own.createDataFrame([], ROWS)
        known = own.read.schema(ROWS).parquet(at).filter(F.col("batch") < number) if number else empty
        judged(new, known).write.mode("overwrite").partitionBy("status").parquet(f"{at}/batch={number}")
        new.unpersist()
        for t in status_totals(read_manifest(own, output).filter(F.col("batch") == number)).collect():  # at most four rows
            log.info("batch %d of %s: %d texts %s, %d bytes, written to %s/batch=%d", number, source, t.n, t.status, t.bytes, at, number)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    done = read_manifest(spark, output)
    log.info("read %s, manifest at %s/manifest", source, output)
    return done


if __name__ == "__main__":
    main(run, DEFAULTS, None, ("input",), "collection manifest")
