"""Exact truth of a list of queries against a collection.

    python -m jobs.truth_tables --queries benchmark.parquet --collection documents.parquet --output out [--config jobs/truth_tables.json]

Estimates are judged by the exact Jaccard similarity of k-mer sets.  The job packs the k-mers of both tables, joins
them, and writes two tables of text with headers:

    <output>/pairs      query, db, inter, n1, n2, jaccard_true   in folders of ``block`` queries
    <output>/nearest    query, nn_true, jaccard_true             one row for each query

Both are in list order (by id), with ten decimals.  Pairs without a common k-mer are left out unless ``zeros``
is set; the nearest entry of a query that shares nothing is the first of the list, with 0.  Tables are written
as a whole, so a rerun replaces them with the same rows.  Ids are unique; null and short texts have no k-mers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.operators import truth
from kmerloom.operators.kmers import few_kmers, jaccard_bipartite, packed_sets
from kmerloom.session import spread

from .common import log, main

DEFAULTS = {"k": 31, "query_id": "item_id", "query_text": "text", "id": "doc_id", "text": "text", "block": 100, "zeros": False}
PAIRS = "query long, db long, inter long, n1 long, n2 long, jaccard_true string, block long"
NEAREST = "query long, nn_true long, jaccard_true string"


def _sequences(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(table).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("seq"))


def read_tables(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    tsv = spark.read.option("sep", "\t").option("header", True)
    return tsv.schema(PAIRS).csv(f"{output}/pairs"), tsv.schema(NEAREST).csv(f"{output}/nearest")


def run(spark: SparkSession, queries: str, collection: str, output: str, config: dict = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Writes both tables and returns them as read back."""
    k = config["k"]
    q = _sequences(spark.read.parquet(queries), config["query_id"], config["query_text"])
    d = _sequences(spark.read.parquet(collection), config["id"], config["text"])
    asked = packed_sets(q, k, whole=True, text=True)
    found = jaccard_bipartite(asked, packed_sets(d, k, whole=True, sizes=True, text=True, among=few_kmers(asked)))
    found.write.mode("overwrite").parquet(f"{output}/found")  # both tables are made of it
    found = spark.read.schema(found.schema).parquet(f"{output}/found")
    listed, base = (x.select("id", F.col("id").alias("place")) for x in (q, d))
    pairs = found
    if config["zeros"]:
        n = lambda x: x.select("id").join(packed_sets(x, k, whole=True, sizes=True, text=True).select("id", "n").distinct(), "id", "left").fillna(0, "n")
        pairs = truth.all_pairs(found, n(q), n(d))
    truth.write_pairs(truth.pair_text(pairs, listed, base), f"{output}/pairs", config["block"])
    truth.write_nearest(truth.nearest_listed(found, listed, base), f"{output}/nearest")
    got = read_tables(spark, output)
    log.info("read %s and %s", queries, collection)
    log.info("wrote %d pairs to %s/pairs and %d queries to %s/nearest", got[0].count(), output, got[1].count(), output)
    return got


if __name__ == "__main__":
    main(run, DEFAULTS, None, ("queries", "collection"), "truth tables")
