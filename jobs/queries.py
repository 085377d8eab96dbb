"""The jobs as queries: each runs twice into one new folder, and its output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.plans.oracles import bipartite, sets, seqs
from kmerloom.session import scratch

from . import collection_manifest, truth_tables


def job1_collection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = scratch(spark, "job1")
    for _ in range(2):
        found = collection_manifest.run(spark, f"{sf_dir}/documents.parquet", output)
    return found


def job2_truth_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, and nearest entries as rows without counts."""
    output = scratch(spark, "job2")
    for _ in range(2):
        pairs, nearest = truth_tables.run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", output)
    best = nearest.select(F.lit("nearest").alias("kind"), "query", F.col("nn_true").alias("db"), "jaccard_true")
    return pairs.select(F.lit("pair").alias("kind"), "query", "db", "inter", "n1", "n2", "jaccard_true").unionByName(best, allowMissingColumns=True)


MANIFEST = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, sha256(t) AS sha256, octet_length(encode(t))::BIGINT AS file_size, regexp_extract_all(upper(regexp_replace(t, '[\x09-\x0D\x20]', '', 'g')), '[ACGT]+') AS runs FROM t),
f AS (SELECT *, len(runs)::BIGINT AS n_segments, length(array_to_string(runs, ''))::BIGINT AS bases, min(doc_id) OVER (PARTITION BY sha256) AS first FROM m)
SELECT doc_id, sha256, file_size, n_segments, bases, CASE WHEN file_size > 0 AND doc_id > first THEN first END AS duplicate_of, 0::BIGINT AS batch,
       CASE WHEN file_size = 0 THEN 'empty' WHEN doc_id > first THEN 'duplicate' WHEN bases = 0 THEN 'no_bases' ELSE 'ok' END AS status
FROM f"""

TRUTH = f"""
WITH p AS MATERIALIZED (SELECT query, db, inter, n1, n2, inter::DOUBLE / (n1 + n2 - inter) AS j FROM ({bipartite(sets(seqs(), 31), sets(seqs('documents'), 31))})),
b AS (SELECT query, arg_min(db, (-j, db)) AS db, max(j) AS j FROM p GROUP BY query)
SELECT 'pair' AS kind, query, db, inter, n1, n2, printf('%.10f', j) AS jaccard_true FROM p
UNION ALL SELECT 'nearest', item_id, coalesce(b.db, (SELECT min(doc_id) FROM documents)), NULL, NULL, NULL, printf('%.10f', coalesce(b.j, 0.0)) FROM benchmark LEFT JOIN b ON b.query = item_id"""


def queries() -> dict:
    return {f.__name__: f for f in (job1_collection_manifest, job2_truth_tables)}


def oracle_sql() -> dict[str, str]:
    return {"job1_collection_manifest": MANIFEST, "job2_truth_tables": TRUTH}
