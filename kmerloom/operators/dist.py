"""Joins of sketches: all-to-all by list position, bipartite, pair list, and evaluation.

All-to-all and bipartite comparisons have quadratically many *result* rows by definition.
They run block against block: sketches are packed into blocks of a fixed size, block pairs are
joined by key (each block is sent once per block of the other side, not once per row), and a
vectorised kernel compares one block pair at a time in bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..params import SketchParams
from .estimate import oph_estimate, stored_buckets, words_estimate
from .sketch import registers_of, sketch_sequences

BLOCK = 256


def indexed(sketches: DataFrame, order: str) -> DataFrame:
    """Adds idx, the position in ``order``.  The window runs over one key per sketch."""
    spark_order = sketches.select(order).distinct().withColumn("idx", F.row_number().over(Window.orderBy(order)) - 1)
    return sketches.join(spark_order, order)


def _blocks(sketches: DataFrame, size: int) -> DataFrame:
    b = F.floor(F.col("idx") / size).cast("long")
    return sketches.groupBy(b.alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "path", "words", "kbuckets"))).alias("rows"))


def _compare(left: list, right: list, p: SketchParams, triangle: bool) -> list[pa.Array]:
    import math

    a = np.array([r["words"] for r in left], np.int64).view(np.uint64)
    b = np.array([r["words"] for r in right], np.int64).view(np.uint64)
    if a.shape[1:] != b.shape[1:]:
        raise ValueError("sketch sizes differ")
    ia, ib = np.array([r["idx"] for r in left]), np.array([r["idx"] for r in right])
    i, j = np.nonzero(ia[:, None] < ib[None, :]) if triangle else map(np.ravel, np.indices((len(ia), len(ib))))
    ham = np.empty(len(i), np.int64)
    for at in range(0, len(i), 8192):
        ham[at : at + 8192] = np.bitwise_count(a[i[at : at + 8192]] ^ b[j[at : at + 8192]]).sum(axis=1, dtype=np.int64)
    n = a.shape[1] * 64
    ka, kb = np.array([r["kbuckets"] or 0 for r in left])[i], np.array([r["kbuckets"] or 0 for r in right])[j]
    k = np.where((ka > 0) & (kb > 0), np.minimum(ka, kb), np.maximum(ka, kb)).astype(float)
    k[k == 0] = 1 << (max(1, math.floor(max(1.0, n / (4 * (1 - p.j0))) + 0.5)).bit_length() - 1)
    raw = 1 + n / (4 * k) * np.log(np.maximum(1e-12, 1 - 2 * ham / n))
    names = lambda rows, x: pa.array([rows[y]["path"] for y in x], pa.string())
    return [names(left, i), names(right, j), pa.array(ia[i]), pa.array(ib[j]), pa.array(ham), pa.array(raw), pa.array(np.clip(raw, 0, 1)), pa.array(2 * ham >= n)]


DIST = "path1 string, path2 string, idx1 long, idx2 long, hamming long, raw double, jaccard double, clipped boolean"


def _kernel(p: SketchParams, triangle: bool):
    names = [c.split()[0] for c in DIST.split(", ")]

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(_compare(left, right, p, triangle), names=names)

    return run


def all_to_all(sketches: DataFrame, p: SketchParams, block: int = BLOCK) -> DataFrame:
    """DIST rows of all positions idx1 < idx2 of (idx, path, words, kbuckets) rows; repeated
    paths at different positions are compared too."""
    a = _blocks(sketches, block)
    left, right = a.select(F.col("block").alias("x"), F.col("rows").alias("l")), a.select(F.col("block").alias("y"), F.col("rows").alias("r"))
    last = a.agg(F.max("block").alias("last"))
    # every block meets itself and all later ones: the key is the later block
    sent = left.join(F.broadcast(last)).select("x", "l", F.explode(F.sequence("x", "last")).alias("y"))
    return sent.join(right, "y").select("l", "r").mapInArrow(_kernel(p, True), DIST)


def bipartite(queries: DataFrame, base: DataFrame, p: SketchParams, block: int = BLOCK) -> DataFrame:
    """DIST rows of every query with every base sketch, equal paths included."""
    left = _blocks(queries, block).select(F.col("rows").alias("l"))
    right = _blocks(base, block).select(F.col("block").alias("y"), F.col("rows").alias("r"))
    last = right.agg(F.max("y").alias("last"))
    sent = left.join(F.broadcast(last)).select("l", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("y"))
    return sent.join(right, "y").select("l", "r").mapInArrow(_kernel(p, False), DIST)


def pair_list(pairs: DataFrame, sketches: DataFrame, p: SketchParams) -> DataFrame:
    """(pair_idx, left, right, jaccard) of listed pairs; a pair without a sketch is an error."""
    s = sketches.select("path", "words", "kbuckets").dropDuplicates(["path"])
    side = lambda n: s.select(*[F.col(c).alias(f"{n}_{c}") for c in s.columns])
    got = pairs.join(side("l"), F.col("left") == F.col("l_path"), "left").join(side("r"), F.col("right") == F.col("r_path"), "left")
    missing = F.col("l_path").isNull() | F.col("r_path").isNull()
    checked = got.withColumn("l_words", F.when(missing, F.raise_error(F.concat(F.lit("no sketch for a path of pair "), F.col("pair_idx").cast("string"))).cast("array<long>")).otherwise(F.col("l_words")))
    est = words_estimate(F.col("l_words"), F.col("r_words"), stored_buckets(F.col("l_kbuckets"), F.col("r_kbuckets"), F.col("l_words"), p.j0))
    return checked.select("pair_idx", "left", "right", est["estimate"].alias("jaccard"))


def evaluate_pairs(pairs: DataFrame, seqs: DataFrame, p: SketchParams, id_col: str = "id", segments_col: str = "segments") -> DataFrame:
    """The 17 evaluation columns of listed pairs, and pair_idx.  Each sequence is sketched once."""
    full = sketch_sequences(seqs, p, id_col, segments_col, keep_values=True).withColumnRenamed(id_col, "id")
    if p.oph_buckets and p.oph_buckets != p.buckets:
        own = registers_of(seqs, p, p.oph_buckets, id_col, segments_col).select(F.col(id_col).alias("id"), F.col("values").alias("oph"), F.col("nonempty").alias("oph_full"))
        full = full.drop("values").join(own, "id")
    else:
        full = full.withColumnRenamed("values", "oph").withColumn("oph_full", F.col("nonempty"))
    side = lambda n: full.select(*[F.col(c).alias(f"{n}_{c}") for c in full.columns])
    got = pairs.join(side("l"), F.col("left") == F.col("l_id"), "left").join(side("r"), F.col("right") == F.col("r_id"), "left")
    odd = words_estimate(F.col("l_words"), F.col("r_words"), F.lit(p.buckets))
    got = got.withColumn("odd", odd).withColumn("oph", oph_estimate(F.col("l_oph"), F.col("r_oph")))
    m = p.oph_buckets or p.buckets
    long = lambda x: F.lit(x).cast("long")
    return got.select(
        "pair_idx", F.col("left").alias("file1"), F.col("right").alias("file2"),
        F.col("odd.estimate").alias("jaccard_odd"), F.col("oph.jaccard").alias("jaccard_oph"), F.col("odd.raw").alias("odd_raw_estimate"),
        F.col("odd.hamming").alias("hamming_distance"), long(p.sketch_bits).alias("sketch_bits"), long(p.buckets).alias("num_buckets"),
        F.col("oph.mismatches").alias("oph_mismatches"), (long(p.buckets) - F.col("l_nonempty")).alias("empty_buckets_left"), (long(p.buckets) - F.col("r_nonempty")).alias("empty_buckets_right"),
        long(m).alias("oph_num_buckets"), long(m * 64).alias("oph_storage_bits"), (long(m) - F.col("l_oph_full")).alias("oph_empty_buckets_left"),
        (long(m) - F.col("r_oph_full")).alias("oph_empty_buckets_right"), F.col("odd.clipped").cast("int").alias("clipped"), long(p.seed if p.seed < 1 << 63 else p.seed - (1 << 64)).alias("hash_seed"),
    )


def format_dist(dist: DataFrame) -> DataFrame:
    """path1, path2 and the estimate with six significant digits, without trailing zeros."""
    text = F.format_string("%.6g", F.col("jaccard"))
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    digits = F.when(F.col("jaccard") == 0, F.lit("0")).otherwise(short)
    return dist.select("path1", "path2", digits.alias("jaccard"))
