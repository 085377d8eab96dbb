"""Registers and parity ("odd") sketches of sequences.

Two forms give the same values: a kernel per sequence (map-only, no shuffle; the default) and
a relational form over exploded k-mer hashes (the minimum is merged map-side), which splits a
sequence of any length over tasks and can be kept up to date by a stream.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import kernels, u64
from ..functions.packed import text_codes
from ..params import BASE_SEEDS, SketchParams

SKETCH = "num_buckets int, nonempty int, words array<long>"

#: Numbers of words and registers that a task holds before it gives them on.
HELD = 1 << 18


def rows_held(width: int) -> int:
    """Rows of ``width`` numbers each that are held at once."""
    return max(1, HELD // max(1, width))


def sketch_sequences(seqs: DataFrame, p: SketchParams, id_col: str = "id", segments_col: str = "segments", keep_values: bool = False, text: bool = False) -> DataFrame:
    """(id, num_buckets, nonempty, words[, values]) of rows with an array of ACGT segments.

    Sequences without a k-mer have zero registers; nonempty tells them apart.  ``text`` says that the column is text, whose bytes
    stand for two bases each (`translate_text`) and become codes in the kernel.
    """
    key = f"`{id_col}` {seqs.schema[id_col].dataType.simpleString()}"
    extra = ", values array<long>" if keep_values else ""

    def batch(ids: pa.Array, words: list[np.ndarray], values: list[np.ndarray], full: list[int]) -> pa.RecordBatch:
        n = len(full)
        flat = lambda x, width: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.concatenate(x)))
        cols = [ids, pa.array(np.full(n, p.buckets), pa.int32()), pa.array(full, pa.int32()), flat(words, p.sketch_bits // 64)]
        return pa.RecordBatch.from_arrays([*cols, *([flat(values, p.buckets)] if keep_values else [])], names=[id_col, "num_buckets", "nonempty", "words", *["values"] * keep_values])

    most = rows_held(p.sketch_bits // 64 + p.buckets * keep_values)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, most):
                words, values, full = [], [], []
                for segs in b.column(1).slice(at, most):
                    w, v, n = kernels.sketch([text_codes(segs.as_py() or b"")] if text else [s.encode() for s in segs.as_py() or ()], p)
                    words.append(w.view(np.int64))
                    if keep_values:  # they are the larger part
                        values.append(v.view(np.int64))
                    full.append(n)
                yield batch(b.column(0).slice(at, most), words, values, full)

    segments = F.col(segments_col)
    return seqs.select(id_col, segments.cast("binary") if text else segments).mapInArrow(run, f"{key}, {SKETCH}{extra}")


def registers_of(seqs: DataFrame, p: SketchParams, buckets: int, id_col: str = "id", segments_col: str = "segments") -> DataFrame:
    """(id, values, nonempty): densified registers with a bucket count of their own."""
    key = f"`{id_col}` {seqs.schema[id_col].dataType.simpleString()}"

    most = rows_held(buckets)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, most):
                regs = [kernels.registers([s.encode() for s in segs.as_py() or ()], p, buckets) for segs in b.column(1).slice(at, most)]
                full = [int((r != kernels.U(kernels.EMPTY)).sum()) for r in regs]
                flat = pa.array(np.concatenate([kernels.densify(r, p).view(np.int64) for r in regs]))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(regs) + 1) * buckets, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, most), values, pa.array(full, pa.int32())], names=[id_col, "values", "nonempty"])

    return seqs.select(id_col, segments_col).mapInArrow(run, f"{key}, values array<long>, nonempty int")


def hash_kmers(kmer_rows: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """Adds ``hash`` to rows with an ACGT ``kmer`` column: XOR of rotated base seeds, both strands."""
    seed = lambda c: F.when(c == "A", u64.const(BASE_SEEDS["A"])).when(c == "C", u64.const(BASE_SEEDS["C"])).when(c == "G", u64.const(BASE_SEEDS["G"])).otherwise(u64.const(BASE_SEEDS["T"]))
    other = lambda c: seed(F.translate(c, "ACGT", "TGCA"))
    base = lambda i: F.substring("kmer", i + 1, 1)
    fold = lambda terms: reduce(lambda x, y: x.bitwiseXOR(y), terms)
    forward = fold([u64.rotl(seed(base(i)), k - 1 - i) for i in range(k)])
    reverse = fold([u64.rotl(other(base(i)), i) for i in range(k)])
    return kmer_rows.withColumn("hash", u64.uleast(forward, reverse) if canonical else forward)


def bucket_minima(hashes: DataFrame, p: SketchParams, buckets: int | None = None, id_col: str = "id", hash_col: str = "hash") -> DataFrame:
    """(id, bucket, rank): the smallest rank of each bucket; empty buckets have no row.
    Repeated hashes change nothing, and minima of parts merge by minimum."""
    n = buckets or p.buckets
    with u64.wrapping(hashes.sparkSession):
        h = F.col(hash_col)
        rank = u64.mix64(h.bitwiseXOR(u64.const(p.rank_seed)))
        rows = hashes.select(
            id_col, u64.bucket_of(u64.mix64(h.bitwiseXOR(u64.const(p.bucket_seed))), n).alias("bucket"),
            F.when(rank == -1, F.lit(-2).cast("long")).otherwise(rank).alias("rank"),
        )
        return rows.groupBy(id_col, "bucket").agg(u64.umin(F.col("rank")).alias("rank"))


def nonempty_counts(minima: DataFrame, id_col: str = "id") -> DataFrame:
    return minima.groupBy(id_col).agg(F.count("*").alias("nonempty"))


def densify_minima(minima: DataFrame, p: SketchParams, buckets: int | None = None, id_col: str = "id") -> DataFrame:
    """(id, bucket, rank) for every bucket: empty ones take their first non-empty donor.

    The rows of one sequence, at most one a bucket, meet in one task.  There rounds go over the
    buckets that are still empty, one attempt each, until none is left: the donors of a bucket visit
    every bucket in the end, so one register is enough and no number of attempts is too many.
    Sequences without a register have no row.
    """
    n = buckets or p.buckets
    key = f"`{id_col}` {minima.schema[id_col].dataType.simpleString()}"

    def fill(t: pa.Table) -> pa.Table:
        reg = np.full(n, kernels.EMPTY, np.uint64)
        reg[t.column("bucket").to_numpy()] = t.column("rank").to_numpy().view(np.uint64)
        ids = t.column(id_col).combine_chunks().slice(0, 1).take(pa.array(np.zeros(n, np.int32)))
        return pa.table([ids, pa.array(np.arange(n, dtype=np.int32)), pa.array(kernels.densify(reg, p).view(np.int64))], names=[id_col, "bucket", "rank"])

    return minima.select(id_col, "bucket", "rank").groupBy(id_col).applyInArrow(fill, f"{key}, bucket int, rank long")


def bit_positions(values: DataFrame, p: SketchParams, buckets: int | None = None) -> DataFrame:
    """Adds ``position`` to (bucket, rank) rows."""
    with u64.wrapping(values.sparkSession):
        return values.withColumn("position", u64.bit_position(F.col("bucket"), F.col("rank"), p.sketch_bits, buckets or p.buckets, p.mode, p.position_seed))


def parity_words(values: DataFrame, p: SketchParams, buckets: int | None = None, id_col: str = "id") -> DataFrame:
    """(id, word, bits): XOR of the flipped bits; words without a flip have no row."""
    at = F.col("position")
    rows = bit_positions(values, p, buckets).select(id_col, F.floor(at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    return rows.groupBy(id_col, "word").agg(F.bit_xor("bit").alias("bits"))


def pack_words(words: DataFrame, p: SketchParams, id_col: str = "id") -> DataFrame:
    """(id, words): dense arrays of the sparse (id, word, bits) rows."""
    m = words.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return m.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(p.sketch_bits // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))
