"""Seeded synthetic pairs of sequences, and experiment schedules."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ALPHABET = "ATGC"  # fixed value: the order in which bases are drawn
PAIRS = "pair_id int, file1 string, file2 string, mutation_count long, genome_length long, seq1 string, seq2 string"


def mutated_pair(seed: int, length: int, least: int, most: int) -> tuple[int, str, str]:
    """(mutations, sequence, mutated sequence) from one seeded stream: the number of mutations,
    the bases, the distinct places, and a shift of one to three letters for each place."""
    draw = random.Random(seed)
    n = draw.randint(least, most)
    first = [draw.randint(0, 3) for _ in range(length)]
    second = list(first)
    for at in draw.sample(range(length), min(n, length)) if n > 0 else ():
        second[at] = (second[at] + draw.randint(1, 3)) % 4
    return n, "".join(ALPHABET[i] for i in first), "".join(ALPHABET[i] for i in second)


def mutated(seq: str, draw: random.Random, n: int) -> str:
    """``seq`` with ``n`` distinct bases (all, if there are fewer) replaced by others."""
    out = list(seq)
    for at in draw.sample(range(len(out)), min(n, len(out))):
        out[at] = ALPHABET[(ALPHABET.index(out[at]) + draw.randint(1, 3)) % 4]
    return "".join(out)


def mutated_copies(seqs: DataFrame, least: int, most: int, seed_base: int, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """PAIRS rows of given ACGT sequences, each with a copy of ``least`` to ``most`` point mutations.  A pair
    depends on its sequence, its id and seed_base alone."""

    def run(batches):
        for b in batches:
            ids, first = b.column(0).to_pylist(), b.column(1).to_pylist()
            count, second = [], []
            for i, s in zip(ids, first):
                draw = random.Random(seed_base + i)
                count.append(min(len(s), draw.randint(least, most)))
                second.append(mutated(s, draw, count[-1]))
            names = [[f"{i}{x}.fna" for i in ids] for x in ("", "_mutated")]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [ids, *names, count, [len(s) for s in first], first, second]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in PAIRS.split(", ")])

    return seqs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(seq_col), F.lit("")).alias("seq")).mapInArrow(run, PAIRS)


def synthetic_pairs(spark: SparkSession, pairs: int, length: int, least: int, most: int, seed_base: int, partitions: int | None = None) -> DataFrame:
    """PAIRS rows; pair i depends on seed_base + i alone, so any task can make it again."""

    def run(batches):
        for b in batches:
            got = [(i, *mutated_pair(seed_base + i, length, least, most)) for i in b.column(0).to_pylist()]
            cols = [[g[0] for g in got], [f"genome1_{g[0]:03d}.fna" for g in got], [f"genome2_{g[0]:03d}.fna" for g in got], [g[1] for g in got], [length] * len(got), [g[2] for g in got], [g[3] for g in got]]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in PAIRS.split(", ")])

    return spark.range(1, pairs + 1, numPartitions=partitions).mapInArrow(run, PAIRS)


def schedule_of(replicates: DataFrame, ks: list[int], sizes: list[int], genome_base: int, genome_stride: int, hash_base: int, hash_stride: int = 1, first: int = 0) -> DataFrame:
    """(replicate, kmerlen, sketch_size, genome_seed, hash_seed) of every combination with the given
    ``replicates`` (replicate); seeds advance by their stride from replicate ``first`` on."""
    step = F.col("replicate") - first
    return (
        replicates.select("replicate", F.explode(F.array(*[F.lit(k) for k in ks])).alias("kmerlen"))
        .select("*", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("sketch_size"))
        .withColumn("genome_seed", F.lit(genome_base) + step * genome_stride).withColumn("hash_seed", F.lit(hash_base) + step * hash_stride)
    )


def schedule(spark: SparkSession, replicates: int, *settings, **named) -> DataFrame:
    """`schedule_of` the replicates 1 to ``replicates``."""
    return schedule_of(spark.range(1, replicates + 1).select(F.col("id").alias("replicate")), *settings, **named)


def generator_stats(pairs: DataFrame) -> DataFrame:
    """Smallest, largest and mean number of mutations and the upper median."""
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY mutation_count DESC)")
    return pairs.agg(F.min("mutation_count").alias("min"), F.max("mutation_count").alias("max"), F.avg("mutation_count").alias("mean"), upper.alias("median"))
