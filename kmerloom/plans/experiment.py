"""Accuracy experiments as one DataFrame job: seeded pairs, exact truth, estimates, errors.

A run is the cross product of replicates, k values and sketch sizes.  Pairs are made once per
replicate; truth is counted once per replicate and k; estimates once per combination.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.sequences import segments
from ..operators import checks, dist, kmers, metrics, simulate
from ..params import SketchParams
from ..sources import tables


@dataclass(frozen=True)
class Experiment:
    """Replicate r draws pair i from seed genome_base + (r - 1) * genome_stride + i and hashes
    with seed hash_base + r."""

    replicates: int = 2
    pairs: int = 10
    length: int = 2000
    least: int = 10
    most: int = 100
    ks: tuple[int, ...] = (21,)
    sizes: tuple[int, ...] = (1024,)
    j0: float = 0.9
    mode: str = "mix"
    bits: int = 4
    genome_base: int = 2000
    genome_stride: int = 100_000
    hash_base: int = 0
    edges: tuple[float, ...] = (0.0, 0.5, 0.9, 1.0)
    resamples: int = 200
    bootstrap_seed: int = 1

    @classmethod
    def load(cls, text: str, **overrides) -> Experiment:
        """From a JSON object; unknown names are errors, given overrides win."""
        raw = json.loads(text)
        known = {f.name for f in fields(cls)}
        if extra := sorted(set(raw) - known):
            raise ValueError(f"unknown settings: {', '.join(extra)}")
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
        return replace(cls(**values), **{k: v for k, v in overrides.items() if v is not None})

    def params(self, k: int, size: int, replicate: int) -> SketchParams:
        return SketchParams(size, k, True, self.j0, self.mode, self.hash_base + replicate)


def replicate_pairs(spark: SparkSession, e: Experiment, replicate: int) -> DataFrame:
    base = e.genome_base + (replicate - 1) * e.genome_stride
    return simulate.synthetic_pairs(spark, e.pairs, e.length, e.least, e.most, base)


def observe(pairs: DataFrame, e: Experiment, replicate: int, k: int, sizes: tuple[int, ...]) -> DataFrame:
    """One row per pair and sketch size: truth, both estimates and their side figures."""
    long = pairs.select(F.col("file1").alias("id"), F.col("seq1").alias("seq")).unionByName(pairs.select(F.col("file2").alias("id"), F.col("seq2").alias("seq")))
    truth = kmers.truth_rows(pairs.select("pair_id", "file1", "file2", "mutation_count", "genome_length"), kmers.packed_sets(long, k, whole=True))
    listed = pairs.select(F.col("pair_id").alias("pair_idx"), F.col("file1").alias("left"), F.col("file2").alias("right"))
    seqs = long.select("id", segments(F.col("seq")).alias("segments"))
    parts = []
    for size in sizes:
        got = dist.evaluate_pairs(listed, seqs, e.params(k, size, replicate)).withColumnRenamed("pair_idx", "pair_id").drop("file1", "file2")
        parts.append(got.withColumn("sketch_size", F.lit(size)))
    return (
        reduce(DataFrame.unionByName, parts).join(truth, "pair_id")
        .withColumn("replicate", F.lit(replicate).cast("long")).withColumn("kmerlen", F.lit(k)).withColumn("j0", F.lit(e.j0))
        .withColumn("genome_seed", F.lit(e.genome_base + (replicate - 1) * e.genome_stride))
    )


def run(spark: SparkSession, e: Experiment, store: str | None = None, source=None) -> DataFrame:
    """All observations of generated pairs, or of ``source(replicate)``, PAIRS rows made of given sequences.  With ``store`` every replicate is kept there as Parquet and reused if
    it is complete, so a run that was cut short goes on where it stopped."""
    parts = []
    for r in range(1, e.replicates + 1):
        path = f"{store}/replicate={r:03d}" if store else None
        complete = lambda df: checks.observation_violations(df.filter(F.col("kmerlen") == e.ks[0]).withColumn("replicate", F.lit(1)), 1, e.pairs, list(e.sizes), ["jaccard_true"], ["jaccard_true", "jaccard_odd"])
        kept = checks.resumable(spark, path, complete) if path else None
        if kept is None:
            pairs = source(r) if source else replicate_pairs(spark, e, r)
            kept = reduce(DataFrame.unionByName, [observe(pairs, e, r, k, e.sizes) for k in e.ks])
            if path:
                kept.write.mode("overwrite").parquet(path)
                kept = spark.read.parquet(path)
        parts.append(kept)
    return reduce(DataFrame.unionByName, parts)


def analyse(rows: DataFrame, e: Experiment) -> dict[str, DataFrame]:
    """The tables behind the usual figures: pooled errors with intervals, over all rows, at high
    similarity and per bin; macro errors of both methods; coverage of each k."""
    both = rows.withColumn("jaccard_base", F.col("jaccard_oph"))
    rated = metrics.empty_rates(both)
    high = both.filter(F.col("jaccard_true") >= F.col("j0"))
    macro = [metrics.macro_summary(rated, ["kmerlen", "sketch_size"], c, r).withColumn("method", F.lit(m)) for c, r, m in (("jaccard_odd", "empty_rate", "odd"), ("jaccard_oph", "oph_empty_rate", "oph"))]
    return {
        "pooled": metrics.pooled_with_intervals(both, ["sketch_size"], e.resamples, e.bootstrap_seed, 2),
        "pooled_high": metrics.pooled_with_intervals(high, ["sketch_size"], e.resamples, e.bootstrap_seed + 1, 2),
        "pooled_bins": metrics.binned_with_intervals(both, list(e.edges), e.resamples, e.bootstrap_seed),
        "macro": macro[0].unionByName(macro[1]),
        "difference": metrics.method_pivot(macro[0].unionByName(macro[1]), ["kmerlen", "sketch_size"], ("odd", "oph")),
        "coverage": metrics.coverage(rows),
    }


@dataclass
class RunLog:
    """Wall times of named steps and the commands behind them."""

    path: str | None = None
    rows: list[tuple[str, float, str]] = field(default_factory=list)

    def timed(self, name: str, command: str, work):
        at = time.perf_counter()
        out = work()
        self.rows.append((name, time.perf_counter() - at, command))
        if self.path:
            with Path(self.path).open("a") as f:
                f.write("\t".join((name, f"{self.rows[-1][1]:.6f}", command)) + "\n")
        return out


def new_run_folder(root: str, name: str) -> str:
    """``root/name``, or the first of ``name_2``, ``name_3``, ... that is free; created."""
    n = 1
    while True:
        target = Path(root) / (name if n == 1 else f"{name}_{n}")
        try:
            target.mkdir(parents=True)
            return str(target)
        except FileExistsError:
            n += 1


def save(tables_: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables_.items():
        tables.write_tsv(df, f"{folder}/{name}")
