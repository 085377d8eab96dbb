"""Similarity estimates from sketches, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.u64 import popcount_xor
from ..params import SketchParams, bucket_count


def odd_estimate(hamming: Column, bits: Column, buckets: Column) -> Column:
    """STRUCT<hamming, raw, estimate, clipped> of differing bits of two sketches of ``bits``."""
    x = 1.0 - 2.0 * hamming / bits
    raw = 1.0 + bits / (4.0 * buckets) * F.ln(F.greatest(F.lit(1e-12), x))
    return F.struct(
        hamming.alias("hamming"), raw.alias("raw"), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)).alias("estimate"), (2 * hamming >= bits).alias("clipped")
    )


def words_estimate(a: Column, b: Column, buckets: Column) -> Column:
    """The estimate of two word arrays; sizes that differ, or nothing to compare, are errors."""
    bits = F.size(a) * 64
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (buckets > 0)
    hamming = F.when(fine, popcount_xor(a, b)).otherwise(F.raise_error(F.lit("sketch sizes differ or are empty")).cast("long"))
    return odd_estimate(hamming, bits.cast("double"), buckets.cast("double"))


def stored_buckets(ka: Column, kb: Column, words: Column, j0: float) -> Column:
    """Buckets of two stored sketches: the smaller count, the known one, or (none known) the
    count that ``j0`` implies for the size."""
    unknown = F.pow(F.lit(2.0), F.floor(F.log2(F.floor(F.greatest(F.lit(1.0), F.size(words) * 64 / (4.0 * (1.0 - j0))) + 0.5)) + 1e-12))
    return F.when((ka > 0) & (kb > 0), F.least(ka, kb)).when(ka > 0, ka).when(kb > 0, kb).otherwise(unknown).cast("long")


def oph_estimate(a: Column, b: Column) -> Column:
    """STRUCT<mismatches, jaccard> of two register arrays; 0 for empty arrays."""
    wrong = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda m: m)).cast("long")
    return F.struct(wrong.alias("mismatches"), F.when(F.size(a) > 0, 1.0 - wrong / F.size(a)).otherwise(F.lit(0.0)).alias("jaccard"))


def bbit_estimate(a: Column, b: Column, bits: int) -> Column:
    """b-bit MinHash: agreement of the low bits, corrected for chance."""
    mask = F.lit((1 << bits) - 1).cast("long")
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.bitwiseAND(mask) == y.bitwiseAND(mask)), lambda m: m)) / F.size(a)
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), (same - chance) / (1.0 - chance))


def default_buckets(p: SketchParams) -> Column:
    return F.lit(bucket_count(p.sketch_bits, p.j0))


def unpack(df: DataFrame, est: str = "est") -> DataFrame:
    """Spreads an estimate struct into columns."""
    rest = [c for c in df.columns if c != est]
    return df.select(*rest, f"{est}.hamming", f"{est}.raw", f"{est}.estimate", f"{est}.clipped")
