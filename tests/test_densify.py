"""Densification of sparse registers and sketches of texts."""

import random
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kernels
from kmerloom.functions.packed import text_codes
from kmerloom.functions.sequences import translate_text
from kmerloom.operators import sketch
from kmerloom.params import EMPTY, MASK, SketchParams


def filled(n, f, seed=0):
    rng = np.random.default_rng([n, f, seed])
    reg = np.full(n, EMPTY, np.uint64)
    reg[rng.choice(n, f, replace=False)] = rng.integers(0, 1 << 62, f).astype(np.uint64)
    return reg


def one_by_one(reg, universal, every=1):
    """Each ``every``-th bucket by the rule: the first full one of its sequence."""
    (a, b), m = universal, (len(reg) - 1).bit_length()
    out = {}
    for i in range(0, len(reg), every):
        at, attempt = i, 0
        while reg[at] == EMPTY:
            attempt += 1
            at = ((((i << 32) ^ attempt) * a + b) & MASK) >> (64 - m)
        out[i] = int(reg[at])
    return out


@pytest.mark.parametrize("seed", [0, 7, MASK])
@pytest.mark.parametrize("n, f", [(2, 1), (16, 1), (16, 15), (1024, 3), (4096, 1), (4096, 15), (4096, 64), (4096, 65), (4096, 1000), (16_384, 40), (16_384, 300), (16_384, 6000)])
def test_each_bucket_finds_its_first_donor(n, f, seed):
    reg, p = filled(n, f, seed % 100), SketchParams(8192, 21, True, 0.9, "mix", seed=seed)
    got = kernels.densify(reg, p)
    want = one_by_one(reg, p.universal, max(1, n // 100))
    assert {i: int(got[i]) for i in want} == want and not (got == EMPTY).any()


def test_buckets_that_start_in_one_place_find_their_donors():
    """A factor whose low half is 1 puts all buckets into one cell of the circle; no table of cells is made then."""
    reg, p = filled(4096, 20), SimpleNamespace(universal=((0x9E3779B1 << 32) | 1, 12345))
    assert kernels._cells(4096, p.universal[0]) is None
    got = kernels.densify(reg, p)
    assert {i: int(got[i]) for i in range(0, 4096, 256)} == one_by_one(reg, p.universal, 256)


def test_few_full_buckets_cost_no_rounds_over_the_empty_ones():
    """One full bucket in 16,384 took four to five seconds, five took nearly one."""
    p = SketchParams(8192, 21, True, 0.9, "mix")
    kernels.densify(filled(16_384, 1), p)
    at = time.process_time()
    for f in (1, 2, 3, 5, 8, 1, 2, 3, 5, 8):
        assert len(np.unique(kernels.densify(filled(16_384, f), p))) == f
    assert time.process_time() - at < 5


@pytest.mark.parametrize("mode", ["value", "mix", "stripe"])
def test_sketches_of_texts_are_those_of_their_bases(spark, mode):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é中") for _ in range(n)) for n in (0, 1, 5, 10, 11, 40, 3000)] + [None, "a" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    p = SketchParams(8192, 21, True, 0.9, mode)
    plain = sketch.sketch_sequences(rows.select("id", F.array(translate_text(F.col("text"))).alias("segments")), p, keep_values=True)
    got = sketch.sketch_sequences(rows, p, segments_col="text", text=True, keep_values=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_hashes_refuse_other_characters():
    assert kernels.kmer_hashes(b"ACGTTGCA", 3, True).tolist() == kernels.kmer_hashes(np.array([0, 1, 2, 3, 3, 2, 1, 0], np.uint8), 3, True).tolist()
    assert text_codes(b"\x1b").tolist() == [1, 3]
    with pytest.raises(ValueError):
        kernels.kmer_hashes(b"ACGTNACGT", 3, True)
