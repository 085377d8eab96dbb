"""Kernels and column expressions against definitions in whole numbers."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kmerloom.functions import kernels, u64
from kmerloom.functions.sequences import canonical_kmers, kmers, revcomp, translate_text, wrap_fasta
from kmerloom.operators import sketch
from kmerloom.operators.simulate import mutated_pair
from kmerloom.params import BASE_SEEDS, EMPTY, MASK, SketchParams, bucket_count, floor_pow2, mix64, signed, stream_seed

ROT = lambda x, r: ((x << (r % 64)) | (x >> (64 - r % 64))) & MASK if r % 64 else x
PAIR = dict(zip("ACGT", "TGCA"))


def slow_hash(kmer, canonical=True):
    k, f, r = len(kmer), 0, 0
    for i, b in enumerate(kmer):
        f ^= ROT(BASE_SEEDS[b], k - 1 - i)
        r ^= ROT(BASE_SEEDS[PAIR[b]], i)
    return min(f, r) if canonical else f


@given(st.text("ACGT", min_size=0, max_size=150), st.sampled_from([1, 5, 21, 31, 63, 64, 65, 100]), st.booleans())
@settings(max_examples=60, deadline=None)
def test_kmer_hashes(seq, k, canonical):
    want = [slow_hash(seq[i : i + k], canonical) for i in range(len(seq) - k + 1)]
    assert kernels.kmer_hashes(seq.encode(), k, canonical).tolist() == want


def test_mix_and_xxhash():
    import struct

    import xxhash

    xs = np.array([0, 1, 2**63, MASK, 12345], np.uint64)
    assert kernels.mix64(xs).tolist() == [mix64(int(x)) for x in xs]
    ys = np.arange(5, dtype=np.uint64)
    assert kernels.xxh64_pair(xs, ys, 99).tolist() == [xxhash.xxh64_intdigest(struct.pack("<QQ", int(x), int(y)), 99) for x, y in zip(xs, ys)]


def slow_sketch(seqs, p):
    m = (p.buckets - 1).bit_length()
    reg = [EMPTY] * p.buckets
    for s in seqs:
        for i in range(len(s) - p.k + 1):
            h = slow_hash(s[i : i + p.k], p.canonical)
            b, r = mix64(h ^ p.bucket_seed) >> (64 - m), mix64(h ^ p.rank_seed)
            reg[b] = min(reg[b], r if r != EMPTY else r - 1)
    if all(v == EMPTY for v in reg):
        return [0] * p.buckets
    a, c = p.universal
    out = []
    for i, v in enumerate(reg):
        t = 0
        while v == EMPTY:
            t += 1
            v = reg[((a * ((i << 32) ^ t) + c) & MASK) >> (64 - m)]
        out.append(v)
    return out


@pytest.mark.parametrize("mode,j0,seed", [("value", 0.5, 0), ("mix", 0.75, 0), ("stripe", 0.5, 7), ("stripe", 0.3, 0)])
def test_registers_and_words(mode, j0, seed):
    p = SketchParams(128, 11, True, j0, mode, seed)
    seqs = ["".join(random.Random(i).choice("ACGT") for _ in range(60)) for i in range(3)]
    words, values, full = kernels.sketch([s.encode() for s in seqs], p)
    want = slow_sketch(seqs, p)
    assert values.tolist() == want and 0 < full <= p.buckets
    flips = [0] * 128
    for i in kernels.positions(values, p).tolist():
        flips[int(i)] ^= 1
    assert words.tolist() == [sum(b << j for j, b in enumerate(flips[k : k + 64])) for k in (0, 64)]
    if mode == "stripe" and 128 // p.buckets >= 2:
        stride = 128 // p.buckets
        assert [int(x) // stride for x in kernels.positions(values, p)] == list(range(p.buckets))


def test_generator_goldens():
    """A seeded pair of 20,000 bases: filled buckets, differing bits, register agreement."""
    n, a, b = mutated_pair(2001, 20000, 10, 100)
    assert n == 85
    for bits, want in ((2048, (4096, 4067, 4063, 968, 0.6162109375)), (8192, (16384, 11522, 11531, 3968, 0.6087646484375))):
        p = SketchParams(bits, 64, True, 0.9, "mix")
        x, y = kernels.sketch([a.encode()], p), kernels.sketch([b.encode()], p)
        got = (p.buckets, x[2], y[2], int(np.bitwise_count(x[0] ^ y[0]).sum()), float(1 - (x[1] != y[1]).mean()))
        assert got == want


def test_properties():
    p = SketchParams(512, 21, True, 0.75, "mix")
    s = "".join(random.Random(1).choice("ACGT") for _ in range(300)).encode()
    back = s.translate(bytes.maketrans(b"ACGT", b"TGCA"))[::-1]
    assert (kernels.registers([s], p, 64) == kernels.registers([back], p, 64)).all()  # strands agree
    parts = [kernels.registers([s[:160]], p, 64), kernels.registers([s[140:]], p, 64)]
    assert (np.minimum(*parts) == kernels.registers([s], p, 64)).all()  # minima of overlapping parts merge
    assert (kernels.densify(np.full(8, EMPTY, np.uint64), p) == 0).all()


def test_params():
    assert [bucket_count(8192, j) for j in (0.5, 0.75, 0.9)] == [4096, 8192, 16384]
    assert [floor_pow2(x) for x in (0, 1, 3, 64)] == [1, 1, 2, 64]
    assert stream_seed(5, 0, 9) == 5 and stream_seed(5, 1, 9) == mix64(5 ^ mix64(1 ^ 9)) and signed(MASK) == -1
    for bad in ({"sketch_bits": 100}, {"j0": 1.0}, {"mode": "x"}, {"oph_buckets": 3}, {"seed": -1}, {"k": -1}):
        with pytest.raises(ValueError):
            SketchParams(**bad)


def test_columns(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, -1, -(2**63), 123456789)], "x long")
    with u64.wrapping(spark):
        got = rows.select("x", u64.mix64(F.col("x")).alias("m"), u64.rotl(F.col("x"), 13).alias("l"), u64.rotr(F.col("x"), 13).alias("r"), u64.umod(F.col("x"), 192).alias("d"), u64.rotl_by(F.col("x"), F.lit(77)).alias("b"))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    for r in got.collect():
        x = r.x & MASK
        assert (r.m & MASK, r.l & MASK, r.r & MASK, r.d, r.b & MASK) == (mix64(x), ROT(x, 13), ROT(x, 51), x % 192, ROT(x, 13))
    assert rows.select(u64.umin(F.col("x"))).first()[0] == 0


def test_sequence_columns(spark):
    seqs = ["", "ACG", "ACGTNacgtXé", "é" * 30, "A" * 300, None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
    got = rows.select("i", kmers(F.col("s"), 4).alias("k"), canonical_kmers(F.col("s"), 4).alias("c"), revcomp(F.col("s")).alias("r")).orderBy("i").collect()
    back = lambda x: "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c.upper(), "N") for c in reversed(x))
    for r, s in zip(got, seqs):
        want = [s[i : i + 4] for i in range(len(s) - 3)] if s else []
        assert (r.k or []) == want and (r.c or []) == [min(x, back(x), key=lambda y: y.encode()) for x in want]
        assert r.r == (back(s) if s is not None else None)
    text = rows.select(wrap_fasta(F.lit("h"), F.lit("ACGTA"), 2)).first()[0]
    assert text == ">h\nAC\nGT\nA\n"
    assert rows.select(translate_text(F.lit("A"))).first()[0] == "".join("ACGTACGTACGTACGT"[int(h, 16)] for h in "41")


def test_relational_form_equals_kernel(spark):
    p = SketchParams(128, 9, True, 0.5, "mix")
    seqs = [(i, "".join(random.Random(i).choice("ACGT") for _ in range(40 + i))) for i in range(5)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    from kmerloom.operators.kmers import explode_kmers

    dense = sketch.densify_minima(sketch.bucket_minima(sketch.hash_kmers(explode_kmers(df, 9), 9), p), p)
    packed = {r.id: r.words for r in sketch.pack_words(sketch.parity_words(dense, p), p).collect()}
    kernel = {r.id: r.words for r in sketch.sketch_sequences(df.select("id", F.array("seq").alias("segments")), p).collect()}
    assert packed == kernel
