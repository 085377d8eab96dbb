"""Packed k-mers, tiled joins, the stored index and densification against brute force."""

import random
import struct
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kernels, packed
from kmerloom.functions.sequences import translate_text
from kmerloom.operators import kmers, sketch
from kmerloom.params import SketchParams
from kmerloom.sources import kmer_index

PAIR = dict(zip("ACGT", "TGCA"))


def number(s):
    return int("".join(str("ACGT".index(c)) for c in s), 4)


def brute(seq, k):
    """Canonical numbers of the ACGT windows, in order."""
    out = []
    for i in range(len(seq) - k + 1 if k else 0):
        w = seq[i : i + k].upper()
        if set(w) <= set("ACGT"):
            out.append(min(number(w), number("".join(PAIR[c] for c in reversed(w)))))
    return out


def whole(high, low):
    return [(int(h) << 64 | int(x)) for h, x in zip(np.zeros(len(low), np.uint64) if high is None else high, low)]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 15, 16, 21, 30, 31, 32, 33, 40, 47, 63, 64])
def test_windows_equal_brute_force(k):
    rng = random.Random(k)
    for n in (0, 1, k - 1, k, k + 1, 200):
        for letters in ("ACGT", "acgtACGT", "ACGTN", "A", "T"):
            seq = "".join(rng.choice(letters) for _ in range(n))
            got = packed.canonical_windows(seq.encode(), k)
            assert whole(*got) == brute(seq, k)
            assert whole(*packed.distinct(*got)) == sorted(set(brute(seq, k)))


def test_longer_windows_are_refused():
    with pytest.raises(ValueError):
        kmers.packed_type(65)


@pytest.mark.parametrize("k", [7, 40])
def test_sets_of_pieces_are_those_of_the_sequence(spark, monkeypatch, k):
    monkeypatch.setattr(kmers, "PIECE", 10)
    rng = random.Random(k)
    rows = [(i, "".join(rng.choice("ACGTn") if rng.random() < 0.05 else rng.choice("ACGT") for _ in range(i * 11))) for i in range(12)] + [(12, None), (13, "")]
    seqs = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    value = (lambda r: r.kmer) if k <= 31 else (lambda r: (r.kmer.hi % 2**64) << 64 | r.kmer.lo % 2**64)
    want = sorted((i, x) for i, s in rows for x in set(brute(s or "", k)))
    for one in (True, False):
        assert sorted((r.id, value(r)) for r in kmers.packed_sets(seqs, k, whole=one).collect()) == want
    sized = kmers.packed_sets(seqs, k, whole=True, sizes=True).select("id", "n").distinct().collect()
    assert dict(map(tuple, sized)) == {i: len(set(brute(s or "", k))) for i, s in rows if brute(s or "", k)}


@pytest.mark.parametrize("k", [7, 31, 40])
def test_sets_among_few_kmers(spark, k):
    rng = random.Random(k)
    part = "".join(rng.choice("abcxyz") for _ in range(40))
    rows = [(i, "".join(rng.choice("abcxyz\u00e9") for _ in range(60)) + part * (i % 2)) for i in range(20)] + [(20, None), (21, ""), (22, "a")]
    texts = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    plain = texts.withColumn("seq", translate_text(F.col("seq")))
    asked = kmers.packed_sets(texts.filter("id = 1"), k, whole=True, text=True)
    every = kmers.packed_sets(plain, k, whole=True, sizes=True)
    assert sorted(map(str, kmers.packed_sets(texts, k, whole=True, sizes=True, text=True).collect())) == sorted(map(str, every.collect()))
    few = kmers.few_kmers(asked)
    want = sorted(map(str, every.join(asked.select("kmer"), "kmer", "left_semi").select("id", "kmer", "n").collect()))
    for table, text in ((texts, True), (plain, False)):
        got = kmers.packed_sets(table, k, whole=True, sizes=True, text=text, among=few)  # beyond k = 31 by their low words
        assert sorted(map(str, got.join(asked.select("kmer"), "kmer", "left_semi").select("id", "kmer", "n").collect())) == want
        assert k > 31 or got.count() == len(want)
    assert kmers.few_kmers(asked, 3) is None


def sets_with_hot(seed):
    rng = random.Random(seed)
    return {i: {0, *rng.sample(range(1, 400), rng.randrange(1, 12))} for i in range(120)}  # 0 is in every set


@pytest.mark.parametrize("tile", [5, 50, 2000])
def test_tiled_self_join_keeps_all_pairs(spark, tile):
    sets = sets_with_hot(tile)
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, kmer long").repartition(4)
    got = {(r.id1, r.id2): (r.inter, r.n1, r.n2) for r in kmers.jaccard_all_pairs(rows, tile=tile).collect()}
    assert got == {(i, j): (len(sets[i] & sets[j]), len(sets[i]), len(sets[j])) for i, j in combinations(sets, 2)}


def test_no_key_of_the_self_join_exceeds_its_bound(spark):
    """An element of every set: pairs of one join key stay near tile squared, not the square of the sets."""
    n, tile = 3000, 100
    rows = spark.range(n).select("id", F.lit(7).cast("long").alias("kmer"))
    dealt = kmers.tiles_of(rows, tile).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")))
    largest = dealt.groupBy("kmer", "own").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * tile
    assert kmers.shared_pairs(rows, tile=tile).count() == n * (n - 1) // 2


@pytest.mark.parametrize("tile", [7, 2000])
def test_bipartite_without_broadcast_keeps_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(kmers, "small", lambda df, rows=0: df)
    sets = sets_with_hot(3)
    rows = spark.createDataFrame([(i, x, len(s)) for i, s in sets.items() for x in s], "id long, kmer long, n long").repartition(4)
    q = rows.filter("id < 20").drop("n")
    for base in (rows, rows.drop("n")):
        got = {(r.query, r.db): (r.inter, r.n1, r.n2) for r in kmers.jaccard_bipartite(q, base, tile=tile, exclude=F.col("query") == F.col("db")).collect()}
        assert got == {(i, j): (len(sets[i] & sets[j]), len(sets[i]), len(sets[j])) for i in range(20) for j in sets if i != j}


def test_nearest_prefers_the_smaller_order(spark):
    pairs = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", "c", 0.2), ("p", "z", 0.0)], "query string, db string, jaccard double")
    assert sorted(map(tuple, kmers.nearest(pairs).collect())) == [("p", "z", 0.0), ("q", "a", 0.5)]


def test_records_have_the_stated_bytes(spark):
    made = kmer_index.to_records(spark.createDataFrame([(1, "ACGTTTGNACGT"), (2, "AC"), (3, None)], "id int, seq string"), 4).collect()
    want = sorted(set(brute("ACGTTTGNACGT", 4)))
    assert {r.id: (r.n, bytes(r.content)) for r in made} == {1: (len(want), b"".join(struct.pack(">QQ", 0, x) for x in want)), 2: (0, b""), 3: (0, b"")}
    seq = "TTGACCA" * 12
    (wide,) = kmer_index.to_records(spark.createDataFrame([(1, seq)], "id int, seq string"), 64).collect()
    assert bytes(wide.content) == b"".join(x.to_bytes(16, "big") for x in sorted(set(brute(seq, 64))))
    back = kmer_index.read_records(spark.createDataFrame([("f", wide.content)], "path string, content binary"), 64).collect()
    assert [(r.kmer.hi % 2**64) << 64 | r.kmer.lo % 2**64 for r in back] == sorted(set(brute(seq, 64)))


@pytest.mark.parametrize("k", [9, 40])
def test_index_appends_reopens_and_probes(spark, tmp_path, k):
    rng = random.Random(k)
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(60)) for i in range(30)}
    seqs[30], seqs[31] = seqs[3] + "ACCA", "A"
    frame = lambda ids: spark.createDataFrame([(i, seqs[i]) for i in ids], "id long, seq string")
    path = str(tmp_path / "index")
    index = kmer_index.create_index(spark, path, k, 4)
    kmer_index.append(index, frame(range(20)), 1)
    again = kmer_index.open_index(spark, path)
    for _ in range(2):  # a rerun replaces its batch
        kmer_index.append(again, frame(range(10, 32)), 2)
    assert {r.id: (r.n, r.batch) for r in again.sizes.collect()} == {i: (len(set(brute(s, k))), 1 if i < 20 else 2) for i, s in seqs.items()}
    probe = kmer_index.probe(kmer_index.open_index(spark, path), kmers.packed_sets(frame([3, 7, 25]), k, whole=True))
    sets = {i: set(brute(s, k)) for i, s in seqs.items()}
    assert {(r.query, r.db): (r.inter, r.n1, r.n2) for r in probe.collect()} == {
        (q, d): (len(sets[q] & sets[d]), len(sets[q]), len(sets[d])) for q in (3, 7, 25) for d in sets if sets[q] & sets[d]
    }
    plan = probe._jdf.queryExecution().sparkPlan().toString() + probe._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan" in line and again.postings[:13] in line]
    assert scan and all("Bucketed: true" in line for line in scan)
    assert "hashpartitioning(kmer" not in plan or ", 4)" in plan  # the queries go to the index's buckets
    again.close()


def test_densify_of_one_register_in_16384_buckets(spark):
    p = SketchParams(8192, 21, True, 0.875, "mix")
    n = 16384
    rows = [("one", 77, 5), ("two", 0, -9), ("two", 16383, 3)]
    minima = spark.createDataFrame(rows, "id string, bucket int, rank long")
    got = sketch.densify_minima(minima, p, n)
    assert got.groupBy("id").count().collect() == got.groupBy("id").agg(F.countDistinct("bucket").alias("count")).collect()
    for name in ("one", "two"):
        reg = np.full(n, kernels.EMPTY, np.uint64)
        for i, b, r in rows:
            if i == name:
                reg[b] = np.int64(r).view(np.uint64)
        want = kernels.densify(reg, p).view(np.int64).tolist()
        assert [r.rank for r in got.filter(F.col("id") == name).orderBy("bucket").collect()] == want


@pytest.mark.parametrize("k", [1, 9, 31, 40, 64])
def test_runs_hold_every_kmer_once(k):
    rng = random.Random(k)
    for letters in ("ACGT", "acgtACGTN", "A"):
        for n in (0, k - 1, k, 300, 1000):
            seq = "".join(rng.choice(letters) for _ in range(n))
            size, least, offsets, data = packed.runs((seq + seq[: n // 2]).encode(), k)
            run, high, low = packed.read_runs(offsets, data, k)
            want = sorted(set(brute(seq + seq[: n // 2], k)))
            assert size == len(want) and sorted(whole(high, low)) == want
            assert (packed.minimizers_of(high, low, k) == least[run]).all()


def test_index_takes_few_bytes_a_kmer_and_shuffles_none(spark, tmp_path):
    """A row for each k-mer took at least eight bytes, and all of them were shuffled."""
    from pathlib import Path

    rng = random.Random(5)
    seqs = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(20_000))) for i in range(8)], "id long, seq string").coalesce(2)
    index = kmer_index.create_index(spark, str(tmp_path / "index"), 31, 4)
    kmer_index.append(index, seqs, 1)
    n = index.sizes.agg(F.sum("n")).first()[0]
    files = list(Path(tmp_path / "index" / "postings").rglob("*.parquet"))
    assert n == 8 * 19_970 and sum(f.stat().st_size for f in files) < 3 * n
    assert len(files) > 4  # each task's own, none dealt
    index.close()


def test_kernels_hold_few_sketches_at_once(spark, monkeypatch):
    """Registers of every row of an Arrow batch (10,000 rows) were held: 128 KB a row at 16,384 buckets."""
    p = SketchParams(8192, 21, True, 0.9, "mix")
    rng = random.Random(9)
    rows = [(i, ["".join(rng.choice("ACGT") for _ in range(3000))] * (i % 3)) for i in range(40)] + [(40, None)]
    seqs = spark.createDataFrame(rows, "id long, segments array<string>").coalesce(1)
    assert sketch.rows_held(p.buckets + 128) * (p.buckets + 128) * 8 <= 1 << 21
    got = sketch.sketch_sequences(seqs, p, keep_values=True).orderBy("id").collect()
    regs = sketch.registers_of(seqs, p, p.buckets).orderBy("id").collect()
    assert [r.id for r in got] == [r.id for r in regs] == list(range(41))
    for i in (0, 1, 2, 14, 15, 16, 17, 39, 40):
        words, values, full = kernels.sketch([s.encode() for s in rows[i][1] or ()], p)
        assert got[i]["words"] == words.view(np.int64).tolist() and got[i]["values"] == regs[i]["values"] == values.view(np.int64).tolist() and got[i].nonempty == full
    run = {}
    monkeypatch.setattr(type(seqs), "mapInArrow", lambda self, f, schema: run.setdefault("f", f))
    sketch.sketch_sequences(seqs, p, keep_values=True)
    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "segments": [r[1] for r in rows]})
    held = [b.num_rows for b in run["f"](iter([batch]))]
    assert sum(held) == 41 and max(held) <= 16


def test_counts_leave_tasks_summed_up(spark, monkeypatch):
    """Every window was a row of strings; now a piece gives each k-mer once.  Sets and counts equal those of strings."""
    monkeypatch.setattr(kmers, "PIECE", 50)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACGTACGTNac") for _ in range(i * 5))) for i in range(20)] + [(20, "ACGT" * 20), (21, None), (22, ""), (23, "ACG\u00e9ACGTA"), (24, "T" * 70)]
    seqs = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    plan = kmers.count_kmers(seqs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    plain = {}
    for _, s in rows:
        for i in range(len(s or "") - 2):
            if set(w := s[i : i + 3]) <= set("ACGT"):
                w = min(w, "".join(PAIR[c] for c in reversed(w)))
                plain[w] = plain.get(w, 0) + 1
    assert {r.kmer: r.n for r in kmers.count_kmers(seqs, 3).collect()} == plain
    held = {w: sum(w in {min(s[i : i + 3], "".join(PAIR.get(c, "N") for c in reversed(s[i : i + 3]))) for i in range(len(s or "") - 2)} for _, s in rows) for w in plain}
    assert {r.kmer: r.n for r in kmers.count_kmers(seqs, 3, distinct=True).collect()} == held
    sizes = seqs.select("id", F.size(F.array_distinct(kmers.canonical_kmers(F.col("seq"), 3))).cast("long").alias("n"))
    assert sorted(map(tuple, kmers.whole_set_sizes(seqs, 3).collect()), key=str) == sorted(map(tuple, sizes.collect()), key=str)


def test_tasks_of_the_self_join_follow_its_pairs(spark, monkeypatch):
    """Their number was fixed, so the pairs of a task grew with the data."""
    monkeypatch.setattr(kmers, "PAIRS", 100)
    sets = sets_with_hot(1)
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, kmer long").repartition(4)
    made = sum(sum(x in s for s in sets.values()) ** 2 for x in range(400))
    assert kmers.pair_tasks(rows) == made // 100 + 1 > 100
    got = kmers.jaccard_all_pairs(rows)
    assert "hashpartitioning(kmer" in got._jdf.queryExecution().executedPlan().toString() and f", {made // 100 + 1})" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.id1, r.id2): r.inter for r in got.collect()} == {(i, j): len(sets[i] & sets[j]) for i, j in combinations(sets, 2)}
