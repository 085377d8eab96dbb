"""Pairs of sets from lists in blocks, against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import pairs
from kmerloom.operators import kmers


def test_numbers_survive_their_bytes():
    v = np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 35, (1 << 63) - 1, 1 << 63, (1 << 64) - 1], np.uint64)
    out, ends = pairs.to_bytes(v)
    assert np.array_equal(pairs.from_bytes(out.tobytes()), v) and ends[-1] == len(out) == 1 + 1 + 1 + 2 + 2 + 3 + 6 + 9 + 10 + 10
    assert len(pairs.from_bytes(b"")) == 0 == len(pairs.to_bytes(v[:0])[0])


@pytest.mark.parametrize("written, made, low", [(1 << 20, 1 << 22, -40), (7, 5, 0), (1, 1, -200)])
def test_lists_in_blocks_make_every_pair_once(monkeypatch, written, made, low):
    monkeypatch.setattr(pairs, "WRITTEN", written)
    monkeypatch.setattr(pairs, "MADE", made)
    rng = random.Random(written)
    some = lambda most: sorted(rng.sample(range(low, low + 60), rng.randrange(most)))
    lists = [(some(20), []) for _ in range(40)] + [([], [])]
    for _ in range(20):
        a = some(20)
        lists.append((a, [y for y in some(20) if y not in a]))
    want = Counter()
    for a, b in lists:
        want.update((min(x, y), max(x, y)) for x in a for y in b) if b else want.update(combinations(a, 2))
    flat = lambda i: (np.cumsum([0, *(len(x[i]) for x in lists)]), np.array([y for x in lists for y in x[i]], np.int64))
    a, b = flat(0), flat(1)
    bounds = np.array([low + 5, low + 6, low + 30])
    tallies = {}
    for block, at, heads, to, body in pairs.written(np.concatenate([a[1], b[1]]), pairs.dealt(a, b, bounds), low):
        for i, n in enumerate(block):
            for keys in pairs.made(heads[at[i] : at[i + 1]].tobytes(), body[to[i] : to[i + 1]].tobytes(), 60):
                assert (np.searchsorted(bounds, keys // 60 + low, "right") == n).all()
                tallies.setdefault(n, pairs.Tally()).add(keys)
    got = Counter()
    for t in tallies.values():
        got.update({(int(k) // 60 + low, int(k) % 60 + low): int(c) for k, c in zip(*t.merged())})
    assert got == want


@pytest.mark.parametrize("kind, name", [("long", lambda i: i * 3 - 60), ("long", lambda i: (i - 30) << 56), ("int", lambda i: i), ("string", lambda i: f"s{i}")])
@pytest.mark.parametrize("tile, sampled", [(2000, 1 << 40), (5, 1 << 40), (2000, 40)])
def test_pairs_are_counted_where_lists_meet(spark, monkeypatch, kind, name, tile, sampled):
    """A row for each pair of each element was shuffled: 3,652 MB of disk for 14 million rows."""
    monkeypatch.setattr(kmers, "PAIRS", 200)
    monkeypatch.setattr(kmers, "SAMPLED", sampled)
    rng = random.Random(8)
    sets = {name(i): {"0", *(str(rng.randrange(50)) for _ in range(rng.randrange(1, 9)))} for i in range(60)}
    rows = [(i, x) for i, s in sets.items() for x in s] + [(None, "1"), (name(7), None), (name(9), None)]
    table = spark.createDataFrame(rows + rows[:50], f"id {kind}, kmer string").repartition(3)
    got = kmers.jaccard_all_pairs(table, tile=tile, repeated=True)
    assert dict(got.dtypes)["id1"] == table.schema["id"].dataType.simpleString()
    exchanges = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not any("least" in line or "id2" in line for line in exchanges)
    n = {i: len(s) + (i in (name(7), name(9))) for i, s in sets.items()}
    want = {(min(i, j), max(i, j)): (len(sets[i] & sets[j]), n[min(i, j)], n[max(i, j)]) for i, j in combinations(sets, 2)}
    assert {(r.id1, r.id2): (r.inter, r.n1, r.n2) for r in got.collect()} == want


def test_no_sets_make_no_pairs(spark):
    none = spark.createDataFrame([], "id long, kmer long")
    assert kmers.jaccard_all_pairs(none).count() == kmers.shared_pairs(none.withColumn("id", F.col("id").cast("string"))).count() == 0
    assert kmers.shared_pairs(spark.createDataFrame([(1, None), (2, None)], "id long, kmer long")).count() == 0
