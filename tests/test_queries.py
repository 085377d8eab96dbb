"""Every query with SQL agrees with it; the others run and have the stated shape."""

import pytest

from kmerloom.plans.oracles import oracle_sql
from kmerloom.plans.queries import queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(name, spark, data, same):
    same(queries()[name](spark, data), SQL[name])


def test_every_sql_has_a_query():
    assert SQL.keys() <= queries().keys()


def test_bootstrap_intervals_hold_the_estimate(spark, data):
    rows = queries()["bootstrap_ci"](spark, data).collect()
    assert len(rows) == 3
    for r in rows:
        assert r.rmse1_low <= r.rmse1 <= r.rmse1_high and r.difference_low <= r.difference_high


def test_document_sketches(spark, data):
    rows = queries()["sketch_documents"](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.num_buckets == 16384 and 0 <= r.ones <= 8192 for r in rows)


def test_synthetic_pairs_are_seeded(spark, data):
    one, two = (sorted(map(tuple, queries()["synthetic_pairs"](spark, data).collect())) for _ in range(2))
    n = spark.read.parquet(f"{data}/benchmark.parquet").count()
    assert one == two and len(one) == n and all(0 < r[4] < 1 for r in one)


def test_mutated_copies_differ_where_they_say(spark):
    from kmerloom.operators import simulate

    seqs = spark.createDataFrame([(i, "ACGT" * (i % 9)) for i in range(40)] + [(40, None)], "id long, seq string").repartition(3)
    rows = simulate.mutated_copies(seqs, 1, 12, 77).collect()
    assert len(rows) == 41 and {r.pair_id for r in rows} == set(range(41))
    for r in rows:
        assert len(r.seq1) == len(r.seq2) == r.genome_length and sum(x != y for x, y in zip(r.seq1, r.seq2)) == r.mutation_count <= 12
    assert sorted(map(tuple, rows)) == sorted(map(tuple, simulate.mutated_copies(seqs.coalesce(1), 1, 12, 77).collect()))
    assert len({r.mutation_count for r in rows if r.genome_length > 20}) > 3


def test_bin_intervals_follow_bins_with_rows(spark):
    """Seeds count bins that have rows; replicates without rows take no part."""
    import numpy as np

    from kmerloom.operators import metrics

    data = [(r, s, t, t + 0.01 * (r + k), t - 0.02 * r) for r in (1, 2, 3) for s in (64, 128) for k, t in enumerate((0.1, 0.15, 0.5, 0.95)) if not (r == 2 and t == 0.5)]
    rows = spark.createDataFrame([(*x, 0) for x in data], "replicate long, sketch_size int, jaccard_true double, jaccard_odd double, jaccard_base double, clipped int")
    got = {(r.sketch_size, r.bin_id): r for r in metrics.binned_with_intervals(rows, [0.2, 0.4, 0.6, 0.9], 30, 5).collect()}
    assert sorted(got) == [(s, b) for s in (64, 128) for b in (0, 2, 4)] and (got[64, 0].bin_lo, got[64, 4].bin_hi) == (0.0, 1.0)
    for g, (s, b) in enumerate(sorted(got)):
        mine = [x for x in data if x[1] == s and got[s, b].bin_lo <= x[2] < got[s, b].bin_hi]
        reps = sorted({x[0] for x in mine})
        n = np.array([sum(x[0] == r for x in mine) for r in reps])
        sse = np.array([sum((x[3] - x[2]) ** 2 for x in mine if x[0] == r) for r in reps])
        pick = np.random.default_rng(10_005 + g).integers(0, len(reps), size=(30, len(reps)))
        want = np.quantile(np.sqrt(sse[pick].sum(1) / n[pick].sum(1)), [0.025, 0.975])
        assert np.allclose([got[s, b].rmse1_low, got[s, b].rmse1_high], want) and got[s, b].replicates == len(reps)
    with pytest.raises(ValueError, match="cover"):
        metrics.binned_with_intervals(rows.withColumn("jaccard_true", rows.jaccard_true + 0.5), [0.2, 0.6], 5, 1)
    empty = metrics.binned_with_intervals(rows.limit(0), [0.2, 0.6], 5, 1)
    assert empty.count() == 0


@pytest.mark.parametrize("name", ["oph_registers_kernel", "odd_sketch_kernel", "oph_match_estimate", "bbit_estimate", "odd_estimate", "dist_all_to_all", "dist_bipartite", "dist_pairlist", "hamming_popcount", "eval_pairlist", "oph_densify"])
def test_sequences_without_kmers_are_compared(name, spark, data, tmp_path_factory):
    """Null, empty and short passages among others: zero sketches, as in the SQL."""
    import duckdb

    folder = tmp_path_factory.mktemp("bare")
    rows = spark.read.parquet(f"{data}/benchmark.parquet").limit(3).collect()
    texts = [rows[0].text, None, rows[1].text, "", "short", rows[2].text]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet/*.parquet'")
    want = c.execute(SQL[name]).df()
    got = queries()[name](spark, str(folder)).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(want)
    as_rows = lambda x: sorted(map(str, x[cols].astype(object).values.tolist()))
    assert as_rows(got) == as_rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_nearest_keeps_every_query(spark):
    from kmerloom.operators import kmers

    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5)], "query long, db long, jaccard double")
    got = kmers.nearest(pairs, queries=spark.createDataFrame([(1,), (4,)], "query long")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0.5), (4, None, 0.0)]
