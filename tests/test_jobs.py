"""The jobs over copies of small inputs: growth, reruns, and text output as it must be."""

import json
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import collection_manifest, queries as job_queries, truth_tables
from kmerloom.operators import truth

REPO = Path(__file__).resolve().parent.parent
SQL = job_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_job_agrees_with_sql(name, spark, data, same):
    same(job_queries.queries()[name](spark, data), SQL[name])


def put(spark, rows, folder, name):
    """A Parquet file of rows (doc_id, text) in a growing folder."""
    made = f"{folder}-{name}"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(made)
    os.makedirs(folder, exist_ok=True)
    (part,) = Path(made).glob("part-*.parquet")
    shutil.copy(part, f"{folder}/{name}.parquet")


def facts(df):
    return sorted((tuple(r) for r in df.select("doc_id", "file_size", "bases", "duplicate_of", "batch", "status").collect()), key=str)


def test_manifest_takes_only_what_is_new(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [(5, "ACGT"), (9, "ACGT"), (1, ""), (2, None), (3, "xyz"), (7, "AC GTn")], source, "a")
    first = facts(collection_manifest.run(spark, source, out))
    assert first == sorted([(5, 4, 4, None, 0, "ok"), (9, 4, 4, 5, 0, "duplicate"), (1, 0, 0, None, 0, "empty"), (2, 0, 0, None, 0, "empty"), (3, 3, 0, None, 0, "no_bases"), (7, 6, 4, None, 0, "ok")], key=str)
    written = {p: p.stat().st_mtime_ns for p in Path(out, "manifest").rglob("part-*")}
    assert facts(collection_manifest.run(spark, source, out)) == first  # nothing new
    assert {p: p.stat().st_mtime_ns for p in Path(out, "manifest").rglob("part-*")} == written
    put(spark, [(4, "ACGT"), (1, "TTT"), (8, "TTT"), (None, "TTT"), (None, "CCC"), (3, "xyz")], source, "b")
    second = facts(collection_manifest.run(spark, source, out))
    new = [(4, 4, 4, 5, 1, "duplicate"), (1, 3, 3, None, 1, "ok"), (8, 3, 3, 1, 1, "duplicate"), (None, 3, 3, 1, 1, "duplicate"), (None, 3, 3, None, 1, "ok"), (3, 3, 0, 3, 1, "duplicate")]
    assert second == sorted(first + new, key=str)
    assert all(written[p] == p.stat().st_mtime_ns for p in written)


def test_manifest_batch_is_written_again_after_a_failure(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [(i, "ACGT" * (i % 5)) for i in range(20)], source, "a")
    want = facts(collection_manifest.run(spark, source, out))
    put(spark, [(i, "ACGT" * (i % 7)) for i in range(20, 50)], source, "b")
    whole = collection_manifest.status_totals
    monkeypatch.setattr(collection_manifest, "status_totals", lambda df: 1 / 0)  # after the batch was written, before its commit
    with pytest.raises(Exception):
        collection_manifest.run(spark, source, out)
    monkeypatch.setattr(collection_manifest, "status_totals", whole)
    got = facts(collection_manifest.run(spark, source, out))
    assert len(got) == 50 and [r for r in got if r[4] == 0] == want
    fresh = facts(collection_manifest.run(spark, source, str(tmp_path / "other"), collection_manifest.DEFAULTS | {"max_files": 1}))
    assert len(fresh) == 50


def test_manifest_of_an_empty_table(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [], source, "a")
    assert facts(collection_manifest.run(spark, source, out)) == []
    put(spark, [(1, "A")], source, "b")
    assert [r[-1] for r in facts(collection_manifest.run(spark, source, out))] == ["ok"]


def test_fixed_rounds_the_exact_value(spark):
    values = [0.5, 1 / 3, 1 / 2048, 3 / 2048, 0.0, 1.0, 0.12345678905]
    got = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").coalesce(1).select(truth.fixed(F.col("v"), 10).alias("t")).collect()
    assert [r.t for r in got] == ["0.5000000000", "0.3333333333", "0.0004882812", "0.0014648438", "0.0000000000", "1.0000000000", f"{0.12345678905:.10f}", None]


def text_table(spark, rows, path, id_col):
    spark.createDataFrame(rows, f"{id_col} long, text string").repartition(3).write.parquet(path)
    return path


def lines(folder):
    return [x for p in sorted(Path(folder).rglob("part-*")) for x in p.read_text().splitlines()[1:]]


def kmer_sets(text, k):
    seq = "".join("ACGTACGTACGTACGT"["0123456789ABCDEF".index(c)] for c in (text or "").encode().hex().upper())
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return {min(seq[i : i + k], back[len(seq) - k - i : len(seq) - i]) for i in range(len(seq) - k + 1)}


@pytest.mark.parametrize("zeros", [False, True])
def test_truth_text_is_in_list_order(spark, tmp_path, zeros):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(12))
    shared = word()
    q = [(i, shared + word() if i % 2 else word()) for i in range(5)] + [(5, None), (6, "a")]
    d = [(10 + i, word() + shared if i % 3 else word()) for i in range(12)] + [(30, ""), (31, shared + "x"), (32, shared + "x")]
    a, b, out = text_table(spark, q, str(tmp_path / "q"), "item_id"), text_table(spark, d, str(tmp_path / "d"), "doc_id"), str(tmp_path / "out")
    config = truth_tables.DEFAULTS | {"k": 9, "block": 2, "zeros": zeros}
    for _ in range(2):
        pairs, nearest = truth_tables.run(spark, a, b, out, config)
    k = 9
    want, best = [], []
    for i, s in q:
        x = kmer_sets(s, k)
        top = None
        for j, t in d:
            y = kmer_sets(t, k)
            both, union = len(x & y), len(x | y)
            jac = both / union if union else 0.0
            if both or zeros:
                want.append(f"{i}\t{j}\t{both}\t{len(x)}\t{len(y)}\t{jac:.10f}")
            if top is None or jac > top[1]:
                top = (j, jac)
        best.append(f"{i}\t{top[0]}\t{top[1]:.10f}")
    assert lines(f"{out}/pairs") == want
    assert lines(f"{out}/nearest") == best
    assert pairs.count() == len(want) and nearest.count() == len(q)
    assert {p.name for p in Path(out, "pairs").glob("block=*")} == {f"block={int(w.split()[0]) // 2}" for w in want}


def test_truth_moves_only_kmers_of_the_queries(spark, tmp_path, monkeypatch):
    """Of a collection only what the queries share leaves its tasks."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    q = [(i, word(60)) for i in range(3)]
    d = [(i, word(400)) for i in range(50)] + [(60, q[0][1] + word(300))]
    a, b = text_table(spark, q, str(tmp_path / "q"), "item_id"), text_table(spark, d, str(tmp_path / "d"), "doc_id")
    moved, plain = [], truth_tables.jaccard_bipartite
    monkeypatch.setattr(truth_tables, "jaccard_bipartite", lambda x, y: moved.append(y.count()) or plain(x, y))
    pairs, _ = truth_tables.run(spark, a, b, str(tmp_path / "out"))
    assert [(r.query, r.db, r.inter, r.n2) for r in pairs.collect()] == [(0, 60, len(kmer_sets(q[0][1], 31)), len(kmer_sets(d[-1][1], 31)))]
    assert moved == [len(kmer_sets(q[0][1], 31))]


def test_a_shuffled_list_changes_only_ties(spark):
    found = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.5), (2, 8, 0.4), (2, 7, 0.1)], "query long, db long, jaccard double")
    asked = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, place long")
    nn = lambda order: {r.query: (r.nn_true, r.jaccard) for r in truth.nearest_listed(found, asked, spark.createDataFrame(order, "id long, place long")).collect()}
    assert nn([(7, 0), (8, 1), (9, 2)]) == {1: (7, 0.5), 2: (8, 0.4), 3: (7, 0.0)}
    assert nn([(9, 0), (8, 1), (7, 2)]) == {1: (8, 0.5), 2: (8, 0.4), 3: (9, 0.0)}


@pytest.mark.parametrize("job, inputs", [("collection_manifest", ["--input"]), ("truth_tables", ["--queries", "--collection"])])
def test_command_line(tmp_path, data, job, inputs):
    """With the shipped config and another one; the second run repeats the first."""
    tables = {"--input": "documents", "--queries": "benchmark", "--collection": "documents"}
    given = [x for name in inputs for x in (name, f"{data}/{tables[name]}.parquet")]
    for config in [str(REPO / "jobs" / f"{job}.json")] * 2:
        got = subprocess.run([sys.executable, "-m", f"jobs.{job}", *given, "--output", str(tmp_path / "out"), "--config", config], cwd=REPO, capture_output=True, text=True, timeout=300)
        assert got.returncode == 0, got.stderr[-2000:]
        assert "read " in got.stderr and "kmerloom.jobs" in got.stderr
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"kk": 1}))
    got = subprocess.run([sys.executable, "-m", f"jobs.{job}", *given, "--output", str(tmp_path / "o2"), "--config", str(bad)], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert got.returncode and "unknown settings: kk" in got.stderr


def test_jobs_do_not_need_the_training_operators():
    code = "import sys; sys.modules['kmerloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import jobs.queries"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO).returncode == 0
    for p in (REPO / "jobs").glob("*.py"):
        assert "llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
