"""Lists read in a distributed way, and sketches that are made only where they are missing."""

import io
import random

import pytest
from pyspark.sql import functions as F

from kmerloom import cli
from kmerloom.functions.paths import absolute
from kmerloom.sources import lists, sketch_files


def test_absolute_paths(spark):
    cases = {
        "a/b.fna": "/base/a/b.fna", "./a//b/../c": "/base/a/c", "/x/./y/": "/x/y", "../z": "/z", "../../../z": "/z", "~/g": "/home/u/g", "~": "/home/u", "~x/g": "/base/~x/g",
        "hdfs://host:9/a/../b": "hdfs://host:9/b", "file:/a//b": "file:/a/b", "": "/base",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select("p", absolute(F.col("p"), "/base", "/home/u").alias("a"))
    assert {r.p: r.a for r in rows.collect()} == cases
    assert spark.createDataFrame([(None,)], "p string").select(absolute(F.col("p"))).first()[0] is None


def test_lines_are_numbered_across_blocks_and_files(spark, tmp_path):
    rng = random.Random(1)
    want = [f"line {i} " + "x" * rng.randrange(80) for i in range(3000)]
    for k, at in enumerate(range(0, 3000, 1000)):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(want[at : at + 1000]) + "\n" * (k % 2))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        rows = lists.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 10
        assert [tuple(r) for r in rows.orderBy("line_no").collect()] == list(enumerate(want, 1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_genome_list(spark, tmp_path):
    (tmp_path / "g").mkdir()
    text = "# head\n\n  g/a.fna \n/abs/b.fna.gz\n\t#c\n../x/./g/a.fna\n~/h.fna\n"
    (tmp_path / "list").write_text(text)
    base = str(tmp_path)
    got = lists.read_genome_list(spark, f"{base}/list", home="/home/u").orderBy("idx").collect()
    up = base.rpartition("/")[0]
    assert [tuple(r) for r in got] == [(3, "local_000003", f"{base}/g/a.fna"), (4, "local_000004", "/abs/b.fna.gz"), (6, "local_000006", f"{up}/x/g/a.fna"), (7, "local_000007", "/home/u/h.fna")]
    there = spark.createDataFrame([(r.path,) for r in got] * 2, "path string")
    assert lists.read_genome_list(spark, f"{base}/list", there, "/home/u").count() == 4
    with pytest.raises(Exception, match="genome not found: /abs/b.fna.gz"):
        lists.read_genome_list(spark, f"{base}/list", there.filter("path NOT LIKE '/abs%'"), "/home/u").collect()
    (tmp_path / "g" / "a.fna").write_text(">a\nA\n")
    assert [tuple(r) for r in lists.listing(spark, f"{base}/g").collect()] == [(f"{base}/g/a.fna", 5)]


def test_download_manifest(spark, tmp_path):
    head = "assembly_accession\tgzip_path\tgenomic_fna_url\n"
    (tmp_path / "m.tsv").write_text(head + "A\tg/a.gz\tu1\nB\t\tu2\nC\tg/../g/a.gz\tu3\nD\t/d.gz\tu4\n")
    base = str(tmp_path)
    known = lists.download_manifest(spark, f"{base}/m.tsv")
    assert {r.resolved: r.assembly_accession for r in known.collect()} == {f"{base}/g/a.gz": "C", "/d.gz": "D"}
    files = spark.createDataFrame([(f"{base}/./g/a.gz",), ("/none.gz",)], "path string")
    assert sorted(map(tuple, lists.with_manifest(files, known).collect())) == sorted([(f"{base}/./g/a.gz", "C", "u3"), ("/none.gz", "", "")])
    (tmp_path / "f.tsv").write_text("assembly_accession\terror\nX\tbad\nY\t\n")
    failed = lists.failed_assemblies(spark, f"{base}/f.tsv")
    assert sorted(map(tuple, failed.collect())) == [("X", "", "", "bad"), ("Y", "", "", "")]
    excluded = spark.createDataFrame([("Y",), ("Z",)], "assembly_accession string")
    assert sorted(map(tuple, lists.failures_against(failed, excluded).collect())) == [("X", "left"), ("Z", "right")]


def test_pair_list_errors_name_the_line(spark, tmp_path):
    (tmp_path / "p").write_text("a\tb\n\nc\td\n")
    pairs = lists.read_pairs(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, pairs.collect())) == [(1, "a", "b"), (3, "c", "d")]
    assert sorted(r.path for r in lists.sides(pairs).collect()) == ["a", "b", "c", "d"]
    (tmp_path / "q").write_text("a\tb\n\nc\td\te\n")
    with pytest.raises(Exception, match="pair list line 3: expected"):
        lists.read_pairs(spark, str(tmp_path / "q")).collect()


def test_skip_existing_makes_what_is_missing_or_damaged(spark, tmp_path):
    rng = random.Random(2)
    paths = []
    for i in range(4):
        f = tmp_path / f"{i}.fna"
        f.write_text(">s\n" + "".join(rng.choice("ACGT") for _ in range(500)) + "\n")
        paths.append(str(f))
    out = tmp_path / "sk"
    (tmp_path / "in").write_text("\n".join(paths) + "\n")
    argv = ["sketch", "--input-paths", str(tmp_path / "in"), "--out-dir", str(out), "--kmer", "21", "--sketch-size", "1024", "--skip-existing"]
    run = lambda extra=(): cli.main([*argv, *extra], out=io.StringIO())
    assert run() == 0
    first = {p: p.read_bytes() for p in out.iterdir()}
    stamps = {p: p.stat().st_mtime_ns for p in out.iterdir()}
    assert len(first) == 4
    assert run() == 0 and {p: p.stat().st_mtime_ns for p in out.iterdir()} == stamps  # nothing to do
    damaged, gone = sorted(first)[:2]
    damaged.write_bytes(first[damaged][:-8])
    gone.unlink()
    (out / "other.sketch").write_bytes(b"kept")
    assert run() == 0
    assert {p: p.read_bytes() for p in first} == first and (out / "other.sketch").read_bytes() == b"kept"
    assert [p for p in first if p.stat().st_mtime_ns == stamps[p]] == [p for p in first if p not in (damaged, gone)]
    assert run(["--j0", "0.9"]) == 0  # other parameters: all are made again
    assert all(p.read_bytes() != first[p] for p in first)
    files = spark.createDataFrame([("a", first[gone]), ("b", b""), ("c", first[gone] + b"x")], "path string, content binary")
    assert [r.path for r in sketch_files.intact(files, 1024, 1024, 0.75).collect()] == ["a"]
