"""Readers, writers, checks, manifests and the command line on small files."""

import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom import cli
from kmerloom.operators import checks, dist, estimate, manifest, metrics, simulate
from kmerloom.params import SketchParams
from kmerloom.sources import sequences, sketch_files, tables

CASES = {
    b"": [],
    b">a\nAC GT\r\n\nac\n>b\nGGNTT\n": [(0, "a", 0, "ACGTAC"), (1, "b", 0, "GG"), (1, "b", 1, "TT")],
    b"@r\nACGT\n+\n\n@@@@\nGG\n": [(0, "r", 0, "ACGT"), (0, "r", 1, "GG")],  # the blank line does not hide, the quality line does
    b"ACRYGT": [(0, "", 0, "AC"), (0, "", 1, "GT")],
}


@pytest.mark.parametrize("content", CASES)
def test_parse_lines(content):
    assert list(sequences.parse_lines(content)) == CASES[content]


def test_files(spark, tmp_path):
    plain, packed = tmp_path / "a.fna", tmp_path / "b.fna.gz"
    plain.write_bytes(b">a\nACGT\n")
    packed.write_bytes(gzip.compress(b">b\nGGNTT\n"))
    files = sequences.file_contents(spark, [str(plain), str(packed), str(plain)])
    assert sorted((r.idx, r.path) for r in files.collect()) == [(0, str(plain)), (1, str(packed)), (2, str(plain))]
    assert sorted((r.path, r.seq) for r in sequences.read_segments(files.filter("idx < 2")).collect()) == [(str(plain), "ACGT"), (str(packed), "GG"), (str(packed), "TT")]
    assert {r.path: r.seq for r in sequences.concat_records(files).collect()}[str(packed)] == "GGNTT"
    with pytest.raises(Exception, match="cannot open|PATH_NOT_FOUND|does not exist"):
        sequences.file_contents(spark, [str(tmp_path / "none")]).collect()
    sequences.write_fasta(spark.createDataFrame([("h", "ACGTA")], "header string, seq string"), str(tmp_path / "out"), 2)
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_pair_lists(spark, tmp_path):
    assert tables.parse_pairs("a\tb\n\nc\td") == [(0, "a", "b"), (1, "c", "d")]
    for bad in ("a", "a\tb\tc", "\tb", "a\t"):
        with pytest.raises(ValueError, match="line 2"):
            tables.parse_pairs("x\ty\n" + bad)
    lines = spark.createDataFrame([(1, "a\tb"), (2, "")], "line_no long, value string")
    assert tables.pairs_of_lines(lines).count() == 1
    with pytest.raises(Exception, match="pair list line 3"):
        tables.pairs_of_lines(spark.createDataFrame([(3, "a")], "line_no long, value string")).collect()
    info = tmp_path / "info.tsv"
    info.write_text("pair_id\tfile1\tfile2\tmutation_count\tgenome_length\n1\ta\tb\t3\t10\nbad\trow\n")
    assert [tuple(r) for r in tables.read_pair_info(spark, str(info)).collect()] == [(1, "a", "b", 3, 10)]


def test_sketch_files(spark):
    raw = sketch_files.encode([1, -1], 128, 64, 0.9)
    assert len(raw) == 48 and sketch_files.decode(raw) == ([1, -1], 128, 64, 0.9)
    assert sketch_files.decode(raw[32:]) == ([1, -1], 128, 0, 0.75)  # legacy
    assert sketch_files.decode(sketch_files.encode([1], 0, 4, 2.0)) == ([1], 64, 4, 0.75)
    for bad in (b"", b"123", raw + b"1"):
        with pytest.raises(ValueError):
            sketch_files.decode(bad)
    twice = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "idx long, output string")
    assert [tuple(r) for r in sketch_files.duplicate_outputs(twice).collect()] == [("x", 2, 0, 2)]
    with pytest.raises(Exception, match=r"inputs 1 and 3"):
        sketch_files.reject_duplicates(twice).collect()
    assert sketch_files.reject_duplicates(twice.filter("idx < 2")).count() == 2


def test_estimates(spark):
    rows = spark.createDataFrame([([0, 0], [0, 0]), ([0, 0], [-1, -1]), ([3, 0], [0, 0])], "a array<long>, b array<long>")
    got = [r.e for r in rows.select(estimate.words_estimate(F.col("a"), F.col("b"), F.lit(64)).alias("e")).collect()]
    assert [(r.hamming, r.estimate, r.clipped) for r in got[:2]] == [(0, 1.0, False), (128, 0.0, True)]
    assert abs(got[2].raw - (1 + 0.5 * np.log(1 - 4 / 128))) < 1e-12
    with pytest.raises(Exception, match="sizes differ"):
        rows.select(estimate.words_estimate(F.col("a"), F.array(F.lit(1).cast("long")), F.lit(64))).collect()
    k = rows.select(*[estimate.stored_buckets(F.lit(x), F.lit(y), F.col("a"), 0.75) for x, y in ((4, 8), (0, 8), (0, 0))]).first()
    assert tuple(k) == (4, 8, 128)
    text = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 1.0), ("a", "b", 0.0), ("a", "b", 0.99914400), ("a", "b", 1e-7), ("a", "b", 0.00012345678), ("a", "b", 1.25e-9)], "path1 string, path2 string, jaccard double")
    assert [r.jaccard for r in dist.format_dist(text).collect()] == ["0.5", "1", "0", "0.999144", "1e-07", "0.000123457", "1.25e-09"]


def test_metrics(spark):
    with pytest.raises(ValueError):
        metrics.parse_edges("0,0")
    assert metrics.effective_edges([0.2, 0.8], 0.1, 0.9) == [0.0, 0.2, 0.8, 1.0]
    with pytest.raises(ValueError):
        metrics.effective_edges([0.2, 0.8], 0.5, 1.2)
    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.5,)], "jaccard_true double")
    assert sorted(r.bin_id for r in metrics.with_bins(rows, [0.0, 0.5, 1.0]).collect()) == [0, 1, 1]
    with pytest.raises(Exception, match="outside all bins"):
        metrics.with_bins(rows, [0.0, 1.0], strict=True).collect()
    n, s = np.array([10, 20]), np.array([1.0, 2.0])
    want = np.sqrt(s[(p := np.random.default_rng(3).integers(0, 2, size=(50, 2)))].sum(1) / n[p].sum(1))
    assert metrics.bootstrap_pooled(n, s, s, 50, 3)["rmse1_low"] == float(np.quantile(want, 0.025))
    assert len(metrics.bootstrap_macro([np.ones((3, 3)), np.zeros((2, 3))], 10, 1)) == 2
    assert metrics.markdown_table(rows.limit(1), ["jaccard_true"]) == "|jaccard_true|\n|--:|\n|0|"
    stats = simulate.generator_stats(spark.createDataFrame([(1,), (2,), (3,), (4,)], "mutation_count long")).first()
    assert tuple(stats) == (1, 4, 2.5, 3)


def test_checks(spark):
    good = spark.createDataFrame([(1, 64, i, 0.5, 0) for i in (1, 2)], "replicate long, sketch_size int, pair_id long, jaccard_true double, clipped int")
    args = (1, 2, [64], ["jaccard_true"], ["jaccard_true"])
    checks.require(checks.observation_violations(good, *args))
    with pytest.raises(checks.CheckFailed):
        checks.require(checks.observation_violations(good.filter("pair_id = 1"), *args))
    with pytest.raises(checks.CheckFailed, match="truth"):
        checks.require(checks.truth_mismatches(good, good.withColumn("jaccard_true", F.lit(0.6))))
    assert checks.missing_columns(good, ["x", "pair_id"]) == ["x"]
    assert checks.resumable(spark, "/nonexistent/table", lambda df: df) is None


def test_manifest(spark):
    raw = gzip.compress(b"hello")
    files = spark.createDataFrame([("ok", raw), ("cut", raw[:-4]), ("not", b"x")], "path string, content binary")
    got = {r.path: r for r in manifest.gzip_integrity(files).collect()}
    assert (got["ok"].status, got["ok"].content_size) == ("ok", 5) and got["cut"].status == got["not"].status == "invalid"
    summary = spark.createDataFrame([("A", "ftp://h/x/")], "assembly_accession string, ftp_path string")
    good = spark.createDataFrame([("A", "https://h/x/x_genomic.fna.gz", "x_genomic.fna.gz", 3)], "assembly_accession string, genomic_fna_url string, local_filename string, file_size long")
    assert manifest.provenance(summary, good).count() == 1
    with pytest.raises(Exception, match="address differs"):
        manifest.provenance(summary, good.withColumn("genomic_fna_url", F.lit("other"))).collect()
    report = spark.createDataFrame([("a: b: c",), ("none",)], "value string")
    assert [tuple(r) for r in tables.parse_time_report(report).collect()] == [("a", "b: c")]
    assert [r[0] for r in spark.createDataFrame([("1/4",), ("0.5",), ("1/0",)], "x string").select(tables.parse_number_or_fraction(F.col("x"))).collect()] == [0.25, 0.5, None]
    assert tables.find_kmer_length('{"a": {"kmerlen": 5}, "kmerlen": 7}', "a") == 5


@pytest.mark.parametrize("argv", [["dist", "--qlist", "x"], ["eval"], ["sketch", "--seed=3"], ["dist", "--all-to-all", "--pairlist", "p"], ["sketch", "--nope"], ["sketch", "--kmer"], ["sketch", "--canonical", "maybe"], ["dist", "--out-dir", "x"], ["other"]])
def test_cli_rejects(argv):
    assert cli.main(argv, out=io.StringIO()) == 1


def test_cli_parse():
    r = cli.parse(["eval", "word", "--kmerlen=21", "--j-threshold", "0.9x", "--seed", "5", "--skip-existing=no", "--pos-mode=mix"])
    assert r.params() == SketchParams(8192, 21, True, 0.9, "mix", 5) and r.flags == {"skip-existing"}


def test_cli_sketches(spark, tmp_path):
    a, b = tmp_path / "a.fna", tmp_path / "b.fna"
    n, x, y = simulate.mutated_pair(2001, 20000, 10, 100)
    a.write_text(f">a\n{x}\n")
    b.write_text(f">b\n{y}\n")
    (tmp_path / "in").write_text(f"{a}\n{b}\n")
    (tmp_path / "pairs").write_text(f"{a}\t{b}\n")
    base = ["--kmer", "64", "--sketch-size", "2048", "--j0", "0.9", "--pos-mode", "mix"]
    out = io.StringIO()
    assert cli.main(["sketch", "--input-paths", str(tmp_path / "in"), "--out-dir", str(tmp_path / "sk"), *base], out=out) == 0
    names = out.getvalue().split()
    assert names == [str(tmp_path / "sk" / f"{x}.fna.sketch") for x in "ab"]
    out = io.StringIO()
    assert cli.main(["dist", "--all-to-all"], stdin=io.StringIO("\n".join(names)), out=out) == 0
    assert out.getvalue().split("\t")[-1].strip() == "0.636735"
    out = io.StringIO()
    assert cli.main(["eval", "--pairlist", str(tmp_path / "pairs"), *base], out=out) == 0
    head, row = (x.split("\t") for x in out.getvalue().strip().split("\n"))
    got = dict(zip(head, row))
    assert (got["hamming_distance"], got["jaccard_oph"]) == ("968", "0.6162109375") and float(got["jaccard_odd"]) == pytest.approx(0.636734985641962, abs=1e-12)
