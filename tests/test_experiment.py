"""A small accuracy experiment end to end."""

import pytest
from pyspark.sql import functions as F

from kmerloom.plans import experiment as ex

SMALL = ex.Experiment(replicates=2, pairs=4, length=1500, least=1, most=4, ks=(21,), sizes=(1024, 2048), resamples=20)


def test_settings():
    e = ex.Experiment.load('{"pairs": 3, "ks": [21, 31]}', pairs=5, length=None)
    assert (e.pairs, e.ks, e.length) == (5, (21, 31), 2000)
    with pytest.raises(ValueError, match="nope"):
        ex.Experiment.load('{"nope": 1}')


def test_run_resumes_and_analyses(spark, tmp_path):
    store = str(tmp_path / "runs")
    rows = ex.run(spark, SMALL, store)
    first = sorted(map(str, rows.collect()))
    assert len(first) == 16 and sorted(map(str, ex.run(spark, SMALL, store).collect())) == first
    worst = rows.agg(F.max(F.abs(F.col("jaccard_odd") - F.col("jaccard_true")))).first()[0]
    assert worst < 0.1
    made = ex.analyse(rows, SMALL)
    assert made["pooled"].count() == 2 and made["coverage"].first().n_total == 16 and made["macro"].count() == 4
    for r in made["pooled"].collect():
        assert r.rmse1_low <= r.rmse1 <= r.rmse1_high < 0.2
    ex.save({"coverage": made["coverage"]}, str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / "coverage")).count() == 1


def test_run_log_and_folders(tmp_path):
    log = ex.RunLog(str(tmp_path / "log.tsv"))
    assert log.timed("step", "command", lambda: 7) == 7 and (tmp_path / "log.tsv").read_text().startswith("step\t0.")
    assert [ex.new_run_folder(str(tmp_path), "run").rsplit("/")[-1] for _ in range(3)] == ["run", "run_2", "run_3"]
