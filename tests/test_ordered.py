"""Ordered output: the same bytes from any number of tasks."""

import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kmerloom.sources import ordered


def whole(folder):
    files = sorted(Path(folder).glob("file=*/part-*"), key=lambda p: int(p.parent.name.split("=")[1]))
    assert len(files) == len(list(Path(folder).glob("file=*")))  # one file each
    return b"".join(p.read_bytes() for p in files), files


@pytest.mark.parametrize("compress", [True, False])
def test_bytes_do_not_depend_on_tasks(spark, tmp_path, compress):
    rows = [(i * 7919 % 501 // 3, f"n{i % 11}", i / 7) for i in range(500)] + [(5, None, 1.0), (None, "x", 2.0), (5, "same", 0.5), (5, "same", 0.5)]
    df = spark.createDataFrame(rows, "k long, s string, v double")
    made = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for i, tasks in enumerate((1, 3, 13)):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            out = str(tmp_path / str(i))
            for _ in range(2 if i == 0 else 1):  # a rerun replaces it
                ordered.write_ordered(df.repartition(tasks), ["k", "s"], out, 90, compress)
            made.append(whole(out))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0][0] == made[1][0] == made[2][0] and len(made[0][1]) == 6
    text = [(gzip.decompress(p.read_bytes()) if compress else p.read_bytes()).decode().splitlines() for p in made[0][1]]
    assert all(t[0] == "k\ts\tv" and len(t) <= 91 for t in text)
    got = [line.split("\t") for t in text for line in t[1:]]
    key = lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or ""), r[2])
    want = [["" if x is None else str(x) for x in r] for r in sorted(rows, key=key)]
    assert [[x.strip('"') for x in r] for r in got] == want
    if compress:
        assert gzip.decompress(made[0][0]).count(b"k\ts\tv\n") == 6


def test_places_count_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("g"), F.col("id").alias("x")).repartition(7)
    got = ordered.numbered(df, ["g", "x"])
    assert got.orderBy("g", "x").select(ordered.PLACE).toPandas()[ordered.PLACE].tolist() == list(range(1000))
    assert ordered.numbered(df.limit(0), ["g"]).count() == 0
