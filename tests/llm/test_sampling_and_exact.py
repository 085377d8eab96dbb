"""Mixing and exact dedup against brute force, with odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kmerloom.llm.exact_dedup import exact_dedup
from kmerloom.llm.mixing import mix, source_targets, unit_offset
from kmerloom.llm.oracles import oracle_sql
from kmerloom.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "a b", "en", "s", 3), (2, "ab", "en", "s", 2), (3, " a\tb\n", None, "s", 5), (4, None, "en", None, 0), (5, "", "en", "t", 0), (None, "x y z", "en", "t", 5),
    (6, "word " * 30000, "en", "t", 0), (7, "é b", "en", "u", 3), (8, "éb", "en", "u", 2), (9, "dup", "en", "s", 3), (9, "dup", "en", "s", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("size", F.lit("clash")).withColumn("kept", F.lit(1)).repartition(3)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def brute_exact(rows):
    groups = {}
    for k, (i, t, *_) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for k, (i, t, *_) in enumerate(rows):
        first = min(groups[norm(t)], key=lambda g: g[:4])
        out.append((i, first[4], len(groups[norm(t)]), k == first[3], hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup(odd, digest):
    """Also with a digest of one hexadecimal digit, under which contents clash."""
    got = exact_dedup(odd, digest=digest, salts=2)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(ODD)


def test_kept_columns_follow_their_rows(odd):
    rows = odd.withColumn("mark", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("source", F.lit("none"))))
    name = lambda x: "none" if x is None else str(x)
    assert all(r.mark.split("/")[0] == name(r.doc_id) for r in exact_dedup(rows, keep=("mark",)).collect())
    assert all(r.mark == f"{name(r.doc_id)}/{name(r.source)}" for r in mix(rows, keep=("mark",)).collect())


def test_exact_dedup_of_many_copies(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text")).repartition(7)
    got = exact_dedup(rows)
    assert got.filter("kept").count() == 1001 and got.filter("group_size = 2000 AND keep_id = 1").count() == 2000


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(none).count() == 0 and mix(none).count() == 0


def brute_mix(rows, spark, seed=7):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = 1.5 * sum(total.values())
    while open_:  # share by weight, cap, share the excess again
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    return total, target


def test_mix_targets_and_bounds(odd, spark):
    total, target = brute_mix(ODD, spark)
    got = mix(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    assert sorted(map(str, got)) == sorted(map(str, mix(odd.repartition(5)).collect()))  # reruns agree


def test_mix_is_near_its_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for r in mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) <= 2 * r.m
    _, target = brute_mix([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()], spark)
    for r in mix(docs).select("source", "target").distinct().collect():
        assert r.target == pytest.approx(target[r.source], rel=1e-9)


def test_source_targets_without_words(spark):
    rows = source_targets(spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size long")).collect()
    assert [r.target for r in rows] == [0.0, 0.0]
    assert 0 <= spark.range(1).select(unit_offset(7, F.lit("x"))).first()[0] < 1


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_exact_dedup", "op9_quality_rules"])
def test_queries_agree_with_sql(name, spark, data, same):
    same(queries()[name](spark, data), oracle_sql()[name])
