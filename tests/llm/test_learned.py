"""Classifiers and rules: held-out accuracy, exact search, odd rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.llm import common, quality_classifier as qc, toxicity as tx
from kmerloom.llm.quality_rules import Model, RULES, counts, fit_em, quality_rules
from kmerloom.llm.queries import held_out, queries

SCHEMA = "doc_id long, text string, score string"
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n", "a"), (None, "some words here", "a"), (4, "word " * 20000, "a"), (4, "word " * 20000, "a"), (5, "日本語 テキスト", "a")]


@pytest.mark.parametrize("name,label,rest,floor", [("op3_quality_classifier", "quality", (4, 2), 0.9), ("op8_toxicity", "toxic", (5, 0), 0.85)])
def test_held_out_accuracy(spark, name, label, rest, floor):
    d = "/root/testdata/sf0.01"
    got = queries()[name](spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert got.count() == docs.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    labels = spark.read.parquet(f"{d}/labels.parquet").filter(held_out(*rest))
    r = got.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("acc"), F.min(F.col("held_out").cast("int")).alias("h")).first()
    assert r.acc >= floor and r.h == 1


@pytest.mark.parametrize("run", [qc.quality_classifier, tx.toxicity])
def test_odd_rows_and_labels(spark, run):
    docs = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (99, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = run(docs, labels, held_out(4, 2)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    none = run(docs, labels.limit(0), held_out(4, 2)).collect()
    assert all(r.score == pytest.approx(0.5) for r in none)
    assert run(docs.limit(0), labels, held_out(4, 2)).count() == 0


def test_held_out_labels_are_not_read(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(held_out(4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, qc.quality_classifier(docs, x, held_out(4, 2)).collect())) for x in (labels, flipped))
    assert [r[:2] for r in one] == [r[:2] for r in two] and np.allclose([r[2] for r in one], [r[2] for r in two])


def test_nearest_is_exact():
    rnd = np.random.default_rng(5)
    idf = 1 + rnd.random(30)
    rows = [[(int(t), float(rnd.integers(1, 9))) for t in sorted(rnd.choice(30, rnd.integers(1, 6), replace=False))] for _ in range(700)]
    index = tx.Index.build(list(range(700)), rnd.integers(0, 2, 700).tolist(), rows, idf, 0.1)
    full = np.append(idf, tx.CONSTANT / np.log(2))
    dense = np.zeros((700, 31))
    for e, i in enumerate(index.ids):
        t, w = tx.unit(rows[i], full)
        dense[e, t] = w
    for row in rows[:60]:
        t, w = tx.unit(row, full)
        cos = dense[:, t] @ w
        want = sorted(range(700), key=lambda e: (-round(cos[e], 12), e))[:15]
        got = index.nearest(row, 15)
        assert [e for _, e in got] == want and np.allclose([c for c, _ in got], cos[want])
    assert index.nearest([], 15) == [] and index.score([], 15)[0] == pytest.approx(0.1)


def test_every_example_is_indexed_and_every_text_searched(spark):
    """Texts without a selected term find their nearest examples over all words, clean ones too."""
    rnd = np.random.default_rng(3)
    texts = [" ".join("word" + chr(97 + i // 26) + chr(97 + i % 26) for i in rnd.integers(0, 500, 60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 7)) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(docs, labels, F.col("doc_id") >= 100).collect()}
    assert all(got[100 + i].evidence[0] == i and len(got[100 + i].evidence) == 15 for i in range(60))
    assert got[107].score > max(got[100 + i].score for i in range(60) if i != 7)


def test_stems_are_proper_beginnings(monkeypatch):
    texts = ["Vile vileness vilest VILEX vi", "évité éviter évi évit", "ünü ünüx 日本語話 日本語", ""]
    every = sorted({f for t in texts for w in tx.words(t) for f in tx.forms(w)})
    stems = [f for f in every if f.endswith(b"*")]
    keys = np.sort(np.array([tx.key(f) for f in every], np.uint64))
    terms = tx.Terms(keys, {f: int(np.searchsorted(keys, np.uint64(tx.key(f)))) for f in stems})
    wanted = [Counter(int(np.searchsorted(keys, np.uint64(tx.key(f)))) for w in tx.words(text) for f in tx.forms(w)) for text in texts]
    monkeypatch.delattr(tx, "forms")  # counting does not make the forms of each word, which took most of its time
    for text, want in zip(texts, wanted):
        found = tx.words(text)
        size, t, n = terms.count(text)
        assert (size, dict(zip(t.tolist(), n.tolist()))) == (len(found), dict(want))


def test_texts_reach_kernels_in_small_batches(spark, monkeypatch):
    seen = []
    write = tx.materialize

    def spy(df, label):
        seen.append((label, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return write(df, label)

    monkeypatch.setattr(tx, "materialize", spy)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(i, f"word{i % 7} here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert tx.toxicity(docs, labels, F.col("doc_id") >= 30).count() == 40
    assert dict(seen)["toxicity-counts"] == common.TEXTS and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_counts(spark):
    rows = [(1, "a b c a b c x"), (2, "l\nl\n\nm l\n \n"), (3, None), (4, "é#b $$ A!"), (5, "q q q q")]
    got = {r.doc_id: r for r in counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].word_chars) == (7, 6, 7)
    assert (got[2].n_lines, got[2].n_dup_lines) == (3, 1) and got[3].n_words == 0 and got[3].n_repeat_words == 0
    assert (got[4].n_symbols, got[4].n_shouts, got[4].n_capitals, got[4].n_letters) == (3, 1, 1, 3)
    assert got[5].n_repeat_words == 4


def test_rules(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = quality_rules(docs).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got) and quality_rules(docs.limit(0)).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = queries()["op9_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("NOT base_failed")
    good = r.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = r.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.97 and bad < 0.2


def test_posterior_is_returned(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)).capitalize()
    got = quality_rules(spark.createDataFrame([(i, good) for i in range(20)] + [(50, "#$% ABC!!! " * 60)], "doc_id long, text string")).collect()
    assert all(0 <= r.posterior <= 1 and r.kept == (not r.base_failed and r.posterior >= 0.5) for r in got)


def test_em_recovers_accuracies(spark):
    rnd = np.random.default_rng(1)
    y = rnd.random(20000) < 0.8
    votes = [np.where(rnd.random(20000) < 0.3, 0, np.where(rnd.random(20000) < (0.95 if j else 0.9), 1, -1) * np.where(y, 1, -1)) for j in range(4)]
    df = spark.createDataFrame([tuple(map(int, v)) for v in zip(*votes)], "v0 int, v1 int, v2 int, v3 int").groupBy("v0", "v1", "v2", "v3").agg(F.count("*").alias("n"))
    m = fit_em(df, 4)
    assert isinstance(m, Model) and abs(m.good - 0.8) < 0.02 and abs(m.on_good[0] - 0.9) < 0.02 and abs(m.on_bad[3] - 0.95) < 0.03
    assert len({r.name for r in RULES}) == len(RULES)


def corpus(rnd, n, toxic=0.2):
    """Texts over shared words; toxic ones hold some of a few words of their own."""
    bad = ["vilea", "vileb", "vilec", "viled"]
    out = []
    for i in range(n):
        t = ["word" + chr(97 + j // 26) + chr(97 + j % 26) for j in rnd.integers(0, 300, rnd.integers(5, 60))]
        y = int(rnd.random() < toxic)
        if y and rnd.random() < 0.9:
            t[: len(t) // 3] = rnd.choice(bad, len(t) // 3).tolist()
        out.append((i, " ".join(t), y))
    return out


def test_toxicity_is_dense_brute_force(spark):
    """The whole operator against dense cosines: terms, idf, votes with shared ties, calibration."""
    rnd = np.random.default_rng(9)
    rows = corpus(rnd, 400)
    rows += [(400 + i, t, y) for i, (_, t, y) in enumerate(rows[:80])] + [(500, None, 0), (501, "", 0), (504, "unseen alone", 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(docs, labels, F.col("doc_id") % 4 == 0).collect()}
    train = [(i, t, y) for i, t, y in rows if i % 5 and i % 4]
    sample = spark.createDataFrame([(t, y) for _, t, y in train], "text string, y long")
    chosen = tx.select_terms(sample)
    assert chosen and all(t.startswith(b"vile") for t in chosen)
    bag = lambda t: [f for w in tx.words(t) for f in tx.forms(w)]
    vocab = sorted({w for _, t, _ in train for w in tx.words(t)} | set(chosen))
    at = {w: i for i, w in enumerate(vocab)}

    def count(t):
        x, found = np.zeros(len(vocab)), tx.words(t)
        for f in bag(t):
            if f in at and (not f.endswith(b"*") or f in chosen):
                x[at[f]] += 1
        return 100 * x / max(1, len(found))

    every = np.array([count(t) for _, t, _ in rows])
    idf = np.log((1 + len(rows)) / (1 + (every > 0).sum(axis=0))) + 1
    idf[[w not in chosen for w in vocab]] *= tx.ORDINARY
    v = np.column_stack([np.log1p(every) * idf, np.where((every > 0).any(axis=1), tx.CONSTANT, 0)])
    v /= np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    number = {i: k for k, (i, _, _) in enumerate(rows)}
    ex = np.array([number[i] for i, _, _ in train])
    y = np.array([y for _, _, y in train])
    bare = ~(every[ex][:, [at[w] for w in chosen]] > 0).any(axis=1)
    base = (y[bare].sum() + 0.5) / (bare.sum() + 1)

    def vote(k, skip=None):
        c = v[ex] @ v[k]
        ok = (c > 0) & (np.arange(len(ex)) != (-1 if skip is None else skip))
        c, lab = c[ok], y[ok]
        if len(c) > 15:
            least = np.sort(c)[-15]
            above, tied = c > least + 1e-7, np.abs(c - least) <= 1e-7
            w = np.where(above, 1.0, np.where(tied, (15 - above.sum()) / tied.sum(), 0.0))
        else:
            w = np.ones(len(c))
        w = w / (1 - c + 0.1)
        return (w @ lab + 2 * base) / (w.sum() + 2)

    curve = tx.Calibration.fit(np.array([vote(k, j) for j, k in enumerate(ex)]), y)
    for i, t, _ in rows:
        assert got[i].score == pytest.approx(float(curve(np.array([vote(number[i])]))[0]), abs=1e-5)
        assert got[i].predicted == int(got[i].score >= 0.5)
    assert got[500].evidence == [] and got[500].score == got[501].score == got[504].score


def test_calibration():
    rnd = np.random.default_rng(2)
    p = rnd.random(20000)
    y = (rnd.random(20000) < p**2).astype(int)  # votes that are too high
    curve = tx.Calibration.fit(p, y)
    fitted = curve(p)
    for lo in (0.1, 0.3, 0.5, 0.7):
        m = (fitted >= lo) & (fitted < lo + 0.2)
        assert abs(fitted[m].mean() - y[m].mean()) < 0.06
    none = tx.Calibration.fit(np.zeros(0), np.zeros(0))
    assert none(np.array([0.5]))[0] == pytest.approx(0.5)


def test_ties_and_contradictory_labels(spark):
    """Ids decide nothing among copies; of contradictory labels 1 counts."""
    docs = spark.createDataFrame([(i, "same words here") for i in range(40)] + [(100, "same words here")], "doc_id long, text string")
    one = spark.createDataFrame([(i, int(i < 10)) for i in range(40)], "doc_id long, toxic int")
    two = spark.createDataFrame([(i, int(i >= 30)) for i in range(40)], "doc_id long, toxic int")
    a, b = (tx.toxicity(docs, x, F.col("doc_id") >= 100).filter("doc_id = 100").first().score for x in (one, two))
    assert a == pytest.approx(b)
    both = one.unionByName(one.withColumn("toxic", F.lit(0)))
    assert tx.toxicity(docs, both, F.col("doc_id") >= 100).filter("doc_id = 100").first().score == pytest.approx(a)
