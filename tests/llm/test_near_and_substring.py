"""Fingerprints, near duplicates, repeated substrings and chunks against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import kmerloom.llm.chunk_dedup as cd
import kmerloom.llm.suffix_dedup as sd
from kmerloom.llm import common, simhash as sh

SCHEMA = "doc_id long, text string, extra string"


def brute_fp(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in ids}


def texts():
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta\n", "eta"]
    base = [" ".join(rnd.choice(words) + str(rnd.randint(0, 50)) for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    out = [*base, None, "", " \t\n", "one", "ONE", "one two", "x " * 5000]
    for t in base[:15]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        out += [t, " ".join(w), t.upper().lower() if t.isascii() else t]
    return out


def test_fingerprint_is_sparks_hash(spark):
    s = "über three words"
    got = spark.range(1).select(F.xxhash64(F.lit(s))).first()[0]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(s.encode(), 42) == sh.fingerprint(s.encode(), 3)


def test_simhash_components(spark):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows + [(None, "one", "x")], SCHEMA).withColumn("fp", F.lit(1)).withColumn("component", F.lit("c"))
    got = sh.simhash_components(df).collect()
    assert len(got) == len(rows) + 1
    fp = {i: brute_fp(t, 3) for i, t, _ in rows}
    comp = brute_components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fp[r.doc_id], comp[r.doc_id]) and len(r.fingerprint) == 16
    assert sh.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("radius,tile", [(0, 10**6), (2, 10**6), (2, 3), (3, 10), (8, 10**6), (11, 4), (11, 10**6)])
def test_search_finds_every_link(spark, radius, tile, monkeypatch):
    monkeypatch.setattr(sh, "TILE_ROWS", tile)  # shards in several tiles
    rnd = random.Random(radius)
    fps = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps |= {x, *(x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 12))) for _ in range(4))}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [(r.fp & (2**64 - 1), r.other & (2**64 - 1)) for r in sh.hamming_forest(df, radius).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in links)
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= radius)
    linked = {frozenset(x) for x in links}
    assert brute_components(fps, lambda a, b: frozenset((a, b)) in linked) == want


def test_rows_sent_per_fingerprint_do_not_grow():
    """Copies depend on the tree alone; each tree spreads fingerprints over all its shards."""
    rnd = np.random.default_rng(4)
    for radius in (2, 11):
        parts = sh.trees(radius)
        fp = rnd.integers(0, 2**64, 40_000, dtype=np.uint64)
        grown = [sh.Tree(fp[: sh.SEEDS], levels, reach, sh.DEEP if len(parts) == 1 else sh.SHALLOW) for levels, reach in parts]
        sent = [sum(len(rows) for t in grown for _, rows, _ in t.visits(fp[:n])) / n for n in (5_000, 40_000)]
        assert abs(sent[0] - sent[1]) < 0.03 * sent[1] and sent[1] < 32
        for t in grown:
            home = [int(h.sum()) for _, _, h in t.visits(fp)]
            assert sum(home) == len(fp) and max(home) < 6 * len(fp) / t.leaves


@pytest.mark.parametrize("radius,sizes", [(2, (10**6, 10**9, 25 * 10**9)), (11, (10**6, 10**8))])
def test_rows_sent_through_buckets_and_tiles_do_not_grow(radius, sizes):
    """Counts of buckets at large sizes are those of a sample, scaled."""
    rnd = np.random.default_rng(5)
    fp = rnd.integers(0, 2**64, 1_000_000, dtype=np.uint64)
    rates = []
    for total in sizes:
        shards = sh.Shards(fp[: sh.SEEDS], radius, total)
        keys, n = np.unique(np.concatenate([k for k, _, _ in shards.visits(fp, queries=False)]), return_counts=True)
        n = n * (total // len(fp))
        shards.tiles = {k: -(-m // sh.TILE_ROWS) for k, m in zip(keys.tolist(), n.tolist()) if m > 2 * sh.TILE_ROWS}
        rates.append(sum(len(rows) for _, _, rows, _ in shards.sent(fp[:20_000])) / 20_000)
    assert max(rates) < 1.1 * min(rates) and max(rates) < 32


def brute_meetings(x, similarity=0.8):
    out = set()
    for a, b in itertools.combinations(x.tolist(), 2):
        if a[0] == b[0] and a[2] != b[2] and min(a[3] - a[4], b[3] - b[4]) >= similarity / (1 + similarity) * (a[3] + b[3]) - 1e-9 and min(a[3], b[3]) >= similarity * max(a[3], b[3]) - 1e-9:
            out.add((min(a[1], b[1]), max(a[1], b[1])))
    return out


def test_meetings_against_brute_force():
    rnd = np.random.default_rng(6)
    for comps in (3, 40, 10**6):
        x = np.zeros(600, sh.ENTRY)
        x["gram"], x["id"], x["n"] = rnd.integers(0, 4, 600), np.arange(600), rnd.integers(1, 60, 600)
        x["comp"], x["place"] = rnd.integers(0, comps, 600), (rnd.random(600) * 0.2 * x["n"]).astype(int)
        want = brute_meetings(x)
        assert want and set(zip(*(c.tolist() for c in sh.meetings(x, 0.8)))) == want
        part = x["id"] % 3
        tiled = [set(zip(*(c.tolist() for c in sh.meetings(x[(part == t) | sh.met(x, 0.8)], 0.8, part[(part == t) | sh.met(x, 0.8)] == t)))) for t in range(3)]
        assert set.union(*tiled) == want and sum(map(len, tiled)) == len(want)


def test_meetings_of_a_template_make_no_pairs():
    """Texts that share 85 of 100 shingles: six shared ones in each prefix, and no pair to list."""
    x = np.zeros(6 * 100_000, sh.ENTRY)
    x["gram"], x["id"] = np.repeat(np.arange(6), 100_000), np.tile(np.arange(100_000), 6)
    x["comp"], x["n"], x["place"] = x["id"], 100, 15 + x["gram"]
    assert len(sh.meetings(x, 0.8)[0]) == 0


def test_hot_shingles_in_tiles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(sh, "ENTRIES", 3)
    monkeypatch.setattr(sh, "fold", lambda h: 0)
    rows = near_rows()
    assert len(sh.hot_shingles(sh.common_shingles(spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id id", "text t"), 5))[0])
    got = {r.doc_id: r.component for r in sh.jaccard_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_near(rows)


@pytest.mark.parametrize("pick", [1, 2, 10**6])
def test_looked_up_shingles_lose_no_pair(spark, monkeypatch, pick):
    """Whether all shingles are looked up, half of them or next to none; one-bit fingerprints leave all pairs to the exact search."""
    monkeypatch.setattr(sh, "PICK", pick)
    monkeypatch.setattr(sh, "LOOKED_UP", 50)
    monkeypatch.setattr(sh, "fold", lambda h: 0)
    rows = near_rows()
    got = {r.doc_id: r.component for r in sh.jaccard_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_near(rows)


def test_shared_passages_make_no_candidates(spark, monkeypatch):
    """Crowds of five texts with a passage of their own (three tenths) that a small sample cannot see: no pair reaches 0.8."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randint(0, 10**9)}"
    rows = []
    for crowd in range(80):
        passage = [word() for _ in range(60)]
        rows += [(5 * crowd + i, " ".join([*(word() for _ in range(140)), *passage]), "") for i in range(5)]
    rows += [(1000, rows[0][1] + " more", "")]
    counted, plain = [], sh.similar

    def similar(texts, pairs, *rest):
        counted.append(pairs.count())
        return plain(texts, pairs, *rest)

    monkeypatch.setattr(sh, "SAMPLE", 20)
    monkeypatch.setattr(sh, "similar", similar)
    got = {r.doc_id: r.component for r in sh.jaccard_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1000: 0} and sum(counted) <= 10


def test_sketches_never_overstate_a_difference():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 30, 400, 5000):
        a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        for kept in (n, n * 9 // 10, n // 2, 0):
            b = np.unique(np.append(a[:kept], rnd.integers(0, 2**64, n - kept, dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            sketch, size = np.stack([sh.parities(a), sh.parities(b)]), np.array([len(a), len(b)])
            assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= len(a) + len(b) - 2 * both
            if both >= 0.8 * (len(a) + len(b) - both):
                assert sh.may_reach(np.array([0]), np.array([1]), size, sketch, 0.8).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[60] == 1 and got[139] == 100 and got[201] == 200 and 7 in got


def test_near_duplicates(spark):
    rnd = random.Random(2)
    base = [" ".join(f"w{rnd.randint(0, 9999)}" for _ in range(150)) for _ in range(10)]
    near = [t.replace(t.split()[70], "changed") for t in base]
    far = [" ".join(t.split()[:75]) + " " + " ".join(f"v{rnd.randint(0, 9999)}" for _ in range(75)) for t in base]
    rows = [(i, t, "") for i, t in enumerate([*base, *near, *far, "", None])]
    got = {r.doc_id: r.component for r in sh.jaccard_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(10):
        assert got.get(10 + i) == i  # one word of 150
        assert got.get(20 + i, 20 + i) == 20 + i  # half of the text
    assert got[31] == 30


def swapped(words, at, tag):
    """``words`` with those at the places ``at`` replaced."""
    return [f"{tag}{i}" if i in at else w for i, w in enumerate(words)]


def brute_near(rows, similarity=0.8):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: grams(t) for i, t, _ in rows}
    comp = brute_components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))
    return {i: c for i, c in comp.items() if i != c}


def near_rows():
    """Pairs on both sides of 0.8, in a crowd of texts that share passages and fall short of it."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randint(0, 99999)}"
    common = [word() for _ in range(40)]
    out = []
    for g in range(40):
        base = [word() for _ in range(rnd.choice([30, 60, 150, 400]))] + common * (g % 2)
        out.append(base)
        for v in range(3):
            out.append(swapped(base, rnd.sample(range(len(base)), max(1, round(len(base) * rnd.choice([0.01, 0.02, 0.03, 0.05])))), f"g{g}v{v}x"))
        out.append(base[: round(len(base) * rnd.choice([0.75, 0.82, 0.9]))])
    return [(i, " ".join(t), "") for i, t in enumerate(out)] + [(1000, "", ""), (1001, None, ""), (1002, "a b", ""), (1003, "A  b", "")]


def test_texts_are_compared_in_small_batches(spark, monkeypatch):
    name, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", {}, sh.materialize

    def spy(df, label):
        seen[label] = spark.conf.get(name)
        return write(df, label)

    monkeypatch.setattr(sh, "materialize", spy)
    before = spark.conf.get(name)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + ["x"])), (3, "else")], "doc_id long, text string")
    got = {(r.doc_id, r.component) for r in sh.jaccard_near_duplicates(docs).collect()}
    assert got | {(1, 1)} == {(1, 1), (2, 1)}
    assert seen["near-profiles"] == seen["near-similar"] == common.TEXTS and spark.conf.get(name) == before


@pytest.mark.parametrize("fold", [sh.fold, lambda h: int(np.bitwise_xor.reduce(h) & np.uint64(15))])
def test_near_duplicates_lose_no_pair(spark, monkeypatch, fold):
    """Also where fingerprints tell nothing, so that unrelated texts crowd into the radius."""
    monkeypatch.setattr(sh, "fold", fold)
    rows = near_rows()
    got = {r.doc_id: r.component for r in sh.jaccard_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_near(rows)


def brute_removed(docs, n):
    seen, out = set(), []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - n + 1):
            w = t[s : s + n]
            if w in seen:
                gone[s : s + n] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def substring_texts():
    rnd = random.Random(8)
    line = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    shared = [line(130), line(101), line(100), line(99)]
    out = [None, "", "short", "a" * 500, "ab" * 400, "a" * 99, shared[0], shared[0]]
    for _ in range(40):
        out.append(line(rnd.randint(0, 200)) + rnd.choice(shared) + line(rnd.randint(0, 60)) + rnd.choice(shared))
    return out + out[20:26]


@pytest.mark.parametrize("block,hot,length,salt", [(1 << 20, 50_000, 100, 4096), (600, 50_000, 100, 4096), (600, 2, 100, 4096), (700, 50_000, 48, 3), (600, 3, 100, 4)])
def test_suffix_dedup(spark, monkeypatch, block, hot, length, salt):
    """Also with many small blocks, several salts, and values split as if very frequent."""
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    monkeypatch.setattr(sd, "HOT_SEGMENTS", hot)
    rows = [(i, t, "x") for i, t in enumerate(substring_texts())]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(1)).repartition(3)
    got = sd.suffix_dedup(df, length=length, salt_blocks=salt)
    want = brute_removed([(i, (t or "").encode()) for i, t, _ in rows], length)
    assert sorted(map(tuple, got.drop("kept").collect())) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())


def test_two_stage_sort_kernel():
    rnd = random.Random(3)
    for _ in range(150):
        n = rnd.choice([3, 8, 12, 20])
        segs = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(n, 40))) for _ in range(rnd.randint(1, 6))] + [b"a" * 30, b"ab" * 20][: rnd.randint(0, 2)]
        wanted = np.array([len(s) - n + 1 for s in segs])
        got = set(zip(*(x.tolist() for x in sd.repeats(segs, wanted, [np.arange(len(segs)), np.zeros(len(segs), int)], n))))
        seen, want = set(), set()
        for i, s in enumerate(segs):
            for k in range(len(s) - n + 1):
                want |= {(i, k)} if s[k : k + n] in seen else set()
                seen.add(s[k : k + n])
        assert got == want


def test_null_and_repeated_ids(spark):
    t = "".join(random.Random(1).choices("abcdef", k=150))
    df = spark.createDataFrame([(5, t, ""), (None, t, ""), (5, t, "")], SCHEMA).coalesce(1)
    got = sd.suffix_dedup(df).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 150), (False, 150), (True, 0)]
    assert sd.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cd.chunk_dedup(df).select("doc_id", "n_removed").filter("n_removed = 150").count() == 2
    assert cd.chunk_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_chunks(docs):
    gear, seen, out = cd.GEAR.tolist(), set(), []
    for i, t in docs:
        h = start = removed = gone = 0
        kept, chunks = b"", []
        for e, b in enumerate(t, 1):
            h = ((h << 1) + gear[b]) & 0xFFFFFFFF
            if (e >= 32 and h < 2**32 // 40) or e - start >= 256:
                chunks.append(t[start:e])
                start = e
        chunks += [t[start:]] * (start < len(t))
        for again, part in itertools.groupby([(c, c in seen or c in chunks[:k]) for k, c in enumerate(chunks)], key=lambda x: x[1]):
            part = [c for c, _ in part]
            if again and sum(map(len, part)) >= 80:
                removed, gone = removed + len(part), gone + sum(map(len, part))
            else:
                kept += b"".join(part)
        seen.update(chunks)
        out.append((i, len(t), len(chunks), removed, gone, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("salt_blocks", [4096, 2])
def test_chunk_dedup(spark, monkeypatch, salt_blocks):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 3000)
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    rows = [(i, "".join(rnd.choice("ijklmnop ") for _ in range(rnd.randint(0, 700))) + passage[rnd.randint(0, 3) :], "") for i in range(30)] + [(40, None, ""), (41, "", "")]
    rows += [(50 + i, "a line that two texts end with" if i < 2 else passage[:70], "") for i in range(4)]  # short texts stay whole
    rows += [(60, "é" * 60_000, ""), (61, "é" * 60_000 + passage, ""), (-(2**63), passage, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("keys", F.lit(1)).withColumn("block", F.lit("clash"))
    got = cd.chunk_dedup(docs.repartition(3), salt_blocks=salt_blocks)
    want = brute_chunks(sorted((i, (t or "").encode()) for i, t, _ in rows))
    assert sorted(map(tuple, got.drop("kept").collect())) == want
    assert sum(r[4] for r in want) > 15_000 and all(r[4] == 0 for r in want if 50 <= r[0] < 60)  # shifted passages are found


def test_smallest_id_is_not_null(spark):
    t = "".join(random.Random(1).choices("abcdef", k=400))
    df = spark.createDataFrame([(-(2**63), t, ""), (None, "other", "")], SCHEMA)
    for run in (sd.suffix_dedup, cd.chunk_dedup):
        assert {r.doc_id for r in run(df).collect()} == {-(2**63), None}


def test_passages_of_fifty_words_are_caught(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(150):
        p = text(51)
        rows += [(2 * i, f"{text(80)} {p} {text(60)}", ""), (2 * i + 1, f"{text(30)} {p} {text(99)}", "")]
    rows += [(1000 + i, text(150) + " the end of it", "") for i in range(150)]
    got = {r.doc_id: r.n_removed_chunks for r in cd.chunk_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[2 * i + 1] > 0 for i in range(150)) >= 142
    assert not any(got[2 * i] for i in range(150)) and not any(got[1000 + i] for i in range(150))
