"""PartEnum join and fill-in-the-middle against brute force and exact round trips."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from kmerloom.llm import oracles, part_enum as pe
from kmerloom.llm.fill_in_middle import fill_in_middle, restore, transform
from kmerloom.llm.queries import queries

SPACE = " \t\n\r\x0b\x0c"


@pytest.mark.parametrize("name", ["op11_part_enum", "op12_fill_in_middle"])
def test_query_agrees_with_sql(spark, data, same, name):
    same(queries()[name](spark, data), oracles.oracle_sql()[name])


def grams_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def brute(rows):
    """{row: (set size, component)}, rows (id, text) by place."""
    sets = [grams_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted([(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)], key=str)


def corpus(seed, families=12, copies=14):
    """Families of near copies around a text, edited to either side of the threshold, and chains."""
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 4, 5, 8, 20, 60, 150, 400]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40 + 1))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), rng.choice(SPACE).join(words) if rng.random() < 0.5 else " ".join(words).upper()))
            if rng.random() < 0.2:
                base = words
    return rows


@pytest.mark.parametrize("seed, hot", [(1, False), (2, True)])
def test_components_equal_brute_force(spark, monkeypatch, seed, hot):
    if hot:  # spread frequent signatures, and cut buckets in small tiles
        monkeypatch.setattr(pe, "HOT_ROWS", 5)
        monkeypatch.setattr(pe, "TILE", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pe.part_enum_components(docs).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    rows = [
        (5, None), (4, ""), (3, " \t\n"), (9, "one two"), (8, "One  TWO"), (7, "one two three four"), (None, "one two three four"), (None, "only here without id x"),
        (1, long), (2, long + " tail"), (2, "other text of the id two"), (6, "other text of the id two"), (6, "other text of the id two"), (-(1 << 63), long.upper()),
        (10, "é É ü x"), (11, "É É ü x"), (12, "a b c d e"),
    ]
    docs = spark.createDataFrame([(*r, 0, "s", b"d") for r in rows], "doc_id long, text string, n int, node string, digest binary")
    got = sorted([tuple(r) for r in pe.part_enum_components(docs).collect()], key=str)
    assert got == brute(rows)
    assert pe.part_enum_components(docs.limit(0)).count() == 0


def test_rows_without_id_bridge_others(spark):
    base = [f"b{i}" for i in range(120)]
    ends = [base[:110] + [f"p{i}" for i in range(3)] + base[113:], base, base[:8] + [f"q{i}" for i in range(3)] + base[11:]]
    rows = [(1, " ".join(ends[0])), (None, " ".join(ends[1])), (2, " ".join(ends[2]))]
    got = sorted([tuple(r) for r in pe.part_enum_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=str)
    assert got == brute(rows)
    assert {r[2] for r in got} == {1}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.choice([1, 2, 6, 7, 12, 13, 30, 90, 91, 300, 1500]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        most = int(pe.differing(2 * len(a), 85))
        b = np.concatenate([a[: len(a) - int(rng.integers(0, most // 2 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, most // 2 + 1))).astype(np.uint64)])
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 85 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        who, sig = pe.signatures([a, b], 85)
        assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()), (len(a), len(b), both)
        x, y = (np.frombuffer(pe.parity(s), np.uint64).reshape(1, -1) for s in (a, b))
        wide = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(pe.folded(x, wide) ^ pe.folded(y, wide)).sum() <= len(a) + len(b) - 2 * both


def test_template_buckets_emit_no_quadratic_pairs(spark):
    """Texts that share most of a template without linking leave few pairs to check in full."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(300):
        words = base[:240] + [f"u{rng.randrange(10**6)}" for _ in range(90)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id == r.doc_id for r in pe.part_enum_components(docs).collect()} == {True}
    own = pe.sets_of(docs.selectExpr("doc_id AS id", "CAST(text AS BINARY) AS t"), 4)
    nodes = own.selectExpr("digest", "id AS least", "1L AS copies", "n", "sketch", "id AS node").cache()
    met = pe.shared(pe.entries(docs.selectExpr("doc_id AS node", "CAST(text AS BINARY) AS t").join(nodes.select("node", "digest"), "node"), 4, 85), None)
    none = spark.createDataFrame([], "node long, component long")
    assert met.count() > 1000 and pe.leftover(met, none, nodes, 85).count() == 0


def plain(doc, text):
    """The contract, from its words."""
    text = text or ""
    h = hashlib.sha256(f"42:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    assert "".join(units) == text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", " ", " \t\n ", "x", "a <M> b", "<P", "<S>", "é ü 漢字  end ", "\x00 zero", "👩‍🚀 go\r\n", "word " * 20_000] + ["".join(rng.choice("ab \n\t<>PM") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "same"), (3, "same"), (-7, "neg a b c")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = [tuple(r) for r in fill_in_middle(docs).collect()]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, *plain(i, t), sha(plain(i, t)[-1]), sha(t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle(docs.limit(0)).count() == 0
    null = fill_in_middle(spark.createDataFrame([(None, "a b c d")], "doc_id int, text string")).collect()
    assert null[0].doc_id is None and null[0].restored_sha256 == sha("a b c d")


def test_restore_undoes_transform():
    import regex

    unit = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
    for i in range(400):
        text = f" a{i}\tb <x> c\n" * (i % 7)
        _, form, _, _, out = transform(str(i), text, unit, 42, 100, 50)
        assert restore(out, form) == text
