"""DuckDB SQL for the queries, written from the definitions and independent of the engine."""

from __future__ import annotations

import numpy as np

from ..params import BASE_SEEDS, MASK, SketchParams, bucket_count
from .queries import EDGES, K, MIX, SEEDED, SMALL, STRIPE

TWO64 = f"{MASK + 1}::UHUGEINT"


def u(x: int) -> str:
    return f"{x}::UBIGINT"


def mul(a: str, b: str) -> str:
    return f"(({a})::UHUGEINT * ({b})::UHUGEINT % {TWO64})::UBIGINT"


def add(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {TWO64})::UBIGINT"


def shr(a: str, n: int | str) -> str:
    return f"(({a}) >> ({n})::UBIGINT)"


def rotl(a: str, n: int) -> str:
    n %= 64
    return f"((({a})::UHUGEINT * {1 << n}::UHUGEINT % {TWO64})::UBIGINT + {shr(a, 64 - n)})" if n else f"({a})"


def signed(a: str) -> str:
    return f"(({a})::HUGEINT - CASE WHEN ({a}) >= 9223372036854775808::UBIGINT THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END)::BIGINT"


def chain(source: str, name: str, col: str, steps: list[str], out: str) -> str:
    """CTEs name_0.. that apply steps ({x} is the value so far) to col and call the last out."""
    ctes, at, x = [], source, col
    for i, s in enumerate(steps):
        y = out if i == len(steps) - 1 else f"x_{i}"
        drop = f" EXCLUDE (x_{i - 1})" if i else ""
        ctes.append(f"{name}_{i} AS (SELECT *{drop}, {s.format(x=x)} AS {y} FROM {at})")
        at, x = f"{name}_{i}", y
    ctes.append(f"{name} AS (SELECT * FROM {at})")
    return ", ".join(ctes)


def mix_steps() -> list[str]:
    return [
        add("{x}", u(0x9E3779B97F4A7C15)),
        mul(f"xor({{x}}, {shr('{x}', 30)})", u(0xBF58476D1CE4E5B9)),
        mul(f"xor({{x}}, {shr('{x}', 27)})", u(0x94D049BB133111EB)),
        f"xor({{x}}, {shr('{x}', 31)})",
    ]


TRANSLATE = "translate(hex(encode(coalesce({t}, ''))), '0123456789ABCDEF', 'ACGTACGTACGTACGT')"


def seqs(table: str = "benchmark") -> str:
    key = {"benchmark": "item_id", "documents": "doc_id"}[table]
    return f"SELECT {key} AS id, {TRANSLATE.format(t='text')} AS seq FROM {table}"


def rc(s: str) -> str:
    return f"reverse(translate(regexp_replace({s}, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCATGCA'))"


def windows(source: str, k: int) -> str:
    """(id, pos, kmer), canonical.  Sequences are cut into pieces first, since substrings of
    long strings are slow."""
    return (
        f"(SELECT id, p0 + i0 AS pos, least(substr(piece, i0 + 1, {k}), substr(back, length(piece) - {k} - i0 + 1, {k})) AS kmer "
        f"FROM (SELECT id, p0, piece, {rc('piece')} AS back, unnest(range(0, length(piece) - {k} + 1)) AS i0 "
        f"FROM (SELECT id, c * 128 AS p0, substr(seq, c * 128 + 1, {127 + k}) AS piece "
        f"FROM (SELECT id, seq, unnest(range(0, (length(seq) - {k}) // 128 + 1)) AS c FROM ({source}) s WHERE length(seq) >= {k}))))"
    )


def sets(source: str, k: int, where: str = "") -> str:
    return f"(SELECT DISTINCT id, kmer FROM {windows(source, k)}{where})"


def pack(kmer: str, first: int, n: int, view: bool = True) -> str:
    """Bases first.. (from 1) of a k-mer in two bits each, as a signed 64-bit number (or unsigned)."""
    digits = " + ".join(f"(instr('ACGT', substr({kmer}, {first + j}, 1)) - 1)::UBIGINT * {u(1 << 2 * (n - 1 - j))}" for j in range(n))
    return signed(f"({digits})") if view else f"({digits})"


def neighbours(ids: str) -> str:
    return f"(SELECT id AS pair_idx, id AS \"left\", nxt AS \"right\" FROM (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM ({ids})) WHERE nxt IS NOT NULL)"


JACCARD = "round(coalesce(inter::DOUBLE / nullif(n1 + n2 - inter, 0), 0.0), 12)"


def bipartite(q: str, db: str, where: str = "") -> str:
    return f"""WITH q AS {q}, d AS {db}, i AS (SELECT q.id AS query, d.id AS db, count(*) AS inter FROM q JOIN d USING (kmer) {where} GROUP BY ALL),
n1 AS (SELECT id AS query, count(*) AS n1 FROM q GROUP BY id), n2 AS (SELECT id AS db, count(*) AS n2 FROM d GROUP BY id)
SELECT query, db, inter, n1, n2, {JACCARD} AS jaccard FROM i JOIN n1 USING (query) JOIN n2 USING (db)"""


def pairwise(pairs: str, s: str) -> str:
    return f"""s AS {s}, p AS {pairs}, n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
i AS (SELECT pair_idx, count(*) AS inter FROM p JOIN s a ON a.id = p."left" JOIN s b ON b.id = p."right" AND b.kmer = a.kmer GROUP BY pair_idx),
r AS (SELECT pair_idx, "left", "right", coalesce(inter, 0)::BIGINT AS inter, coalesce(x.n, 0)::BIGINT AS n1, coalesce(y.n, 0)::BIGINT AS n2
      FROM p LEFT JOIN i USING (pair_idx) LEFT JOIN n x ON x.id = p."left" LEFT JOIN n y ON y.id = p."right")"""


def seed_case(c: str, comp: bool = False) -> str:
    pair = dict(zip("ACGT", "TGCA"))
    return f"CASE {c} " + " ".join(f"WHEN '{b}' THEN {u(BASE_SEEDS[pair[b] if comp else b])}" for b in "ACGT") + " END"


def rot_by(x: str, n: str) -> str:
    return f"(({x})::UHUGEINT * (1::UHUGEINT << (({n}) % 64)::UHUGEINT) % {TWO64})::UBIGINT + CASE WHEN ({n}) % 64 = 0 THEN 0::UBIGINT ELSE ({x}) >> (64 - ({n}) % 64)::UBIGINT END"


def hashes(k: int = K) -> str:
    """CTE body (id, pos, h): XOR of rotated base seeds over the windows, smaller strand."""
    base = "substr(kmer, j + 1, 1)"
    return (
        f"(SELECT id, pos, least(f, r) AS h FROM (SELECT id, pos, bit_xor({rot_by(seed_case(base), f'{k - 1} - j')}) AS f, bit_xor({rot_by(seed_case(base, True), 'j')}) AS r "
        f"FROM (SELECT id, pos, kmer, unnest(range(0, {k})) AS j FROM {windows(seqs(), k)}) GROUP BY id, pos))"
    )


def registers(p: SketchParams, buckets: int) -> str:
    """CTEs up to minima (id, bucket, v)."""
    m = (buckets - 1).bit_length()
    return (
        f"hs AS MATERIALIZED {hashes()}, b0 AS (SELECT *, xor(h, {u(p.bucket_seed)}) AS hb FROM hs), {chain('b0', 'b1', 'hb', mix_steps(), 'bh')}, "
        f"k0 AS (SELECT id, pos, h, {shr('bh', 64 - m)}::INTEGER AS bucket, xor(h, {u(p.rank_seed)}) AS hr FROM b1), {chain('k0', 'k1', 'hr', mix_steps(), 'rank0')}, "
        f"minima AS MATERIALIZED (SELECT id, bucket, min(CASE WHEN rank0 = {u(MASK)} THEN {u(MASK - 1)} ELSE rank0 END) AS v FROM k1 GROUP BY id, bucket)"
    )


def densified(p: SketchParams, buckets: int, attempts: int = 2000, zeros: bool = False) -> str:
    """CTEs up to dense (id, bucket, v); with ``zeros`` sequences without a k-mer have registers 0."""
    bare = f" UNION ALL SELECT s.id, y.i::INTEGER, 0::UBIGINT FROM ({seqs()}) s, range(0, {buckets}) y(i) WHERE s.id NOT IN (SELECT id FROM minima)" if zeros else ""
    a, b = p.universal
    m = (buckets - 1).bit_length()
    return registers(p, buckets) + (
        f", donors AS (SELECT i AS bucket, t, {shr(add(mul(f'(i::UBIGINT * 4294967296::UBIGINT + t::UBIGINT)', u(a)), u(b)), 64 - m)}::INTEGER AS donor FROM range(0, {buckets}) x(i), range(1, {attempts + 1}) y(t)), "
        f"empties AS (SELECT DISTINCT x.id, y.i AS bucket FROM minima x, range(0, {buckets}) y(i) WHERE NOT EXISTS (SELECT 1 FROM minima z WHERE z.id = x.id AND z.bucket = y.i)), "
        f"dense AS MATERIALIZED (SELECT id, bucket::INTEGER AS bucket, v FROM minima UNION ALL SELECT e.id, e.bucket::INTEGER, arg_min(m.v, d.t) FROM empties e JOIN donors d ON d.bucket = e.bucket JOIN minima m ON m.id = e.id AND m.bucket = d.donor GROUP BY ALL{bare})"
    )


# The primes of XXH64.
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def positioned(p: SketchParams, buckets: int, zeros: bool = False) -> str:
    """CTEs up to pos (id, bucket, v, position)."""
    stride = p.sketch_bits // buckets
    head = densified(p, buckets, zeros=zeros)
    if p.mode == "value":
        return head + f", pos AS (SELECT *, (v % {u(p.sketch_bits)})::BIGINT AS position FROM dense)"
    if p.mode == "stripe" and stride >= 2:
        return head + f", pos AS (SELECT *, (bucket * {stride} + (v % {u(stride)})::BIGINT)::BIGINT % {p.sketch_bits} AS position FROM dense)"
    lane = lambda x: mul(rotl(mul(x, u(_P[1])), 31), u(_P[0]))
    start = (p.position_seed + _P[4] + 16) & MASK
    steps = [
        f"xor({u(start)}, {lane('v')})", add(mul(rotl("{x}", 27), u(_P[0])), u(_P[3])),
        f"xor({{x}}, {lane('bucket::UBIGINT')})", add(mul(rotl("{x}", 27), u(_P[0])), u(_P[3])),
        mul(f"xor({{x}}, {shr('{x}', 33)})", u(_P[1])), mul(f"xor({{x}}, {shr('{x}', 29)})", u(_P[2])), f"xor({{x}}, {shr('{x}', 32)})",
    ]
    return head + ", " + chain("dense", "xx", "v", steps, "hx") + f", pos AS (SELECT *, (hx % {u(p.sketch_bits)})::BIGINT AS position FROM xx)"


def words(p: SketchParams, buckets: int) -> str:
    """CTEs up to words (id, word, w), all words of all sketches, those of sequences without a k-mer too."""
    return positioned(p, buckets, True) + (
        f", flips AS (SELECT id, position // 64 AS word, bit_xor(1::UBIGINT << (position % 64)::UBIGINT) AS w FROM pos GROUP BY ALL), "
        f"words AS MATERIALIZED (SELECT i.id, x.word::INTEGER AS word, coalesce(f.w, 0::UBIGINT) AS w FROM (SELECT DISTINCT id FROM dense) i CROSS JOIN range(0, {p.sketch_bits // 64}) x(word) LEFT JOIN flips f ON f.id = i.id AND f.word = x.word)"
    )


def raw_estimate(p: SketchParams, h: str = "hamming") -> str:
    n, L = float(p.sketch_bits), float(bucket_count(p.sketch_bits, p.j0))
    return f"(1.0::DOUBLE + {n!r}::DOUBLE / (4.0::DOUBLE * {L!r}::DOUBLE) * ln(greatest(1e-12::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * {h} / {n!r}::DOUBLE)))"


def estimates(p: SketchParams, theta: str) -> str:
    """(a, b, hamming, raw, estimate, clipped) of sketch pairs."""
    return f"""WITH {words(p, p.buckets)}, ham AS (SELECT a.id AS a, b.id AS b, sum(bit_count(xor(a.w, b.w)))::BIGINT AS hamming FROM words a JOIN words b ON a.word = b.word AND {theta} GROUP BY ALL),
e AS (SELECT *, {raw_estimate(p)} AS raw FROM ham)
SELECT a, b, hamming, round(raw, 9) AS raw, round(least(greatest(raw, 0.0), 1.0), 9) AS est, 2 * hamming >= {p.sketch_bits} AS clipped FROM e"""


def neighbour_ids(source: str) -> str:
    return f"SELECT id AS pair_idx, nxt FROM (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM (SELECT DISTINCT id FROM {source})) WHERE nxt IS NOT NULL"


def oph_pairs(p: SketchParams, select: str) -> str:
    return f"""WITH {densified(p, p.buckets, zeros=True)}, nb AS ({neighbour_ids('dense')})
SELECT pair_idx, {select} FROM nb JOIN dense x ON x.id = nb.pair_idx JOIN dense y ON y.id = nb.nxt AND y.bucket = x.bucket GROUP BY pair_idx"""


def evaluation(p: SketchParams) -> str:
    L = p.buckets
    return f"""WITH {words(p, L)}, nb AS ({neighbour_ids('dense')}),
full_ AS (SELECT s.id, count(m.id) AS n FROM (SELECT DISTINCT id FROM dense) s LEFT JOIN minima m ON m.id = s.id GROUP BY s.id),
ham AS (SELECT pair_idx, nxt, sum(bit_count(xor(a.w, b.w)))::BIGINT AS h FROM nb JOIN words a ON a.id = pair_idx JOIN words b ON b.id = nxt AND b.word = a.word GROUP BY ALL),
mis AS (SELECT pair_idx, count(*) FILTER (x.v <> y.v) AS m FROM nb JOIN dense x ON x.id = pair_idx JOIN dense y ON y.id = nxt AND y.bucket = x.bucket GROUP BY pair_idx)
SELECT pair_idx, pair_idx AS file1, nxt AS file2, round(least(greatest({raw_estimate(p, 'h')}, 0.0), 1.0), 9) AS jaccard_odd, round(1.0 - m::DOUBLE / {L}, 9) AS jaccard_oph,
round({raw_estimate(p, 'h')}, 9) AS odd_raw_estimate, h AS hamming_distance, {p.sketch_bits}::BIGINT AS sketch_bits, {L}::BIGINT AS num_buckets, m::BIGINT AS oph_mismatches,
({L} - l.n)::BIGINT AS empty_buckets_left, ({L} - r.n)::BIGINT AS empty_buckets_right, {L}::BIGINT AS oph_num_buckets, {L * 64}::BIGINT AS oph_storage_bits,
({L} - l.n)::BIGINT AS oph_empty_buckets_left, ({L} - r.n)::BIGINT AS oph_empty_buckets_right, (2 * h >= {p.sketch_bits})::INTEGER AS clipped, {p.seed}::BIGINT AS hash_seed
FROM ham JOIN mis USING (pair_idx) JOIN full_ l ON l.id = pair_idx JOIN full_ r ON r.id = nxt"""


OBS = """(SELECT l_linenumber::BIGINT AS replicate, l_orderkey AS pair_id, CASE l_returnflag WHEN 'A' THEN 1024 WHEN 'N' THEN 2048 ELSE 4096 END AS sketch_size,
(l_suppkey % 3 * 10 + 11)::INTEGER AS kmerlen, 0.5::DOUBLE AS j0, l_quantity / 50 AS jaccard_true, l_quantity / 50 + l_discount - 0.05::DOUBLE AS jaccard_odd,
l_quantity / 50 + l_tax - 0.04::DOUBLE AS jaccard_base, (l_discount > 0.09::DOUBLE)::INTEGER AS clipped, l_partkey % 10 / 10.0::DOUBLE AS empty_rate FROM lineitem)"""


def binned() -> str:
    case = " ".join(f"WHEN jaccard_true >= {lo!r}::DOUBLE AND jaccard_true < {hi!r}::DOUBLE THEN {i}" for i, (lo, hi) in enumerate(zip(EDGES, EDGES[1:])))
    return f"(SELECT *, CASE WHEN jaccard_true = {EDGES[-1]!r}::DOUBLE THEN {len(EDGES) - 2} {case} END AS bin_id FROM {OBS})"


def pooled(by: str, source: str) -> str:
    return f"""WITH r AS (SELECT {by}, replicate, count(*) AS n, sum((jaccard_odd - jaccard_true) ** 2) AS s1, sum((jaccard_base - jaccard_true) ** 2) AS s2, sum(clipped) AS c FROM {source} GROUP BY {by}, replicate)
SELECT {by}, count(*) AS replicates, sum(n)::BIGINT AS n_total, round(sqrt(sum(s1) / sum(n)), 9) AS rmse1, round(sqrt(sum(s2) / sum(n)), 9) AS rmse2,
round(sqrt(sum(s1) / sum(n)) - sqrt(sum(s2) / sum(n)), 9) AS rmse_difference, sum(c)::BIGINT AS clip_count, round(sum(c)::DOUBLE / sum(n)::DOUBLE, 9) AS clip_rate FROM r GROUP BY {by}"""


def macro(estimate: str) -> str:
    return f"""SELECT sketch_size, count(*) AS replicates, sum(n)::BIGINT AS n_total, round(sqrt(avg(mse)), 9) AS rmse, round(avg(bias), 9) AS bias, round(avg(clip), 9) AS clip_rate, round(avg(empty), 9) AS empty_rate
FROM (SELECT sketch_size, replicate, avg(({estimate} - jaccard_true) * ({estimate} - jaccard_true)) AS mse, avg({estimate} - jaccard_true) AS bias, avg(clipped) AS clip, avg(empty_rate) AS empty, count(*) AS n FROM {OBS} GROUP BY ALL) GROUP BY sketch_size"""


def picks(draws: list) -> str:
    """(g, b, at): the replicates (by place) that resample b of group g takes."""
    rows = ", ".join(f"({g}, {b}, {at})" for g, group in enumerate(draws) for b, row in enumerate(group) for at in row)
    return f"picks(g, b, spot) AS (VALUES {rows})"


def binned_intervals(edges: list[float], resamples: int, seed: int) -> str:
    """Intervals of seven replicates in every bin of three sizes, which the tables have."""
    bins = len(edges) - 1
    case = " ".join(f"WHEN jaccard_true >= {lo!r}::DOUBLE AND jaccard_true < {hi!r}::DOUBLE THEN {i}" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    draws = [np.random.default_rng(seed + g).integers(0, 7, size=(resamples, 7)) for g in range(3 * bins)]
    at = lambda c: f"list_extract([{', '.join(f'{e!r}::DOUBLE' for e in edges)}], bin_id + {c})"
    ends = ", ".join(f"round(quantile_cont({x}, {q}), 9) AS {n}_{end}" for x, n in (("e1", "rmse1"), ("e2", "rmse2"), ("e1 - e2", "difference")) for q, end in ((0.025, "low"), (0.975, "high")))
    return f"""WITH o AS (SELECT *, CASE WHEN jaccard_true = {edges[-1]!r}::DOUBLE THEN {bins - 1} {case} END AS bin_id FROM {OBS}),
r AS (SELECT sketch_size, bin_id, replicate, count(*) AS n, sum((jaccard_odd - jaccard_true) ** 2) AS s1, sum((jaccard_base - jaccard_true) ** 2) AS s2, sum(clipped) AS c FROM o GROUP BY ALL),
k AS (SELECT *, dense_rank() OVER (ORDER BY sketch_size, bin_id) - 1 AS g, row_number() OVER (PARTITION BY sketch_size, bin_id ORDER BY replicate) - 1 AS spot FROM r), {picks(draws)},
e AS (SELECT sketch_size, bin_id, b, sqrt(sum(s1) / sum(n)) AS e1, sqrt(sum(s2) / sum(n)) AS e2 FROM k JOIN picks USING (g, spot) GROUP BY ALL), i AS (SELECT sketch_size, bin_id, {ends} FROM e GROUP BY ALL),
p AS (SELECT sketch_size, bin_id, count(*) AS replicates, sum(n)::BIGINT AS n_total, round(sqrt(sum(s1) / sum(n)), 9) AS rmse1, round(sqrt(sum(s2) / sum(n)), 9) AS rmse2,
  round(sqrt(sum(s1) / sum(n)) - sqrt(sum(s2) / sum(n)), 9) AS rmse_difference, sum(c)::BIGINT AS clip_count, round(sum(c)::DOUBLE / sum(n)::DOUBLE, 9) AS clip_rate FROM r GROUP BY ALL)
SELECT p.* REPLACE (bin_id::INTEGER AS bin_id), i.* EXCLUDE (sketch_size, bin_id), round({at(1)}, 9) AS bin_lo, round({at(2)}, 9) AS bin_hi, round(({at(1)} + {at(2)}) / 2, 9) AS bin_center FROM p JOIN i USING (sketch_size, bin_id)"""


def macro_intervals(resamples: int, seed: int) -> str:
    draw = np.random.default_rng(seed)
    draws = [[draw.integers(0, 7, size=7) for _ in range(resamples)] for _ in range(3)]
    ends = ", ".join(f"round(quantile_cont({x}, {q}), 9) AS {n}_ci_{end}" for x, n in (("sqrt(m)", "rmse"), ("s", "bias"), ("c", "clip")) for q, end in ((0.025, "low"), (0.975, "high")))
    return f"""WITH r AS (SELECT sketch_size, replicate, avg((jaccard_odd - jaccard_true) * (jaccard_odd - jaccard_true)) AS mse, avg(jaccard_odd - jaccard_true) AS bias, avg(clipped) AS clip FROM {OBS} GROUP BY ALL),
k AS (SELECT *, dense_rank() OVER (ORDER BY sketch_size) - 1 AS g, row_number() OVER (PARTITION BY sketch_size ORDER BY replicate) - 1 AS spot FROM r), {picks(draws)},
e AS (SELECT sketch_size, b, avg(mse) AS m, avg(bias) AS s, avg(clip) AS c FROM k JOIN picks USING (g, spot) GROUP BY ALL), i AS (SELECT sketch_size, {ends} FROM e GROUP BY ALL)
SELECT * FROM ({macro('jaccard_odd')}) JOIN i USING (sketch_size)"""


def simple_mix(table: str, key: str, keep: str) -> str:
    return f"WITH m0 AS (SELECT {keep}, ({key})::UBIGINT AS k FROM {table}), {chain('m0', 'm', 'k', mix_steps(), 'h')}"


def checks() -> str:
    key = "replicate, sketch_size, pair_id"
    return f"""WITH o AS {OBS}, g AS (SELECT replicate, sketch_size, count(*) AS n, count(DISTINCT pair_id) AS d, min(pair_id) AS lo, max(pair_id) AS hi FROM o GROUP BY ALL), v AS (
SELECT 'rows' AS rule FROM (SELECT count(*) AS n FROM o) WHERE n <> 21
UNION ALL SELECT 'unique' FROM (SELECT {key} FROM o GROUP BY {key} HAVING count(*) > 1)
UNION ALL SELECT 'pairs' FROM g WHERE n <> 1 OR d <> 1 OR lo <> 1 OR hi <> 1
UNION ALL SELECT 'design' FROM o WHERE replicate NOT BETWEEN 1 AND 7
UNION ALL SELECT 'range' FROM o WHERE NOT (jaccard_true BETWEEN 0 AND 1 AND jaccard_odd BETWEEN 0 AND 1))
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


def oracle_sql() -> dict[str, str]:
    W1 = r"[\x09-\x0D\x20]"
    bench, docs = seqs(), seqs("documents")
    only_acgt = " WHERE regexp_full_match(kmer, '[ACGT]+')"
    stripped = "regexp_replace(url, '[?#].*$', '')"
    out_path = f"'/out/' || regexp_replace(regexp_extract({stripped}, '[^/]*$'), '\\.gz$', '') || '.sketch'"
    word_rows = lambda p: f"WITH {words(p, p.buckets)} SELECT id, word, {signed('w')} AS bits FROM words WHERE w <> 0"
    positions = lambda p, n: f"WITH {positioned(p, n)} SELECT id, bucket, position FROM pos"
    dense = f"WITH {densified(SMALL, SMALL.buckets)} SELECT id, bucket, {signed('v')} AS rank FROM dense"
    kernel = f"WITH {densified(SMALL, SMALL.buckets, zeros=True)} SELECT id, bucket, {signed('v')} AS rank FROM dense"
    minima = f"WITH {registers(SMALL, SMALL.buckets)} SELECT id, bucket, {signed('v')} AS rank FROM minima"
    dist = lambda theta: f"SELECT a::VARCHAR AS path1, b::VARCHAR AS path2, hamming, raw, est AS jaccard, clipped FROM ({estimates(SMALL, theta)})"
    pair = f"SELECT t.* FROM ({estimates(SMALL, 'a.id < b.id')}) t JOIN ({neighbour_ids('benchmark_ids')}) nb ON nb.pair_idx = t.a AND nb.nxt = t.b"
    pair = f"WITH benchmark_ids AS (SELECT item_id AS id FROM benchmark) {pair}"
    sup = "(SELECT DISTINCT l_suppkey AS id, l_partkey::VARCHAR AS kmer FROM lineitem)"
    all_pairs = lambda s: f"""WITH s AS {s}, n AS (SELECT id, count(*) AS n FROM s GROUP BY id), i AS (SELECT a.id AS id1, b.id AS id2, count(*) AS inter FROM s a JOIN s b ON a.kmer = b.kmer AND a.id < b.id GROUP BY ALL)
SELECT id1, id2, inter, x.n AS n1, y.n AS n2, round(inter::DOUBLE / (x.n + y.n - inter), 12) AS jaccard FROM i JOIN n x ON x.id = id1 JOIN n y ON y.id = id2"""  # noqa: E731
    return {
        "seq_translate": docs,
        "acgt_segments": f"SELECT doc_id, len(r)::BIGINT AS n_segments, length(array_to_string(r, ''))::BIGINT AS bases FROM (SELECT doc_id, regexp_extract_all(upper(regexp_replace(text, '{W1}', '', 'g')), '[ACGT]+') AS r FROM documents)",
        "kmer_explode": f"SELECT id, pos, kmer FROM {windows(bench, K)}",
        "kmer_revcomp": f"SELECT id, {rc('seq')} AS rc FROM ({docs})",
        "kmer_canonical": f"SELECT kmer, count(*) AS n FROM {windows(docs, 5)} GROUP BY kmer",
        "kmer_distinct_count": f"SELECT s.id, greatest(length(seq) - {K - 1}, 0)::BIGINT AS n_windows, coalesce(n, 0)::BIGINT AS n_distinct FROM ({docs}) s LEFT JOIN (SELECT id, count(*) AS n FROM {sets(docs, K)} GROUP BY id) USING (id)",
        "kmer_set_sizes": f"SELECT id, count(*) AS n FROM {sets(bench, K)} GROUP BY id",
        "kmer_packed": f"SELECT id, {pack('kmer', 1, K)} AS kmer FROM {sets(bench, K)}",
        "kmer_packed_wide": f"SELECT id, {pack('kmer', 1, 8)} AS hi, {pack('kmer', 9, 32)} AS lo FROM {sets(bench, 40)}",
        "kmer_packed_text": f"""WITH c AS (SELECT doc_id AS id, string_split(upper(text), '') AS c FROM documents),
w AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]))) AS w FROM c),
k AS (SELECT DISTINCT id, least(w, {rc('w')}) AS kmer FROM w{only_acgt.replace('kmer', 'w')}) SELECT id, {pack('kmer', 1, 2)} AS kmer FROM k""",
        "kmer_non_acgt_filter": "SELECT kmer, count(*) AS n FROM " + sets("SELECT doc_id AS id, upper(text) AS seq FROM documents", 4, " WHERE regexp_full_match(kmer, '[ACGTacgt]+')") + " GROUP BY kmer",
        "exact_jaccard_all_pairs": all_pairs(sets(bench, K)),
        "exact_jaccard_bipartite": bipartite(sets(bench, 31), sets(docs, 31)),
        "kmer_index_append": f"SELECT id, coalesce(n, 0)::BIGINT AS n, CASE WHEN id % 2 = 1 THEN 1 ELSE 2 END::BIGINT AS batch FROM ({bench}) LEFT JOIN (SELECT id, count(*) AS n FROM {sets(bench, 40)} GROUP BY id) USING (id)",
        "kmer_index_probe": bipartite(sets(bench, 31), sets(docs, 31)),
        "kmer_index_records": f"""SELECT id, count(*) AS n, count(*) AS n_read, sha256(unhex(string_agg(printf('%016x%016x', hi, lo), '' ORDER BY kmer))) AS sha256
FROM (SELECT id, kmer, {pack('kmer', 1, 8, False)} AS hi, {pack('kmer', 9, 32, False)} AS lo FROM {sets(bench, 40)}) GROUP BY id""",
        "exact_jaccard_pairlist": f"WITH {pairwise(neighbours('SELECT item_id AS id FROM benchmark'), sets(bench, 11))} SELECT pair_idx, \"left\", \"right\", inter, n1, n2, {JACCARD} AS jaccard FROM r",
        "exact_nearest_neighbor": f"SELECT query, arg_min(db, (-jaccard, db)) AS nn, max(jaccard) AS jaccard FROM ({bipartite(sets(bench, K), sets(bench, K), 'WHERE q.id <> d.id')}) GROUP BY query",
        "basename_exclusion_join": bipartite(sets(bench, K), sets(bench, K), "WHERE q.id % 10 <> d.id % 10"),
        "truth_columns": f"""WITH {pairwise(neighbours('SELECT item_id AS id FROM benchmark'), sets(bench, 11))} SELECT pair_idx AS pair_id, "left" % 7 AS mutation_count, "left" % 5 * 100 AS genome_length,
CASE WHEN "left" % 5 > 0 THEN round(("left" % 7)::DOUBLE / ("left" % 5 * 100), 12) ELSE 0.0 END::DOUBLE AS mutation_rate, {JACCARD} AS jaccard_true, n1 AS kmers1_count, n2 AS kmers2_count, inter AS intersection, n1 + n2 - inter AS "union" FROM r""",
        "mix64": simple_mix("lineitem", "l_orderkey * 8 + l_linenumber", "l_orderkey, l_linenumber") + f" SELECT l_orderkey, l_linenumber, {signed('h')} AS h FROM m",
        "rotate_left_right": simple_mix("orders", "o_orderkey", "o_orderkey") + f" SELECT o_orderkey, {signed(rotl('h', 13))} AS left13, {signed(rotl('h', 51))} AS right13, {signed('h')} AS left64 FROM m",
        "unsigned_min": simple_mix("lineitem", "l_orderkey", "l_suppkey") + f" SELECT l_suppkey, {signed('min(h)')} AS least FROM m GROUP BY l_suppkey",
        "unsigned_mod": simple_mix("orders", "o_orderkey", "o_orderkey") + " SELECT o_orderkey, " + ", ".join(f"(h % {u(n)})::BIGINT AS m{n}" for n in (64, 192, 1000)) + " FROM m",
        "nt_hash_kmer": f"SELECT id, pos, {signed('h')} AS hash FROM {hashes()}",
        "oph_bucket_min": minima,
        "streaming_registers": minima,
        "oph_nonempty_count": f"WITH {registers(SMALL, SMALL.buckets)} SELECT id, count(*) AS nonempty FROM minima GROUP BY id",
        "oph_densify": dense,
        "oph_registers_kernel": kernel,
        "oph_match_estimate": oph_pairs(SMALL, f"count(*) FILTER (x.v <> y.v) AS mismatches, round(1.0 - (count(*) FILTER (x.v <> y.v))::DOUBLE / {SMALL.buckets}, 12) AS jaccard"),
        "bbit_estimate": oph_pairs(SMALL, "round(greatest(0.0, ((count(*) FILTER (x.v % 16::UBIGINT = y.v % 16::UBIGINT))::DOUBLE / count(*) - 0.0625::DOUBLE) / 0.9375::DOUBLE), 12) AS jaccard"),
        "bit_position_value": positions(SMALL, SMALL.buckets),
        "bit_position_stripe": positions(STRIPE, 64),
        "bit_position_mix": positions(MIX, MIX.buckets),
        "odd_sketch_words": word_rows(SMALL),
        "odd_sketch_kernel": word_rows(SMALL),
        "seeded_sketch": word_rows(SEEDED),
        "hamming_popcount": f"SELECT a::VARCHAR AS path1, b::VARCHAR AS path2, hamming FROM ({estimates(SMALL, 'a.id < b.id')})",
        "odd_estimate": f"SELECT a AS pair_idx, hamming, raw, est AS estimate, clipped FROM ({pair})",
        "dist_all_to_all": dist("a.id < b.id"),
        "dist_bipartite": dist("true"),
        "dist_pairlist": f"SELECT a AS pair_idx, a::VARCHAR AS \"left\", b::VARCHAR AS \"right\", est AS jaccard FROM ({pair})",
        "eval_pairlist": evaluation(SMALL),
        "seeded_eval": evaluation(SEEDED),
        "jaccard_binning": f"""SELECT sketch_size, bin_id::INTEGER AS bin_id, list_extract([{', '.join(f'{e!r}::DOUBLE' for e in EDGES)}], bin_id + 1) AS bin_lo, list_extract([{', '.join(f'{e!r}::DOUBLE' for e in EDGES)}], bin_id + 2) AS bin_hi,
(list_extract([{', '.join(f'{e!r}::DOUBLE' for e in EDGES)}], bin_id + 1) + list_extract([{', '.join(f'{e!r}::DOUBLE' for e in EDGES)}], bin_id + 2)) / 2 AS bin_center, count(*) AS n FROM {binned()} WHERE bin_id IS NOT NULL GROUP BY ALL""",
        "pooled_rmse": pooled("sketch_size", OBS),
        "pooled_rmse_bins": pooled("sketch_size, bin_id", binned()),
        "macro_rmse_bias": macro("jaccard_odd"),
        "coverage_fraction_median": f"SELECT kmerlen, count(*) AS n_total, round(quantile_cont(jaccard_true, 0.5), 9) AS median_true_jaccard, round(avg((jaccard_true >= j0)::INTEGER), 9) AS fraction_j_ge_j0 FROM {OBS} GROUP BY kmerlen",
        "method_pivot": f"""SELECT sketch_size, round(o, 9) AS odd, round(b, 9) AS oph, round(o - b, 9) AS rmse_difference FROM (SELECT sketch_size, sqrt(avg(o)) AS o, sqrt(avg(b)) AS b FROM
(SELECT sketch_size, replicate, avg((jaccard_odd - jaccard_true) ** 2) AS o, avg((jaccard_base - jaccard_true) ** 2) AS b FROM {OBS} GROUP BY ALL) GROUP BY sketch_size)""",
        "observation_checks": checks(),
        "schedule": "SELECT r::BIGINT AS replicate, k::INTEGER AS kmerlen, s::INTEGER AS sketch_size, 2000 + r::BIGINT * 100000 AS genome_seed, r::BIGINT AS hash_seed FROM (SELECT DISTINCT l_linenumber AS r FROM lineitem), (SELECT unnest([21, 31, 64]) AS k), (SELECT unnest([2048, 8192, 32768]) AS s)",
        "pooled_bin_intervals": binned_intervals([0.0, 0.3, 0.6, 0.9, 1.0], 50, 10_007),
        "macro_intervals": macro_intervals(50, 7),
        "sketch_binary_roundtrip": "SELECT item_id::VARCHAR AS path, true AS same FROM benchmark",
        "fasta_parse": f"SELECT conv_id::VARCHAR AS path, count(*) AS n_records, sum(length({TRANSLATE.format(t='text')}))::BIGINT AS bases FROM conversations GROUP BY conv_id",
        "fasta_scan": f"SELECT id, len(r)::BIGINT AS n_segments, length(array_to_string(r, ''))::BIGINT AS bases FROM (SELECT doc_id::VARCHAR AS id, regexp_extract_all(replace({TRANSLATE.format(t='text')}, 'TTTT', 'NNTT'), '[ACGT]+') AS r FROM documents) WHERE len(r) > 0",
        "ordered_output": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, trunc(o_totalprice * 100), o_orderkey) - 1 AS place FROM orders)
SELECT (place // 700)::BIGINT AS file, count(*) AS n, arg_min(o_orderkey, place) AS first_key, arg_max(o_orderkey, place) AS last_key FROM r GROUP BY ALL""",
        "assembly_filter_url": "SELECT c_name AS assembly_accession, 'https://host/genomes/' || c_name || '/' || c_name || '_genomic.fna.gz' AS genomic_fna_url, c_name || '_genomic.fna.gz' AS local_filename FROM customer WHERE c_nationkey NOT IN (3, 4) AND c_name <> 'Customer#000000001'",
        "manifest_status_counts": "SELECT o_orderstatus AS status, count(*) AS n, sum(o_custkey)::BIGINT AS bytes FROM orders GROUP BY ALL",
        "duplicate_output_guard": f"SELECT output, count(*) AS n, list_extract(list_sort(list(page_id)), 1) AS first_idx, list_extract(list_sort(list(page_id)), 2) AS second_idx FROM (SELECT page_id, {out_path} AS output FROM pages) GROUP BY output HAVING count(*) > 1",
        "path_functions": r"SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g') AS safe, regexp_replace(url, '\.gz$', '') AS plain, ends_with(url, '.gz') AS gz FROM pages",
        "genome_list": """SELECT n AS idx, printf('local_%06d', n) AS name, CASE WHEN page_id % 2 = 0 THEN '/b/p' ELSE '/data/p' END || page_id || '.fna' AS path
FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages) WHERE page_id % 5 <> 0 AND page_id % 7 <> 0""",
        "download_manifest": """SELECT '/data/g/' || user_id || '.gz' AS path, max(event_id)::VARCHAR AS assembly_accession, 'u/' || arg_max(event_type, event_id) AS genomic_fna_url
FROM events WHERE user_id % 2 = 1 GROUP BY user_id UNION ALL SELECT '/data/' || r_name, '', '' FROM region""",
        "missing_pair_check": "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
        "last_row_by_key": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
        "part_set_jaccard": all_pairs(sup),
    }
