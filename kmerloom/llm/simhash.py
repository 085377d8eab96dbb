"""SimHash near-dedup with sharded vantage-point trees.

A tree splits fingerprints by their Hamming distance to a vantage point: those within the
median distance go left, the others right.  Vantage points (the candidate that spreads
distances most) and medians come from a bounded sample of the fingerprints; every fingerprint
is placed.  A tree has a fixed number of levels and its leaves are shards.  A fingerprint lives in one shard.
By the triangle inequality two fingerprints within radius r have distances to any vantage
point that differ by r at most: a fingerprint of a left branch whose ball crosses the median is
sent into the right branch as a query, and a query enters every branch that its ball
overlaps.  Every shard is cut once more without any overlap: fingerprints within r of each other
are at distance zero in one of r + 1 disjoint parts of the tree's bits, so each is sent once for
each part, to a bucket named by its bits there.  Only the number of buckets grows with the data: how often a fingerprint is
sent does not depend on how many there are, as long as a part has more values than a shard needs buckets (about 10 ** 10 fingerprints up to
radius 2, 10 ** 8 at radius 11).  A bucket that is still too large, since its
fingerprints agree in the part, is cut in tiles, which all of the bucket search.  Inside a bucket the triangle
bound is applied to the distances of groups of
bits, summed up, and every surviving pair is compared exactly, in all 64 bits.

Up to radius 2 one tree measures all 64 bits, in groups of a byte inside a shard.  For a larger
radius r there are r // 3 + 1 trees over disjoint parts of the bits, in groups of one bit: two
fingerprints within r agree up to 2 bits in one part.  Work inside a shard grows with the
square of its fingerprints over 2 ** (64 // trees), so the radius sets the price.

A shard returns the minimum spanning forest of its links, never all pairs, which keeps
connectivity and stays linear in the size of a group of copies.  Where links must also pass a
Jaccard threshold the forest is only a first pass, and an exact prefix-filtered search finds
the pairs that it leaves apart.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import small
from .common import attach, discard, few_texts, give_back, materialize

Level = tuple[int, int]  # (lowest bit, number of bits)

#: Fingerprints sampled for the trees, candidates for each vantage point, levels of one tree and of several.
SEEDS, CANDIDATES, DEEP, SHALLOW = 2_000, 12, 3, 2
#: Fingerprints aimed at in a bucket of a shard, and candidate pairs compared at once.
TILE_ROWS, CHUNK = 1_000_000, 400_000
#: Texts sampled for frequent shingles, how many of these are told apart, and prefix entries in a bucket.
SAMPLE, COMMON, ENTRIES = 4_000, 20_000, 250_000
#: One shingle of so many (by its hash) is looked up in all sets, and those looked up together, about.
PICK, LOOKED_UP = 3, 1_000_000
#: Bits of the parity sketch of a set (a power of two).
SKETCH = 512


def hashes(text: bytes | None, width: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a UTF-8 text, in order; none for a text without words."""
    import xxhash

    words = (text or b"").lower().split()  # bytes.lower folds A-Z only; bytes.split cuts at \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42)), dtype=np.uint64)


def fold(h: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingle hashes; zero of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a UTF-8 text."""
    return fold(hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def trees(radius: int) -> list[tuple[list[Level], int]]:
    """(levels, radius) of each tree whose searches together find every pair within ``radius``."""
    if radius <= 2:
        return [([(8 * i, 8) for i in range(8)], radius)]
    n = radius // 3 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [([(at, 1) for at in range(lo, hi)], radius // n) for lo, hi in zip(edges, edges[1:])]


def rings(fp: np.ndarray, levels: list[Level], vantage: int) -> np.ndarray:
    """Distance of each level's bits to those of the vantage point: (n, levels)."""
    x = fp ^ np.uint64(vantage)
    out = np.zeros((len(fp), len(levels)), np.int64)
    for i, (at, bits) in enumerate(levels):
        out[:, i] = np.bitwise_count(x >> np.uint64(at) & np.uint64((1 << bits) - 1))
    return out


def scales(levels: list[Level]) -> np.ndarray:
    """Weights that turn ring numbers into one cell number."""
    return np.cumprod([1, *(bits + 1 for _, bits in levels)])[:-1].astype(np.int64)


def moves(levels: list[Level], reach: int) -> np.ndarray:
    """All ring differences over ``levels`` whose absolute values add up to at most ``reach``."""
    out = [((), 0)]
    for _, bits in levels:
        out = [((*m, d), used + abs(d)) for m, used in out for d in range(-min(bits, reach - used), min(bits, reach - used) + 1)]
    return np.array([m for m, _ in out], dtype=np.int64).reshape(len(out), len(levels))


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Indices of a minimum spanning forest of the links (a, b) of weight d over n nodes."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def flat() -> None:
        nonlocal parent
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up

    order, kept = np.argsort(d, kind="stable"), []
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        flat()
        for i in part[parent[a[part]] != parent[b[part]]]:
            x, y = root(int(a[i])), root(int(b[i]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(i)
    return np.array(kept, dtype=np.int64)


def shard_links(home: np.ndarray, query: np.ndarray, levels: list[Level], vantage: int, reach: int, radius: int, fixed: slice = slice(0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest of links within ``radius`` among ``home`` and between ``home`` and ``query``
    (unique uint64) whose rings on the ``levels`` differ by at most ``reach``, and not at all on
    the levels ``fixed``."""
    scale, most = scales(levels), np.array([bits for _, bits in levels])
    order = np.argsort(rings(home, levels, vantage) @ scale, kind="stable")
    home = home[order]
    key = rings(home, levels, vantage) @ scale
    nodes = np.concatenate([home, query])
    probe = rings(nodes, levels, vantage)
    start = np.arange(len(nodes))
    if len(query):  # nearly sorted searches stay in cache
        start[len(home) :] = len(home) + np.argsort(probe[len(home) :] @ scale, kind="stable")
        probe = probe[start]
    found: list[tuple[np.ndarray, ...]] = []
    held = 0
    cell = probe @ scale
    column = np.ascontiguousarray(probe.T)
    every = moves(levels, reach)
    for m in every[~every[:, fixed].any(axis=1)]:
        ok = np.ones(len(cell), bool)
        for i in np.flatnonzero(m):
            ok &= column[i] + m[i] >= 0 if m[i] < 0 else column[i] + m[i] <= most[i]
        ok = np.flatnonzero(ok)
        k = cell[ok] + m @ scale
        lo, hi = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
        hit = hi > lo
        ok, lo, hi = start[ok[hit]], lo[hit], hi[hit]
        size = np.cumsum(hi - lo)
        cut = 0
        while cut < len(ok):  # expand ranges to pairs in bounded pieces
            end = max(cut + 1, int(np.searchsorted(size, (size[cut - 1] if cut else 0) + CHUNK, "right")))
            n = hi[cut:end] - lo[cut:end]
            left = np.repeat(ok[cut:end], n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[cut:end], n)
            d = np.bitwise_count(nodes[left] ^ nodes[right])
            link = np.flatnonzero((d <= radius) & ((left > right) | (left >= len(home))))
            found.append((left[link], right[link], d[link]))
            held += len(link)
            cut = end
            if held > 2_000_000:
                found = [_thin(found, len(nodes))]
                held = len(found[0][0])
    a, b, d = _thin(found, len(nodes)) if found else (np.zeros(0, np.int64),) * 3
    return nodes[a], nodes[b], d


def _thin(found: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    a, b, d = (np.concatenate(x) for x in zip(*found))
    keep = forest(a, b, d, n)
    return a[keep], b[keep], d[keep]


class Tree:
    """A vantage-point tree over the bits of ``levels``; leaves are numbered from 0.  Two
    fingerprints that differ by ``reach`` of these bits at most meet in one leaf."""

    def __init__(self, sample: np.ndarray, levels: list[Level], reach: int, depth: int):
        self.levels, self.reach, self.leaves = levels, reach, 0
        self.mask = np.uint64(sum(((1 << bits) - 1) << at for at, bits in levels))
        self.root = self._grow(sample, depth)
        self.vantage = self.root[0] if isinstance(self.root, tuple) else 0

    def _away(self, fp: np.ndarray, vantage: int) -> np.ndarray:
        return np.bitwise_count((fp ^ np.uint64(vantage)) & self.mask).astype(np.int64)

    def _grow(self, sample: np.ndarray, depth: int) -> tuple | int:
        """(vantage point, median distance, left, right), or the number of a leaf."""
        if depth and len(sample) > 4:
            picks = sample[:: max(1, len(sample) // CANDIDATES)]
            away = [self._away(sample, int(v)) for v in picks]
            best = max(range(len(picks)), key=lambda i: (float(away[i].std()), -i))
            d, median = away[best], int(np.median(away[best]))
            left = d <= median
            if not left.all():
                return int(picks[best]), median, self._grow(sample[left], depth - 1), self._grow(sample[~left], depth - 1)
        self.leaves += 1
        return self.leaves - 1

    def visits(self, fp: np.ndarray, queries: bool = True) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places of the fingerprints sent there, whether they live there)."""
        out: list[tuple[int, np.ndarray, np.ndarray]] = []

        def down(node, rows: np.ndarray, home: np.ndarray) -> None:
            if not len(rows):
                return
            if not isinstance(node, tuple):
                out.append((node, rows, home))
                return
            vantage, median, left, right = node
            d = self._away(fp[rows], vantage)
            lives_left = home & (d <= median)
            to_left = lives_left | (~home & (d - self.reach <= median))
            to_right = d + self.reach > median if queries else home & ~lives_left
            down(left, rows[to_left], home[to_left])
            down(right, rows[to_right], (home & ~lives_left)[to_right])

        down(self.root, np.arange(len(fp)), np.ones(len(fp), bool))
        return out


def stirred(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 up in which every bit of ``x`` counts."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)).astype(np.int64) & (2**62 - 1)


def thirds(levels: list[Level], reach: int) -> list[slice]:
    """``reach`` + 1 disjoint parts of the levels."""
    n = min(reach + 1, len(levels))
    return [slice(len(levels) * i // n, len(levels) * (i + 1) // n) for i in range(n)]


class Shards:
    """Where fingerprints go: tree, leaf, part of the tree's bits, bucket of the part's value, tile."""

    def __init__(self, sample: np.ndarray, radius: int, total: int):
        parts = trees(radius)
        self.trees = [Tree(sample, levels, reach, DEEP if len(parts) == 1 else SHALLOW) for levels, reach in parts]
        self.parts = [thirds(levels, reach) for levels, reach in parts]
        self.buckets = [max(1, -(-total // (TILE_ROWS * t.leaves))) for t in self.trees]
        #: Tiles of the buckets with more than twice TILE_ROWS homes, by key.
        self.tiles: dict[int, int] = {}

    def key(self, tree: int, leaf: int, part: int, bucket: np.ndarray) -> np.ndarray:
        return ((tree * 64 + leaf) * 64 + part) * (1 << 40) + bucket

    def place(self, key: int) -> tuple[Tree, slice]:
        """The tree and the part of a key."""
        tree, part = key // (1 << 40) // 64 // 64, key // (1 << 40) % 64
        return self.trees[tree], self.parts[tree][part]

    def visits(self, fp: np.ndarray, queries: bool = True):
        """(keys, places of the fingerprints sent there, whether they live there) of each leaf and part."""
        for tree, t in enumerate(self.trees):
            for leaf, rows, home in t.visits(fp, queries):
                for part, where in enumerate(self.parts[tree]):
                    own, n = t.levels[where], self.buckets[tree]
                    wide = sum(bits for _, bits in own)  # neighbouring bits
                    value = fp[rows] >> np.uint64(own[0][0]) & np.uint64((1 << wide) - 1)
                    # few values are dealt evenly only if each has a bucket of its own
                    bucket = value.astype(np.int64) if 1 << wide <= 4 * n else stirred(value) % n
                    yield self.key(tree, leaf, part, bucket), rows, home

    def sent(self, fp: np.ndarray):
        """(keys, tiles, places, whether they live there) of everything that is sent."""
        for key, rows, home in self.visits(fp):
            if not self.tiles:
                yield key, np.zeros(len(key), np.int32), rows, home
                continue
            n = np.array([self.tiles.get(k, 1) for k in key.tolist()], np.int64)
            mine = stirred(~fp[rows]) % n
            # a fingerprint of this bucket searches the tiles behind its own, a query all
            first = np.where(home, mine, 0)
            again = np.repeat(np.arange(len(key)), n - first)
            tile = np.arange(len(again)) - np.repeat(np.cumsum(n - first) - (n - first), n - first) + first[again]
            yield key[again], tile.astype(np.int32), rows[again], home[again] & (tile == mine[again])


def hamming_forest(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, other, distance): links that connect all distinct fingerprints within ``radius``."""
    seeds = [r.fp for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SEEDS).collect()]
    shards = Shards(np.array(seeds, np.int64).view(np.uint64), radius, fps.count())

    def unsigned(b: pa.RecordBatch) -> np.ndarray:
        return np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)

    def count(batches):
        for b in batches:
            for key, rows, _ in shards.visits(unsigned(b), queries=False):
                if len(key):
                    k, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["key", "n"])

    # only buckets of more than twice TILE_ROWS reach the driver: at most a row for so many fingerprints
    large = fps.select("fp").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * TILE_ROWS).collect()
    shards.tiles = {r.key: -(-r.n // TILE_ROWS) for r in large}

    def spread(batches):
        for b in batches:
            own = unsigned(b)
            for key, tile, rows, home in shards.sent(own):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tile), pa.array(own[rows].view(np.int64)), pa.array(home)], names=["key", "tile", "fp", "home"])

    def search(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy().view(np.uint64)
        home = t.column("home").to_numpy()
        tree, part = shards.place(t.column("key")[0].as_py())
        a, b, d = shard_links(fp[home], fp[~home], tree.levels, tree.vantage, tree.reach, radius, part)
        return pa.table({"fp": a.view(np.int64), "other": b.view(np.int64), "distance": d.astype(np.int32)})

    sent = fps.select("fp").mapInArrow(spread, "key long, tile int, fp long, home boolean")
    return sent.groupBy("key", "tile").applyInArrow(search, "fp long, other long, distance int")


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates large-star and small-star until the edges stop changing; each round is written
    to the shared folder, so lineage stays short and lost executors cost one round.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label)
    before = None
    for _ in range(max_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least_ = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least_, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        old, edges = edges, materialize(
            large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(),
            label,
        )
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out._written_at = edges._written_at
            return out
        before = now
    raise RuntimeError("components did not settle")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Texts without words (null, empty, blank) have fingerprint zero and link like any other; a
    text shorter than ``width`` words is one shingle.  Equal fingerprints collapse to one row
    before any search, so copies are never expanded.  Null ids get a row but never name a
    component that has another id.  Repeated rows link to themselves; an empty table gives no
    rows; extra columns are ignored.
    """
    own = materialize(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    fps = materialize(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    links = hamming_forest(fps, radius)
    comp = components(links.select(F.col("fp").alias("a"), F.col("other").alias("b")), "simhash-components")
    of_fp = fps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component"))
    least_ = of_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    found = materialize(of_fp.join(least_, "component").select("fp", "n", "component_id"), "simhash-found")
    return attach(own, found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def common_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, counts) of the shingles most frequent in a sample of about SAMPLE texts, by hash, and how many rows a sampled one stands for.
    They only order and deal shingles, so the sample decides how many candidates there are, not which links are found."""

    def run(batches):
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(t.as_py(), width)).view(np.int64))], names=["h"])

    part = max(1, rows.count() // SAMPLE)
    seen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).select(F.col("t").cast("binary").alias("t")).mapInArrow(run, "h long")
    top = seen.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(h)
    return h[order], n[order], part


def hot_shingles(common: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """(narrow hashes, tiles) of shingles that may have more than ENTRIES entries, by the sample."""
    h, n, part = common
    tiles = -(-n * part // ENTRIES)
    h, first = np.unique(h[tiles > 1] & np.uint64(2**48 - 1), return_index=True)
    return h, tiles[tiles > 1][first]


def prefix_size(n: int, similarity: float) -> int:
    """Shingles in the prefix of a set of ``n``: in any order of all shingles, two sets of Jaccard ``similarity`` or more have
    one in common within both prefixes."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def picked(grams: np.ndarray) -> np.ndarray:
    """Which shingles are looked up in all sets."""
    return (grams >> np.uint64(48)) % np.uint64(PICK) == 0


def parities(grams: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of SKETCH cells, as words: a shingle that only one of two sets has flips one
    bit, so sketches never differ in more bits than sets differ in shingles."""
    cell = (grams >> np.uint64(32)).astype(np.int64) & (SKETCH - 1)
    return np.packbits((np.bincount(cell, minlength=SKETCH) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def may_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sketches of the sets ``a`` and ``b`` (places in ``n`` and ``sketch``) allow Jaccard ``similarity``."""
    most = (1 - similarity) / (1 + similarity) * (n[a] + n[b]) + 1e-6
    away = [np.bitwise_count(sketch[a[at : at + CHUNK]] ^ sketch[b[at : at + CHUNK]]).sum(axis=1, dtype=np.int64) for at in range(0, len(a), CHUNK)]
    return np.concatenate([np.zeros(0, np.int64), *away]) <= most


def rarest(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray, int], size: int) -> np.ndarray:
    """The first ``size`` shingles (sorted) in the order of (frequency, hash)."""
    if not len(grams):
        return grams
    rank = np.zeros(len(grams), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], grams), len(common[0]) - 1)
        rank = np.where(common[0][at] == grams, common[1][at], 0)
    return grams[np.argsort(rank, kind="stable")[:size]]


def narrow(grams: np.ndarray) -> bytes:
    """The lower 48 bits of each hash: enough to find candidates, which are checked in full."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def profiles(rows: DataFrame, width: int, similarity: float, common: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """(id, fp, n, digest, sketch, picks, prefix): SimHash, size, digest and parities of the set of shingles, those that are looked
    up, and of the others as many as a prefix takes."""

    def run(batches):
        for b in batches:
            fp, n, digest, sketch, picks, prefix = [], [], [], [], [], []
            for t in b.column(1):
                h = hashes(t.as_py(), width)
                grams = np.unique(h)
                fp.append(fold(h))
                n.append(len(grams))
                digest.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                sketch.append(parities(grams).tobytes())
                mine, size = picked(grams), prefix_size(len(grams), similarity)
                picks.append(narrow(rarest(grams[mine], common, len(grams))))
                prefix.append(narrow(rarest(grams[~mine], common, size)))
            raw = [pa.array(c, pa.binary()) for c in (digest, sketch, picks, prefix)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), *raw], names=["id", "fp", "n", "digest", "sketch", "picks", "prefix"])
        give_back()

    return rows.select("id", F.col("t").cast("binary").alias("t")).mapInArrow(run, "id long, fp long, n int, digest binary, sketch binary, picks binary, prefix binary")


#: An element of a prefix: shingle, its set (id, component found so far, size) and its place there.
ENTRY = np.dtype([("gram", "u8"), ("id", "i8"), ("comp", "i8"), ("n", "i4"), ("place", "i4")])


def squeeze(x: np.ndarray) -> bytes:
    """Entries as compressed byte planes of each field, which repeat themselves."""
    return zstandard.compress(b"".join(np.ascontiguousarray(x[f]).view(np.uint8).reshape(len(x), x.dtype[f].itemsize).T.tobytes() for f in x.dtype.names), 1)


def expand(raw: bytes, kind: np.dtype = ENTRY) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(kind.itemsize, -1)
    out, at = np.empty(planes.shape[1], kind), 0
    for f in kind.names:
        wide = kind[f].itemsize
        out[f] = np.ascontiguousarray(planes[at : at + wide].T).view(kind[f]).ravel()
        at += wide
    return out


#: A shingle that is looked up and its set; a set and how many of these no other set has.
PICKED, LONE = np.dtype([("gram", "u8"), ("id", "i8")]), np.dtype([("id", "i8"), ("lone", "i8")])


def lone_picks(nodes: DataFrame, picks: int) -> DataFrame:
    """(id, lone): of the looked-up shingles of each row (id, picks), how many no other row has; ids are unique and there are about
    ``picks`` shingles.  A bucket of shingles answers each batch that asked, and a batch sums up its answers."""
    buckets = max(16, picks // LOOKED_UP)

    def ask(batches):
        for b in batches:
            grams = [widen(p.as_py()) for p in b.column(1)]
            size = np.array([len(g) for g in grams])
            if not size.sum():
                continue
            x = np.empty(size.sum(), PICKED)
            x["gram"], x["id"] = np.concatenate(grams), np.repeat(b.column(0).to_numpy(), size)
            bucket = (x["gram"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            x, bucket = x[order], bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            own = pa.array(np.full(len(first), b.column(0)[0].as_py()), pa.int64())  # an id names its batch
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), own, pa.array([squeeze(p) for p in np.split(x, first[1:])], pa.binary())], names=["bucket", "batch", "asked"])

    def counted(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], n[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
        out = np.empty(len(first), LONE)
        out["id"], out["lone"] = ids[first], np.add.reduceat(n, first) if len(first) else 0
        return out

    def answer(t: pa.Table) -> pa.Table:
        asked = [expand(a.as_py(), PICKED) for a in t.column("asked")]
        gram = np.concatenate([x["gram"] for x in asked])
        order = np.argsort(gram)
        new = gram[order][1:] != gram[order][:-1]
        lone = np.empty(len(gram), bool)
        lone[order] = np.append(True, new) & np.append(new, True)
        found = [counted(x["id"][at], np.ones(at.sum(), np.int64)) for x, at in zip(asked, np.split(lone, np.cumsum([len(x) for x in asked])[:-1]))]
        return pa.table({"batch": t.column("batch"), "lone": pa.array([squeeze(x) for x in found], pa.binary())})

    def sum_up(t: pa.Table) -> pa.Table:
        x = np.concatenate([expand(a.as_py(), LONE) for a in t.column("lone")])
        out = counted(x["id"], x["lone"])
        return pa.table({"id": out["id"], "lone": out["lone"]})

    asked = nodes.select("id", "picks").mapInArrow(ask, "bucket long, batch long, asked binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "batch long, lone binary")
    return answers.groupBy("batch").applyInArrow(sum_up, "id long, lone long")


def shared_prefixes(nodes: DataFrame, similarity: float) -> DataFrame:
    """(id, n, sketch, place, prefix): what is left of the prefix of each row (id, n, sketch, picks, prefix, lone) without the shingles known to be in
    no other set, and the place of its first shingle; rows without a rest go.

    Shingles have one order for all sets: those looked up that one set has, those not looked up, the others looked up.  The
    first are met by nobody, so a set with more of them than its prefix takes has no partner.  A set that comes to the last
    ones gives all it looked up behind the others, counted from place 0, which is no later than where they are."""

    def run(batches):
        for b in batches:
            place, rest = [], []
            for n, picks, prefix, lone in zip(*(b.column(c).to_pylist() for c in ("n", "picks", "prefix", "lone"))):
                left = max(0, prefix_size(n, similarity) - lone)
                short = 6 * left > len(prefix)
                place.append(0 if short else lone)
                rest.append(prefix + picks if short else prefix[: 6 * left])
            made = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(place, pa.int64()), pa.array(rest, pa.binary())], names=["id", "n", "sketch", "place", "prefix"])
            yield made.filter(pa.array([len(r) > 0 for r in rest], pa.bool_()))

    return nodes.select("id", "n", "sketch", "picks", "prefix", "lone").mapInArrow(run, "id long, n int, sketch binary, place long, prefix binary")


def neighbours(x: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids (smaller, larger) of different components that follow each other among the sets
    with a shingle of ``x``, in an order of its own for each shingle, unless sizes rule them
    out: fewer than entries."""
    with np.errstate(over="ignore"):
        mixed = (x["id"].astype(np.uint64) ^ x["gram"]) * np.uint64(0x9E3779B97F4A7C15)
    x = x[np.lexsort((mixed ^ mixed >> np.uint64(31), x["gram"]))]
    a, b = x[:-1], x[1:]
    ok = (a["gram"] == b["gram"]) & (a["comp"] != b["comp"]) & (np.minimum(a["n"], b["n"]) >= similarity * np.maximum(a["n"], b["n"]) - 1e-6)
    a, b = a["id"][ok], b["id"][ok]
    out = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return out[:, 0], out[:, 1]


def reach_of(n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """The largest size of a set that can have Jaccard ``similarity`` with a set of size ``n`` if
    their first shingle in common is at ``place`` of the latter."""
    return np.floor(np.minimum((n - place) * (1 + similarity) / similarity - n, n / similarity) + 1e-6).astype(np.int64)


def met(x: np.ndarray, similarity: float) -> np.ndarray:
    """Entries that can name the smaller set of a pair: those whose reach covers their own size."""
    return reach_of(x["n"], x["place"], similarity) >= x["n"]


def unique_pairs(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *parts]), axis=0)


def meetings(x: np.ndarray, similarity: float, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids (smaller, larger) of different components that share a shingle in ``x`` and
    that sizes and places do not rule out; with ``home``, those whose larger set (by size, then id) is marked there.

    Nothing of the required Jaccard is lost: the first shingle in common has at most
    min(size - place) in common from there on.  So every entry admits a range of sizes, and the
    smaller set must lie early enough in its own order; only entries with a partner of another component in
    range go on, and each lists either its range of sizes or the other components of its shingle, whichever is
    shorter."""
    order = np.lexsort((x["id"], x["n"], x["gram"]))
    x = x[order]
    home = np.ones(len(x), bool) if home is None else home[order]
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.cumsum(np.append(False, x["gram"][1:] != x["gram"][:-1])).astype(np.int64)
    by_comp = np.lexsort((x["comp"], gram))
    run = np.empty(len(x), np.int64)  # number of an entry's (shingle, component)
    run[by_comp] = np.cumsum(np.append(False, (gram[by_comp][1:] != gram[by_comp][:-1]) | (x["comp"][by_comp][1:] != x["comp"][by_comp][:-1])))
    n, reach = x["n"].astype(np.int64), reach_of(x["n"], x["place"], similarity)
    least_ = np.ceil(similarity * n - 1e-6).astype(np.int64)
    wide = int(max(n.max(), reach.max())) + 2

    small = np.flatnonzero(met(x, similarity))  # in the order of shingle, size and id
    sized = gram[small] * wide + n[small]
    comps = small[np.argsort(run[small] * wide + n[small], kind="stable")]
    sized_in_comp = run[comps] * wide + n[comps]
    a = np.flatnonzero(home & (reach >= least_))
    top = np.minimum(reach, n)[a]
    lo, hi = np.searchsorted(sized, gram[a] * wide + least_[a]), np.searchsorted(sized, gram[a] * wide + top, "right")
    own = np.searchsorted(sized_in_comp, run[a] * wide + top, "right") - np.searchsorted(sized_in_comp, run[a] * wide + least_[a])
    go = hi - lo > own
    a, lo, hi = a[go], lo[go], hi[go]
    # the other components of the shingle: before and behind the entry's own
    grams = gram[comps]
    first, last = np.searchsorted(grams, gram[a]), np.searchsorted(grams, gram[a], "right")
    mine, after = np.searchsorted(run[comps], run[a]), np.searchsorted(run[comps], run[a], "right")
    others = (mine - first) + (last - after) < hi - lo
    lists = [(small, a[~others], lo[~others], hi[~others]), (comps, a[others], first[others], mine[others]), (comps, a[others], after[others], last[others])]

    found: list[np.ndarray] = []
    held = 0
    for partners, i, at, end in lists:
        size = np.cumsum(end - at)
        cut = 0
        while cut < len(i):  # expand ranges to pairs in bounded pieces
            stop = max(cut + 1, int(np.searchsorted(size, (size[cut - 1] if cut else 0) + CHUNK, "right")))
            m = end[cut:stop] - at[cut:stop]
            p = np.repeat(i[cut:stop], m)
            q = partners[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(at[cut:stop], m)]
            # q before p in the order of size and id; both reach the other's size
            ok = (q < p) & (run[q] != run[p]) & (reach[p] >= n[q]) & (reach[q] >= n[p])
            u, v = x["id"][p[ok]], x["id"][q[ok]]
            found.append(np.column_stack([np.minimum(u, v), np.maximum(u, v)]))
            held += len(u)
            cut = stop
            if held > 2_000_000:
                found = [unique_pairs(found)]
                held = 0
    out = unique_pairs(found)
    return out[:, 0], out[:, 1]


def prefix_pairs(nodes: DataFrame, similarity: float, entries: int, pair_up=meetings, hot: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64),) * 2) -> DataFrame:
    """(a, b): every pair of rows (id, component, n, sketch, place, prefix) of different components that can have
    Jaccard ``similarity``, by prefix filtering (or those of `neighbours`) and by their sketches; about ``entries`` shingles are dealt to buckets by
    their hash, and the first of a row is at ``place`` of its set.

    ``hot`` are narrow hashes of shingles, sorted, that may have more entries than a bucket takes, and
    tiles for each: an entry goes to one tile of its shingle, by its id, and only entries that can name the smaller set of a pair go to all."""
    buckets = max(16, entries // ENTRIES)
    tiles = [np.int64(t) for t in hot[1]]
    begin = np.cumsum([buckets, *tiles])  # buckets of hot shingles come behind the others

    def tile_of(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return stirred(ids.view(np.uint64)) % n

    def deal_hot(x: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(hot[0], x["gram"]), len(hot[0]) - 1)
        is_hot = hot[0][at] == x["gram"]
        n = np.array(tiles)[at]
        tile = tile_of(np.ascontiguousarray(x["id"]), n)
        bucket = np.where(is_hot, begin[at] + tile, bucket)
        more = np.flatnonzero(is_hot & met(x, similarity))
        again = np.repeat(more, n[more] - 1)
        step = np.arange(len(again)) - np.repeat(np.cumsum(n[more] - 1) - (n[more] - 1), n[more] - 1)
        others = begin[at[again]] + (tile[again] + 1 + step) % n[again]
        return np.concatenate([x, x[again]]), np.concatenate([bucket, others])

    def deal(batches):
        for b in batches:
            prefix = [widen(p.as_py()) for p in b.column("prefix")]
            size = np.array([len(p) for p in prefix])
            if not size.sum():
                continue
            x = np.empty(size.sum(), ENTRY)
            x["gram"] = np.concatenate(prefix)
            for name, c in zip(("id", "comp", "n"), b.columns):
                x[name] = np.repeat(c.to_numpy(), size)
            x["place"] = np.arange(len(x)) - np.repeat(np.cumsum(size) - size - b.column("place").to_numpy(), size)
            bucket = (x["gram"] % np.uint64(buckets)).astype(np.int64)
            if len(tiles):
                x, bucket = deal_hot(x, bucket)
            order = np.argsort(bucket, kind="stable")
            x, bucket = x[order], bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            parts = np.split(x, first[1:])
            ids, sketch = b.column("id").to_numpy(), np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            by_id = np.argsort(ids)
            sketches = [sketch[by_id[np.searchsorted(ids, np.unique(p["id"]), sorter=by_id)]].tobytes() for p in parts]  # one for each set of a part
            raw = [pa.array(c, pa.binary()) for c in ([squeeze(p) for p in parts], sketches)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *raw], names=["bucket", "entries", "sketches"])

    def meet(t: pa.Table) -> pa.Table:
        parts, bucket = [expand(e.as_py()) for e in t.column("entries")], t.column("bucket")[0].as_py()
        x = np.concatenate(parts)
        if bucket >= buckets and pair_up is meetings:
            shingle = int(np.searchsorted(begin, bucket, "right")) - 1
            a, b = pair_up(x, similarity, tile_of(np.ascontiguousarray(x["id"]), tiles[shingle]) == bucket - begin[shingle])
        else:
            a, b = pair_up(x, similarity)
        ids, first = np.unique(x["id"], return_index=True)
        known = np.concatenate([np.unique(p["id"]) for p in parts])
        sketch = np.frombuffer(b"".join(t.column("sketches").to_pylist()), np.uint64).reshape(len(known), -1)[np.unique(known, return_index=True)[1]]
        keep = may_reach(np.searchsorted(ids, a), np.searchsorted(ids, b), x["n"][first], sketch, similarity)
        return pa.table({"a": a[keep], "b": b[keep]})

    dealt = nodes.select("id", "component", "n", "sketch", "place", "prefix").mapInArrow(deal, "bucket long, entries binary, sketches binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def similar(rows: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts' shingle sets have Jaccard ``similarity`` or more, written.  Texts
    travel, since they are smaller than their shingle hashes, but only those of listed ids, and a
    task gets few at a time: by number of rows, the two texts of each would fill the memory of an executor."""

    def verify(batches):
        sets: dict[int, np.ndarray] = {}  # the sets met last

        def grams(i: int, text: bytes | None) -> np.ndarray:
            got = sets.pop(i, None)
            if got is None:
                got = np.unique(hashes(text, width))
                if len(sets) >= 1_000:
                    del sets[next(iter(sets))]
            sets[i] = got
            return got

        for batch in batches:
            ok = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = grams(a, x), grams(b, y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
        sets.clear()
        give_back()

    listed = small(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())  # broadcast if a count finds few
    texts = rows.join(listed, "id", "left_semi").select("id", F.col("t").cast("binary").alias("t"))
    left, right = texts.select(F.col("id").alias("a"), F.col("t").alias("x")), texts.select(F.col("id").alias("b"), F.col("t").alias("y"))
    with few_texts(rows.sparkSession):
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "near-similar")


def jaccard_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 11, similarity: float = 0.8
) -> DataFrame:
    """(id, component): rows in groups of near duplicates, with the smallest id of the group.

    Rows are linked if the Jaccard similarity of their sets of ``width``-word shingles is
    ``similarity`` or more; every such link counts.  Equal sets collapse to the smallest id, and
    only these go on.  SimHash then joins most groups at little cost: fingerprints within
    ``radius`` bits are linked by a minimum spanning forest (closest pairs first), equal ones by a
    star, and each of these links is checked.  Whatever that leaves apart is searched exactly:
    a third of the shingles of each set are looked up in all sets, and those that no other set has fill most prefixes; of
    different groups that share a shingle in what is left of their prefixes, first some neighbours
    are checked, then all pairs that are still apart.  So ``radius`` sets only the work left to
    the second search.  Texts without words are equal to each other.  Ids must be unique; rows
    with a null id are in no group.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("id IS NOT NULL")
    common = common_shingles(rows, width)
    with few_texts(docs.sparkSession):
        own = materialize(profiles(rows, width, similarity, common), "near-profiles")
    groups = materialize(own.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")), "near-equal")
    sets = groups.select(F.col("least").alias("id"))  # one of each group goes on
    prints = materialize(own.select("id", "fp").join(sets, "id", "left_semi"), "near-prints")
    fps = materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "near-distinct")
    links = hamming_forest(fps, radius).select("fp", "other").distinct()
    far = links.join(fps, "fp").select("other", F.col("least").alias("a")).join(fps.withColumnRenamed("fp", "other"), "other").select("a", F.col("least").alias("b"))
    same = attach(prints, fps, "fp").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    pairs = materialize(far.unionByName(same).distinct(), "near-pairs")
    near = components(similar(rows, pairs, width, similarity), "near-components")
    length = lambda df, c: (df.agg(F.sum(F.length(c))).first()[0] or 0) // 6
    asking = own.select("id", "n", "sketch", "picks", "prefix").join(sets, "id", "left_semi")
    told = lone_picks(asking, length(own, "picks"))
    shared = materialize(shared_prefixes(asking.join(told, "id", "left").fillna(0, "lone"), similarity), "near-shared")
    entries = length(shared, "prefix")
    hot = hot_shingles(common)

    def apart(found: DataFrame, pair_up) -> DataFrame:
        """Candidates between the groups found so far."""
        placed = shared.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        return prefix_pairs(placed, similarity, entries, pair_up, hot)

    def joined(found: DataFrame, candidates: DataFrame) -> DataFrame:
        links = similar(rows, candidates, width, similarity).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return components(links, "near-components")

    # neighbours first: large groups of near copies fall together before all pairs are listed
    tried = materialize(apart(near, neighbours), "near-tried")
    nearer = joined(near, tried)
    rest = materialize(apart(nearer, meetings).join(tried, ["a", "b"], "left_anti"), "near-rest")
    last = joined(nearer, rest).withColumnRenamed("node", "least")
    # back to all rows of each set: only groups that say something
    told = groups.join(last, "least", "left").select("digest", "n", F.coalesce("component", "least").alias("component"), F.col("component").isNotNull().alias("near"))
    told = materialize(told.filter("near OR n > 1"), "near-told")
    for done in (prints, fps, pairs, near, shared, tried, nearer, rest):
        discard(done)
    return attach(own.select("id", "digest"), told, "digest").filter("near OR id <> component").select(F.col("id").alias(id_col), "component")
