"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

* Examples: a sample of at most ``max_examples`` training labels (smallest hash of the id), all
  of them indexed, clean ones too.
* Terms: every word (run of letters, lower-cased) of the examples, known by its 64-bit hash.  Words
  and beginnings of words (inflected languages) that are significantly and several times
  more frequent in toxic examples count in full; the others are scaled by ORDINARY, so that
  they decide where no such term does.  Equal texts count once, and of beginnings found in the
  same texts the longest stays.
* Vectors: ln(1 + occurrences in a hundred words) * idf over the terms in the whole text,
  and a constant component, so that one chance hit in a long text stays near the origin; unit
  length.  Document frequencies are counted over all documents.
* Search: examples are ordered so that similar ones share a block, and a block keeps the largest
  weight of each of the most common terms.  The postings of all other terms are added up;
  with the block's largest weights they bound every cosine in it.  Blocks are scored in full
  while their bound reaches the k-th best cosine, so the k nearest are exact.
* Score: votes weighted by 1 / (distance + a constant), shrunk towards the rate of toxic
  examples without any toxic term (the score of texts without a known word), then calibrated by
  a logistic curve fitted to the votes of examples that are left out of their own search.
  Examples tied at the k-th place share the votes that are left, so their ids decide nothing.
"""

from __future__ import annotations

import gc
import sys
import threading
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import spread
from .common import discard, few_texts, give_back, materialize

#: Bytes that end a word: all of ASCII but letters; other characters count as letters, except MARKS.
_BLANKED = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
MARKS = [c.encode() for c in "\xa0¡¿«»–—‘’“”„…"]
STEMS = range(3, 9)
#: Weight of words that are not selected, as a part of that of selected terms.
ORDINARY = 0.3
#: Weight of the constant component.
CONSTANT = 2.0
#: Terms held densely, examples in a block, queries searched together, slices of the table of frequencies.
COMMON, BLOCK, TOGETHER, SLICES = 512, 16, 64, 16
#: Seconds for which an idle worker keeps the index: the next task mostly starts at once.
IDLE = 3.0
#: Rounding of single precision: bounds are widened by it, and cosines closer than TIE are tied.
SLACK, TIE = 1e-5, 1e-8


def words(text: str | None) -> list[bytes]:
    raw = (text or "").lower().encode(errors="replace")
    if not raw.isascii():
        for mark in MARKS:
            raw = raw.replace(mark, b" ")
    return raw.translate(_BLANKED).split()


def forms(word: bytes) -> list[bytes]:
    """The terms of a word: itself and its proper beginnings, marked with a star."""
    letters = word.decode()
    return [word, *(letters[:n].encode() + b"*" for n in STEMS if n < len(letters))]


def key(term: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(term)


class Terms:
    """Numbers of terms: the place of a term's hash among all of them, sorted."""

    def __init__(self, keys: np.ndarray, stems: dict[bytes, int]):
        self.keys = keys
        #: Stems without their star and their numbers, by the first bytes that their words have in common.
        self.heads: dict[bytes, list[tuple[bytes, int]]] = {}
        for s, i in stems.items():
            self.heads.setdefault(s[: STEMS[0]], []).append((s[:-1], i))

    def count(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """(words, numbers of the terms in the text, how often each occurs)."""
        import xxhash

        found = words(text)
        seen = Counter(found)
        k = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
        n = np.fromiter(seen.values(), np.int32, len(seen))
        by = np.argsort(k)  # sorted searches stay in cache
        k, n = k[by], n[by]
        t = np.searchsorted(self.keys, k)
        own = np.flatnonzero(self.keys[np.minimum(t, len(self.keys) - 1)] == k) if len(self.keys) else np.zeros(0, np.int64)
        t, n = t[own], n[own]
        stems: Counter = Counter()
        if self.heads:
            head = self.heads.get
            for w in seen:
                for s, i in head(w[: STEMS[0]], ()):
                    if w.startswith(s) and len(w) > len(s):  # in UTF-8 too, beginnings are those of characters
                        stems[i] += seen[w]
        if stems:
            t, n = np.append(t, list(stems)), np.append(n, list(stems.values()))
            by = np.argsort(t)
            t, n = t[by], n[by]
        return len(found), t, n


Row = list[tuple[int, float]]  # (term, occurrences in a hundred words)


def weigh(t: np.ndarray, rate: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of a unit vector; the last of ``idf`` is the constant component."""
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0)
    t = np.append(t, len(idf) - 1)
    w = np.log1p(np.append(rate, 1.0)) * idf[t]
    return t, w / np.sqrt(w @ w)


def unit(row: Row, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(row, float).reshape(-1, 2)
    return weigh(x[:, 0].astype(np.int64), x[:, 1], idf)


def in_blocks(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows of ``x`` in which each run of ``size`` rows is similar: halves are split
    at the median of the main direction (power iteration) until they fit."""

    def split(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= size:
            return [rows]
        part = x[rows] - x[rows].mean(axis=0)
        v = np.cos(np.arange(x.shape[1], dtype=np.float32))
        for _ in range(6):
            v = part.T @ (part @ v)
            v /= np.linalg.norm(v) + np.float32(1e-20)
        half = -(-len(rows) // (2 * size)) * size  # whole blocks on the left
        by = np.argsort(part @ v, kind="stable")
        return split(rows[np.sort(by[:half])]) + split(rows[np.sort(by[half:])])

    return np.concatenate(split(np.arange(len(x)))) if len(x) else np.zeros(0, np.int64)


def forget(token: str) -> None:
    """Drops the index of that token from this worker, whose memory other operators need."""
    held = getattr(sys, "_kmerloom_examples", None)
    if held is not None and held[0] == token:
        sys._kmerloom_examples = held = None
        gc.collect()
        give_back()


class Index:
    """Unit vectors of examples: postings of rare terms, and blocks of common ones."""

    def __init__(self, ids, labels, size: np.ndarray, held: np.ndarray, t: np.ndarray, n: np.ndarray, idf: np.ndarray, base: float):
        """Examples of ``size`` words and ``held`` terms each; ``t`` and ``n`` are the terms and their
        occurrences, example after example.  Examples without a term are never found.  Arrays
        are dropped or written over as soon as they may be, since two workers share an executor."""
        self.ids, self.labels, self.base = np.array(ids, np.int64), np.array(labels, np.int64), base
        self.idf = np.append(idf, CONSTANT / np.log(2))  # the constant component is one more term
        many, v, start = len(held), len(self.idf), np.concatenate([[0], np.cumsum(held)])
        w = n.view(np.float32) if n.dtype == np.int32 else np.empty(len(t), np.float32)  # weights take the place of counts
        norm = np.empty(many, np.float32)

        def pieces():
            """(their entries, the example of each) of some examples at a time."""
            for lo in range(0, many, 512):
                yield slice(start[lo], start[min(lo + 512, many)]), np.repeat(np.arange(lo, min(lo + 512, many)), held[lo : lo + 512])

        for cut, e in pieces():
            x = np.log1p(100 * n[cut] / np.maximum(size[e], 1)) * self.idf[t[cut]]
            if len(e):
                lo, hi = e[0], e[-1] + 1
                norm[lo:hi] = np.sqrt(np.bincount(e - lo, x * x, minlength=hi - lo) + CONSTANT**2)
                w[cut] = x / norm[e]
        del n
        df = np.bincount(t, minlength=v)
        df[-1] = many + 1
        common = np.argsort(-df, kind="stable")[:COMMON]
        n_rare = len(t) + many + 1 - int(df[common].sum())
        del df
        self.column = np.full(v, -1, np.int32)
        self.column[common] = np.arange(len(common), dtype=np.int32)
        self.blocks = -(-many // BLOCK)
        part = np.zeros((many, min(128, len(common))), np.float32)
        for cut, e in pieces():
            col = self.column[t[cut]]
            own = np.flatnonzero((col >= 0) & (col < part.shape[1]))
            part[e[own], col[own]] = w[cut][own]
        self.order = in_blocks(part, BLOCK)  # block place -> example
        del part
        self.place = np.empty(many, np.int32)
        self.place[self.order] = np.arange(many, dtype=np.int32)
        self.dense = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        self.dense[self.place, self.column[-1]] = np.where(held > 0, CONSTANT / norm, 0.0)
        term, found, at = np.empty(n_rare, np.int32), np.empty((n_rare, 2), np.int32), 0
        for cut, e in pieces():
            col, place = self.column[t[cut]], self.place[e]
            own = np.flatnonzero(col >= 0)
            self.dense[place[own], col[own]] = w[cut][own]
            own = np.flatnonzero(col < 0)
            to = slice(at, at + len(own))
            term[to], found[to, 0], found[to, 1] = t[cut][own], place[own] % BLOCK * self.blocks + place[own] // BLOCK, w[cut][own].view(np.int32)
            at += len(own)
        del t, w
        self.dense = self.dense.reshape(self.blocks, BLOCK, len(common))
        self.most = self.dense.max(axis=1)
        by = np.argsort(term, kind="stable")
        self.rare_start = np.searchsorted(term[by], np.arange(v + 1))
        self.rare = found.view(np.int64).ravel()[by]  # place, bits of the weight
        del term, found, by
        give_back()

    @classmethod
    def build(cls, ids, labels, rows: list[Row], idf: np.ndarray, base: float) -> Index:
        """An index of rows whose occurrences are given in a hundred words."""
        pairs = np.concatenate([np.asarray(row, float).reshape(-1, 2) for row in rows] or [np.zeros((0, 2))])
        return cls(ids, labels, np.full(len(rows), 100), np.array([len(row) for row in rows], np.int64), pairs[:, 0].astype(np.int32), pairs[:, 1], idf, base)

    def _rare(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The sum of the postings of the rare ones among the terms: (BLOCK, blocks)."""
        lo, hi = self.rare_start[t], self.rare_start[t + 1]
        some = np.flatnonzero(hi > lo)
        lo, hi = lo[some], hi[some]
        found = np.concatenate([self.rare[:0], *(self.rare[i:j] for i, j in zip(lo.tolist(), hi.tolist()))])
        place, weight = found.view(np.int32)[::2], found.view(np.float32)[1::2]
        return np.bincount(place, weight * np.repeat(w[some], hi - lo), minlength=self.blocks * BLOCK).reshape(BLOCK, self.blocks)

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per unit vector (terms, weights) the (cosines, examples) of the k examples of largest positive cosine and all tied with
        the last of them, by cosine and id.  ``skip`` names an example to leave out of each."""
        out: list = []
        for at in range(0, len(vectors), TOGETHER):
            part = vectors[at : at + TOGETHER]
            x = np.zeros((len(part), self.dense.shape[2]))
            for i, (t, w) in enumerate(part):
                col = self.column[t]
                x[i, col[col >= 0]] = w[col >= 0]
            common = x.astype(np.float32) @ self.most.T
            for i, (t, w) in enumerate(part):
                out.append(self._best(self._rare(t, w), common[i], x[i], k, skip[at + i] if skip else None) if len(t) and self.blocks else (np.zeros(0), np.zeros(0, np.int64)))
        return out

    def _best(self, rare: np.ndarray, common: np.ndarray, x: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples, from the sums of rare terms, the blocks' bounds of the common
        ones and the weights of the common ones in the query."""
        bound, short = rare.max(axis=0) + common, x.astype(np.float32)
        gone = -1 if skip is None else self.place[skip]

        def visit(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            cos = rare[:, blocks].T.ravel() + self.dense[blocks].reshape(-1, len(x)) @ short
            places = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            keep = (cos > 0) & (places != gone)
            return cos[keep], places[keep]

        def kth(cos: np.ndarray) -> float:
            return np.partition(cos, len(cos) - k)[len(cos) - k] - SLACK if len(cos) > k else 0.0

        cos, places, at, some = np.zeros(0), np.zeros(0, np.int64), 0, -(-4 * (k + 1) // BLOCK)
        left = np.argsort(-bound)
        while len(left) and bound[left[0]] >= kth(cos):  # most promising blocks first, more each time
            more, others = visit(left[:some])
            cos, places = np.append(cos, more), np.append(places, others)
            left, some = left[some:], 3 * some
            least = kth(cos)
            left = left[: np.searchsorted(-bound[left], -least, "right")]
        places = places[cos >= kth(cos)]
        exact = rare[places % BLOCK, places // BLOCK] + self.dense.reshape(-1, len(x))[places].astype(float) @ x
        near = self.order[places]
        by = np.lexsort((self.ids[near], -np.round(exact, 9)))
        near, exact = near[by], exact[by]
        if len(near) > k:
            keep = exact >= exact[k - 1] - TIE
            near, exact = near[keep], exact[keep]
        return exact, near

    def nearest(self, row: Row, k: int) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine as (cosine, example), ties to the smaller id."""
        cos, near = self.search([unit(row, self.idf)], k)[0]
        return list(zip(cos[:k].tolist(), near[:k].tolist()))

    def vote(self, cos: np.ndarray, near: np.ndarray, k: int, close: float = 0.1, pull: float = 2.0) -> float:
        w = 1 / (1 - cos + close)
        if len(cos) > k:
            tied = cos <= cos[k - 1] + TIE
            w[tied] *= (k - (~tied).sum()) / tied.sum()
        return float((w @ self.labels[near] + pull * self.base) / (w.sum() + pull))

    def score(self, row: Row, k: int) -> tuple[float, list[tuple[float, int]]]:
        cos, near = self.search([unit(row, self.idf)], k)[0]
        return self.vote(cos, near, k), list(zip(cos[:k].tolist(), near[:k].tolist()))


@dataclass(frozen=True)
class Calibration:
    """probability = logistic(slope * log odds of the vote + shift)."""

    slope: float = 1.0
    shift: float = 0.0

    def __call__(self, vote: np.ndarray) -> np.ndarray:
        v = np.clip(vote, 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(v / (1 - v)) + self.shift, -500, 500)))

    @classmethod
    def fit(cls, vote: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Calibration:
        """Newton steps on the log likelihood with a normal prior around the identity, which is also
        what no votes give."""
        v = np.clip(np.asarray(vote, float), 1e-9, 1 - 1e-9)
        x = np.column_stack([np.log(v / (1 - v)), np.ones(len(v))])
        start = beta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(2), x.T @ (p - y) + prior * (beta - start))
            beta = beta - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-9:
                break
        return cls(float(max(beta[0], 0.0)), float(beta[1]))


def select_terms(sample: DataFrame, least_docs: int = 3, least_z: float = 5.0, least_lift: float = 3.0) -> list[bytes]:
    """Terms whose document frequency in toxic examples exceeds that in the others by a z of
    ``least_z`` (pooled proportions) and by the factor ``least_lift``, over distinct texts; best
    first, ties by term.  Only terms of ``least_docs`` toxic examples or more are counted in the others."""

    def counter(wanted: set[bytes] | None):
        def run(batches):
            seen: Counter = Counter()
            for b in batches:
                for t in b.column(0):
                    found = {f for w in set(words(t.as_py())) for f in forms(w)}
                    seen.update(found if wanted is None else found & wanted)
                if len(seen) > 300_000:  # sums of parts; bounded memory
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        return run

    def counts(texts: DataFrame, wanted: set[bytes] | None, least: int) -> dict[bytes, int]:
        got = spread(texts.select("text")).mapInArrow(counter(wanted), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return {bytes(r.term): r.n for r in got.collect()}

    once = materialize(sample.groupBy("text").agg(F.max("y").alias("y")), "toxicity-texts")
    size = once.agg(F.count("*"), F.sum("y")).first()
    n, pos = size[0] or 0, size[1] or 0
    if not pos or pos == n:
        return []
    a = counts(once.filter("y = 1"), None, least_docs)
    c = counts(once.filter("y = 0"), set(a), 1)
    discard(once)
    found: dict[bytes, tuple] = {}
    for t, x in a.items():
        other = c.get(t, 0)
        p = (x + other) / n
        if x + other < n and x * (n - pos) >= least_lift * pos * other:
            z = (x / pos - other / (n - pos)) / np.sqrt(p * (1 - p) * (1 / pos + 1 / (n - pos)))
            if z >= least_z:
                found[t] = (-z, x, x + other)
    doubled = {f for t in found for f in forms(t.rstrip(b"*")) if f != t and f in found and found[f][1:] == found[t][1:]}
    return sorted((t for t in found if t not in doubled), key=lambda t: (found[t][0], t))


def vocabulary(sample: DataFrame) -> np.ndarray:
    """Hashes of all words of the examples."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(key, seen), np.uint64, len(seen)).view(np.int64))], names=["h"])

    got = sample.select("text").mapInArrow(run, "h long").distinct().toArrow().column("h").to_numpy()
    return np.sort(np.ascontiguousarray(got).view(np.uint64))


def pack(size: int, t: np.ndarray, n: np.ndarray, codec: zstandard.ZstdCompressor | None = None) -> bytes:
    """A text's size, sorted terms (as differences) and counts, compressed byte plane by byte plane; a ``codec`` that is used
    again saves its own making, which takes longer than a text."""
    x = np.concatenate([[size], np.diff(t, prepend=0), n]).astype("<i4").view(np.uint8)
    return (codec or zstandard.ZstdCompressor(level=1)).compress(x.reshape(-1, 4).T.tobytes())


def unpack(b: bytes, codec: zstandard.ZstdDecompressor | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    x = np.ascontiguousarray(np.frombuffer((codec or zstandard.ZstdDecompressor()).decompress(b), np.uint8).reshape(4, -1).T).view("<i4").ravel()
    half = len(x) // 2 + 1
    return int(x[0]), np.cumsum(x[1:half], dtype=np.int64), x[half:]


def term_counts(docs: DataFrame, make_terms, keep: list[str]) -> DataFrame:
    """(keep..., packed) of rows (keep..., text)."""
    at = len(keep)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "packed binary"

    def run(batches):
        terms, codec = make_terms(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array([pack(*terms.count(t.as_py()), codec) for t in b.column(at)], pa.binary())], names=[*keep, "packed"])
        give_back()

    return docs.select(*keep, "text").mapInArrow(run, schema)


def frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """The number of rows that hold each term.  A task sends one array in SLICES parts; parts
    are summed up per salt of tasks before they are summed up per slice."""
    edges = [n_terms * i // SLICES for i in range(SLICES + 1)]

    def run(batches):
        from pyspark import TaskContext

        df, codec = np.zeros(n_terms, np.int32), zstandard.ZstdDecompressor()
        for b in batches:
            for x in b.column(0):
                df[unpack(x.as_py(), codec)[1]] += 1
        if df.any():
            salt = TaskContext.get().partitionId() % salts
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([salt] * SLICES, pa.int64()), pa.array([df[lo:hi].astype(np.int64).tobytes() for lo, hi in zip(edges, edges[1:])])], names=["slice", "salt", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("n"))
        return pa.table({"slice": t.column("slice")[:1], "salt": t.column("salt")[:1], "n": pa.array([total.tobytes()])})

    salts = max(1, counted.rdd.getNumPartitions() // 256)
    got = counted.select("packed").mapInArrow(run, "slice int, salt long, n binary")
    if salts > 1:
        got = got.groupBy("slice", "salt").applyInArrow(add, "slice int, salt long, n binary")
    parts = {r.slice: np.frombuffer(r.n, np.int64) for r in got.groupBy("slice").applyInArrow(add, "slice int, salt long, n binary").collect()}
    return np.concatenate([parts.get(i, np.zeros(hi - lo, np.int64)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def packed_examples(sample: DataFrame, id_col: str, make_terms) -> list[tuple[bytes, bytes, bytes]]:
    """The vectors of the examples (id, y, size, held; terms, counts), compressed, one or more for
    each task."""

    def run(batches):
        terms = make_terms()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                got = [terms.count(t) for t in part.column(2).to_pylist()]
                head = np.column_stack([part.column(0).to_numpy(), part.column(1).to_numpy(), [g[0] for g in got], [len(g[1]) for g in got]]).astype(np.int64)
                body = [zlib.compress(np.concatenate([np.zeros(0), *(g[i] for g in got)]).astype(np.int32).tobytes(), 1) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (head.tobytes(), *body)], names=["head", "terms", "counts"])

    return [tuple(map(bytes, r)) for r in sample.select(id_col, "y", "text").mapInArrow(run, "head binary, terms binary, counts binary").collect()]


def unpacked(chunks: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head rows, terms, counts) of `packed_examples`; the chunks are used up."""
    head = np.concatenate([np.zeros((0, 4), np.int64), *(np.frombuffer(h, np.int64).reshape(-1, 4) for h, _, _ in chunks)])
    t, n = (np.empty(head[:, 3].sum(), np.int32) for _ in range(2))
    at = 0
    while chunks:
        _, *pair = chunks.pop(0)
        for into, raw in zip((t, n), pair):
            x = np.frombuffer(zlib.decompress(raw), np.int32)
            into[at : at + len(x)] = x
        at += len(x)
    return head, t, n


def toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_examples: int = 20_000, calibrate: int = 4_000, k: int = 15, threshold: float = 0.5, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, evidence (ids of the nearest
    examples), and the columns ``keep``.

    ``held_out`` is a condition on the id; held-out labels are never read.  The sample of
    examples is bounded by ``max_examples``, and the first ``calibrate`` of them, in that order,
    fit the calibration; document frequencies and scores cover whole texts of all rows.  Every
    text with a word of any example is searched; others (null and empty ones too) have no
    neighbour and score the calibrated rate of toxic examples without a selected term.  The
    driver holds the hashes of the examples' words and the compressed examples, both bounded by the sample.
    An example finds itself among its neighbours, while the calibration leaves each one out: scores of labelled training rows
    are surer than those of other rows.  A null id has a null held_out.
    Repeated rows score alike.  Of a labelled id that several rows have, the smallest text is the
    example; of contradictory labels 1 counts.  Labels without a document and null labels are
    ignored, an empty table gives no rows, and without labels every score is one half.
    """
    kept = [f"__keep_{c}" for c in keep]
    rows = spread(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"), *[F.col(c).alias(f"__keep_{c}") for c in keep]))
    chosen = (
        labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("long").alias("y")).filter(F.col("y").isin(0, 1)).filter(~held_out)
        .filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("y").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(max_examples)
    )
    own = rows.join(F.broadcast(chosen), id_col)  # at most max_examples ids are sent
    sample = materialize(own.groupBy(id_col).agg(F.min("text").alias("text"), F.max("y").alias("y")), "toxicity-sample")
    selected = select_terms(sample)
    seen = vocabulary(sample)
    chosen_keys = np.fromiter(map(key, selected), np.uint64, len(selected))
    keys = np.union1d(seen, chosen_keys)
    full = np.zeros(len(keys), bool)
    full[np.searchsorted(keys, chosen_keys)] = True
    stems = {t: int(np.searchsorted(keys, np.uint64(key(t)))) for t in selected if t.endswith(b"*")}
    make_terms = lambda: Terms(keys, stems)
    with few_texts(docs.sparkSession):
        counted = materialize(term_counts(rows.withColumn("held_out", held_out), make_terms, [id_col, "held_out", *kept]), "toxicity-counts")
    idf = np.log((1 + counted.count()) / (1 + frequencies(counted, len(keys)))) + 1
    idf[~full] *= ORDINARY
    chunks = packed_examples(sample, id_col, make_terms)
    token = uuid.uuid4().hex
    known, bare, bare_toxic = 0, 0, 0
    for h, t, _ in chunks:
        head, terms = np.frombuffer(h, np.int64).reshape(-1, 4), np.frombuffer(zlib.decompress(t), np.int32)
        none = np.bincount(np.repeat(np.arange(len(head)), head[:, 3])[full[terms]], minlength=len(head)) == 0
        known, bare, bare_toxic = known + len(head), bare + int(none.sum()), bare_toxic + int(head[none, 1].sum())
    base = (bare_toxic + 0.5) / (bare + 1)

    def index() -> Index:
        """The index, built once in each worker and kept until the worker is idle or another one
        is asked for."""
        timer = getattr(sys, "_kmerloom_timer", None)
        if timer is not None:
            timer.cancel()
        held = getattr(sys, "_kmerloom_examples", None)
        if held is None or held[0] != token:
            sys._kmerloom_examples = None
            head, *pair = unpacked(chunks)
            held = sys._kmerloom_examples = (token, Index(*head.T, pair.pop(0), pair.pop(0), idf, base))
        chunks.clear()  # a worker that holds the index does not need them
        return held[1]

    def leave() -> None:
        """To be called at the end of a task."""
        timer = sys._kmerloom_timer = threading.Timer(IDLE, forget, [token])
        timer.daemon = True
        timer.start()

    def vector(found: Index, size: int, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return weigh(t, 100 * n / max(size, 1), found.idf)

    def left_out(batches):
        found, terms = index(), make_terms()
        place = {i: e for e, i in enumerate(found.ids.tolist())}
        for b in batches:
            at = [place[i] for i in b.column(0).to_pylist()]
            got = found.search([vector(found, *terms.count(t)) for t in b.column(2).to_pylist()], k, at)
            yield pa.RecordBatch.from_arrays([pa.array([found.vote(*g, k) for g in got], pa.float64()), b.column(1)], names=["vote", "y"])
        leave()

    part = sample.join(F.broadcast(chosen.select(id_col).limit(calibrate)), id_col, "left_semi") if known > calibrate else sample
    votes = spread(part.select(id_col, "y", "text")).mapInArrow(left_out, "vote double, y long").toArrow()
    discard(sample)
    curve = Calibration.fit(votes.column("vote").to_numpy(), votes.column("y").to_numpy())

    def run(batches):
        found, codec = index(), zstandard.ZstdDecompressor()
        for b in batches:
            texts = b.column(2).to_pylist()
            once = list(dict.fromkeys(texts))  # copies are searched once
            votes, proof = {}, {}
            for at in range(0, len(once), 512):
                some = once[at : at + 512]
                for t, (cos, near) in zip(some, found.search([vector(found, *unpack(t, codec)) for t in some], k)):
                    votes[t], proof[t] = found.vote(cos, near, k), found.ids[near[:k]].tolist()
            s = curve(np.array([votes[t] for t in texts], float))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array([proof[t] for t in texts], pa.list_(pa.int64())), *b.columns[3:]],
                names=[id_col, "held_out", "score", "predicted", "evidence", *keep],
            )
        leave()

    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    # the table of counts is read in few tasks, but searching it is work: deal it out
    return spread(counted).select(id_col, "held_out", "packed", *kept).mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int, evidence array<long>{more}")
