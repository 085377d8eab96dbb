"""Vectorised uint64 kernels (numpy) for whole sequences: hash, registers, densify, sketch."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..params import BASE_SEEDS, EMPTY, HASH_SEED, SketchParams

U = np.uint64
_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[[_b, _b + 32]] = _i
#: Empty buckets that are tried one attempt at a time, and pairs of bucket and attempt that are tried at once.
WIDE, TRIED = 1 << 10, 1 << 14
#: Buckets from which on, and full buckets in so many up to which, donors look for their buckets first.
MANY, FEW = 1 << 12, 64
_SEED = np.array([BASE_SEEDS[b] for b in "ACGT"], dtype=U)


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + U(HASH_SEED)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rotl(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    r = (np.asarray(r) & 63).astype(U)
    return x << r | x >> (U(64) - r & U(63))


#: The seed of base c turned by place i (mod 64) is at 4 i + c: to the right for the strand itself, to the left for the other.
_RIGHT = rotl(_SEED[None, :], -np.arange(64)[:, None]).ravel()
_LEFT = rotl(_SEED[None, ::-1], np.arange(64)[:, None]).ravel()


def kmer_hashes(seq: bytes | np.ndarray, k: int, canonical: bool) -> np.ndarray:
    """Rolling hashes of all k-mers of an ACGT sequence (or its codes, 0 to 3), from prefix XORs of rotated seeds."""
    code = seq if isinstance(seq, np.ndarray) else _CODE[np.frombuffer(seq, np.uint8)]
    n = len(code) - k + 1
    if k <= 0 or n <= 0:
        return np.zeros(0, U)
    if code.max() > 3:
        raise ValueError("segments hold ACGT only")
    at = np.arange(len(code))
    seed = (at & 63) * 4 + code

    def prefix(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, U)
        np.bitwise_xor.accumulate(x, out=out[1:])
        return out

    p = prefix(_RIGHT.take(seed))
    forward = rotl(p[k:] ^ p[:n], at[:n] + (k - 1))
    if not canonical:
        return forward
    q = prefix(_LEFT.take(seed))
    return np.minimum(forward, rotl(q[k:] ^ q[:n], -at[:n]))


def registers(segments: list[bytes | np.ndarray], p: SketchParams, buckets: int) -> np.ndarray:
    """The smallest rank in each bucket; EMPTY where there is none."""
    reg = np.full(buckets, EMPTY, U)
    m = (buckets - 1).bit_length()
    for s in segments:
        h = kmer_hashes(s, p.k, p.canonical)
        if len(h):
            rank = mix64(h ^ U(p.rank_seed))
            rank = np.minimum(rank, U(EMPTY - 1))
            bucket = (mix64(h ^ U(p.bucket_seed)) >> U(64 - m)).astype(np.int64) if m else np.zeros(len(h), np.int64)
            np.minimum.at(reg, bucket, rank)
    return reg


@lru_cache(maxsize=8)
def _cells(n: int, a: int) -> np.ndarray | None:
    """Attempts turn a circle of 2 ** 32 places, on which bucket i starts at a * i, and a donor is a cell, one part in ``n``.  Rows of
    (place in the cell << 32 | bucket) by cell, as many as one cell has buckets; ``n`` where there is none.  None if a cell has more than four."""
    m = (n - 1).bit_length()
    place = np.arange(n, dtype=U) * U(a & 0xFFFFFFFF) & U(0xFFFFFFFF)
    cell = (place >> U(32 - m)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    row = np.arange(n) - np.searchsorted(cell, cell)
    if row.max() >= 4:
        return None
    out = np.full((row.max() + 1, n), n)
    out[row, cell] = (place[order] & U((1 << 32 - m) - 1)).astype(np.int64) << 32 | order
    return out


def _donors_of_few(full: np.ndarray, a: int, b: int, attempts: int) -> np.ndarray:
    """The donor that each bucket finds in its first ``attempts``, or -1: the circle is turned back, and at each turn the cell of a full
    bucket covers those that find it."""
    n, given = len(full), np.flatnonzero(full)
    m, cells = (n - 1).bit_length(), _cells(n, a)
    turn = (np.arange(attempts, 0, -1).astype(U) * U(a) + U(b)) >> U(32)
    whole = (turn >> U(32 - m)).astype(np.int64)[:, None]
    rest = ((1 << 32 - m) - (turn & U((1 << 32 - m) - 1)).astype(np.int64) << 32)[:, None]
    out, step = np.full(n + 1, -1), max(1, TRIED // 4 // len(given))
    for i in range(0, attempts, step):  # from the last attempt to the first, which stays
        at, edge = given - whole[i : i + step] & n - 1, rest[i : i + step]
        before, found = at - 1 & n - 1, np.empty((len(at), 2 * len(cells), len(given)), np.int64)
        for j, row in enumerate(cells):
            here, carried = row.take(at), row.take(before)
            here[here >= edge] = n
            carried[carried < edge] = n
            found[:, 2 * j], found[:, 2 * j + 1] = here, carried
        out[found & 0xFFFFFFFF] = given
    return out[:n]


def densify(reg: np.ndarray, p: SketchParams) -> np.ndarray:
    """Empty buckets take the first non-empty one of their universal-hash sequence.  Without any value all registers are 0.

    Next donors are one sum away, so many buckets are tried attempt by attempt with only the number of the first success kept, and
    a few for many attempts at once.  If few buckets are full, most attempts fail, and donors look for their buckets first."""
    full = reg != U(EMPTY)
    out = reg.copy()
    if not full.any():
        return np.zeros_like(reg)
    n, (a, b) = len(reg), p.universal
    empty, shift = np.flatnonzero(~full), U(64 - (n - 1).bit_length())
    f, attempt = n - len(empty), 1
    with np.errstate(over="ignore"):
        if MANY <= n <= 1 << 20 and f * FEW <= n and _cells(n, a) is not None:
            attempts = (3 if f >= 16 else 6) * n // f
            donor = _donors_of_few(full, a, b, attempts).take(empty)
            done, left = np.flatnonzero(donor >= 0), np.flatnonzero(donor < 0)
            out[empty.take(done)] = reg.take(donor.take(done))
            empty, attempt = empty.take(left), attempts + 1
        x, filled = (empty.astype(U) << U(32)) * U(a) + U(a * attempt + b & EMPTY), full.view(np.uint8)
        while len(empty):
            if len(empty) > WIDE:
                attempts = min(255, max(1, n // f))
                first, hit, donor, y = np.zeros(len(x), np.uint8), np.empty(len(x), np.uint8), np.empty_like(x), x.copy()
                at = donor.view(np.int64)
                for i in range(attempts):
                    np.right_shift(y, shift, out=donor)
                    filled.take(at, out=hit, mode="clip")
                    np.multiply(hit, np.uint8(255 - i), out=hit)
                    np.maximum(first, hit, out=first)
                    y += U(a)
                some = first != 0
                done, left = some.nonzero()[0], (~some).nonzero()[0]
                took = 255 - first.take(done).astype(U)
            else:
                attempts = min(TRIED // len(empty), 2 + 4 * n // f)
                hit = full.take(((x[:, None] + np.arange(attempts, dtype=U) * U(a)) >> shift).view(np.int64))
                took = hit.argmax(1)
                some = hit[np.arange(len(took)), took]
                done, left = np.flatnonzero(some), np.flatnonzero(~some)
                took, y = took.take(done).astype(U), x + U(a * attempts & EMPTY)
            donor = (x.take(done) + took * U(a)) >> shift
            out[empty.take(done)] = reg.take(donor.view(np.int64))
            empty, x = empty.take(left), y.take(left)
    return out


# The primes of XXH64.
_P = [U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _lane(x: np.ndarray) -> np.ndarray:
    return rotl(x * _P[1], 31) * _P[0]


@lru_cache(maxsize=8)
def _place_lanes(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _lane(np.arange(n, dtype=U))


def xxh64_pair(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the sixteen bytes of two little-endian words."""
    with np.errstate(over="ignore"):
        return _xxh64_lanes(_lane(x), _lane(y), seed=seed)


def _xxh64_lanes(*lanes: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = U((seed + int(_P[4]) + 16) & EMPTY)
        for lane in lanes:
            h = rotl(h ^ lane, 27) * _P[0] + _P[3]
        h = (h ^ (h >> U(33))) * _P[1]
        h = (h ^ (h >> U(29))) * _P[2]
    return h ^ (h >> U(32))


def positions(values: np.ndarray, p: SketchParams) -> np.ndarray:
    """The bit that each bucket flips."""
    n, stride = p.sketch_bits, p.sketch_bits // len(values)
    below = lambda x: x & U(n - 1) if n & n - 1 == 0 else x % U(n)
    if p.mode == "value":
        return below(values)
    if p.mode == "stripe" and stride >= 2:
        return below(np.arange(len(values), dtype=U) * U(stride) + values % U(stride))
    with np.errstate(over="ignore"):
        return below(_xxh64_lanes(_lane(values), _place_lanes(len(values)), seed=p.position_seed))


def parity_words(values: np.ndarray, p: SketchParams) -> np.ndarray:
    """The sketch: every bit holds the parity of its flips, in words of 64."""
    odd = np.bincount(positions(values, p).view(np.int64), minlength=p.sketch_bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(U)


def sketch(segments: list[bytes | np.ndarray], p: SketchParams) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, densified registers, non-empty buckets)."""
    reg = registers(segments, p, p.buckets)
    values = densify(reg, p)
    return parity_words(values, p), values, int((reg != U(EMPTY)).sum())
