"""Counts of pairs that many lists of numbers hold together (numpy).

Numbers are dealt to blocks by range.  A list goes to the blocks of its members, to each with its members there and
those that follow them, as variable-length bytes of differences; there its pairs are made and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Numbers of lists that are written at once, and pairs that are made at once.
WRITTEN, MADE = 1 << 20, 1 << 22


def to_bytes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): unsigned numbers in seven bits a byte, the lowest first; the top bit says that more follow."""
    width = np.ones(len(v), np.int64)
    for i in range(1, 10):
        more = v >= U(1 << 7 * i)
        if not more.any():
            break
        width += more
    ends = np.cumsum(width)
    start, out = ends - width, np.empty(ends[-1] if len(v) else 0, np.uint8)
    for i in range(width.max(initial=0)):
        has = np.flatnonzero(width > i)
        out[start[has] + i] = (v[has] >> U(7 * i) & U(127)) | (width[has] > i + 1).astype(U) << U(7)
    return out, ends


def from_bytes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    start = np.append(0, ends[:-1] + 1)[: len(ends)]
    v = (raw[start] & 127).astype(U)
    for i in range(1, (ends - start).max(initial=0) + 1):
        has = np.flatnonzero(ends - start >= i)
        v[has] |= (raw[start[has] + i] & 127).astype(U) << U(7 * i)
    return v


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def dealt(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, s, nx, t, ny, apart) of (offsets, numbers) of sorted lists: numbers s to s + nx of both, end to end, are of the block and meet those from t to t + ny that
    follow them, and each other unless ``apart``.  Members of a list meet each other if ``b`` is empty there, and else only those of ``b``."""
    (offsets, one), (others, two) = a, b
    size, crossed = np.diff(offsets), np.diff(others) > 0
    of, block = np.repeat(np.arange(len(size)), size), np.searchsorted(bounds, one, "right")
    new = np.ones(len(one), bool)
    new[1:] = (of[1:] != of[:-1]) | (block[1:] != block[:-1])
    s = np.flatnonzero(new)
    nx = np.diff(np.append(s, len(one)))
    own = ~crossed[of[s]] & (offsets[of[s] + 1] - s > 1)
    s, nx = s[own], nx[own]
    found = [(block[s], s, nx, s + nx, offsets[of[s] + 1] - s - nx, np.zeros(len(s), np.int64))]
    for i in np.flatnonzero(crossed):
        sides = ((one, offsets[i], offsets[i + 1], 0), (two, others[i], others[i + 1], len(one)))
        for (x, x0, x1, xa), (y, y0, y1, ya) in (sides, sides[::-1]):
            block = np.searchsorted(bounds, x[x0:x1], "right")
            s = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: x1 - x0])
            nx, t = np.diff(np.append(s, x1 - x0)), np.searchsorted(y[y0:y1], x[x0:x1][s], "right")
            found.append((block[s], xa + x0 + s, nx, ya + y0 + t, y1 - y0 - t, np.ones(len(s), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def written(numbers: np.ndarray, parts: tuple[np.ndarray, ...], low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(blocks, offsets, heads, offsets, bodies) of about `WRITTEN` numbers each: what a block gets is one pair of byte strings."""
    kept = np.flatnonzero((parts[5] == 0) | (parts[4] > 0))
    kept = kept[np.argsort(parts[0][kept], kind="stable")]
    sizes = np.cumsum(parts[2][kept] + parts[4][kept])
    cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(0, sizes[-1] if len(sizes) else 0, WRITTEN)), len(kept)))
    for at, end in zip(cuts[:-1], cuts[1:]):
        block, s, nx, t, ny, apart = (x[kept[at:end]] for x in parts)
        n = nx + ny
        start = np.cumsum(n) - n
        v = numbers[ranges(np.stack([s, t], 1).ravel(), np.stack([nx, ny], 1).ravel())].view(U)
        body = np.empty_like(v)
        body[1:] = v[1:] - v[:-1]
        first = np.concatenate([start, (start + nx)[apart == 1]])
        body[first] = v[first] - np.array(low).astype(np.int64).view(U)
        heads, head_ends = to_bytes(np.stack([nx * 2 + apart, n], 1).ravel().astype(U))
        body, ends = to_bytes(body)
        last = np.append(np.flatnonzero(block[1:] != block[:-1]), len(block) - 1)
        yield block[last], np.append(0, head_ends[2 * last + 1]), heads, np.append(0, ends[(start + n)[last] - 1]), body


def made(heads: bytes, body: bytes, span: int) -> Iterator[np.ndarray]:
    """Keys x * span + y, both above the lowest, of the pairs x < y of byte strings of one block, about `MADE` at once."""
    h, d = from_bytes(heads).reshape(-1, 2).astype(np.int64), from_bytes(body)
    nx, apart, n = h[:, 0] >> 1, h[:, 0] & 1, h[:, 1]
    start = np.cumsum(n) - n
    first = np.sort(np.concatenate([start, (start + nx)[apart == 1]]))
    base = d[first]
    d[first] = 0
    total = np.cumsum(d)
    v = (total + np.repeat(base - total[first], np.diff(np.append(first, len(d))))).view(np.int64)
    x = ranges(start, nx)
    y = np.where(np.repeat(apart, nx) == 1, np.repeat(start + nx, nx), x + 1)
    n = np.repeat(start + n, nx) - y
    ends = np.cumsum(n)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, MADE)), len(n)))
    for at, end in zip(cuts[:-1], cuts[1:]):
        m = n[at:end]
        keys, other = np.repeat(v[x[at:end]], m), v[ranges(y[at:end], m)]
        if apart.any():
            keys, other = keys[keys < other], other[keys < other]
        yield keys * span + other


class Tally:
    """Counts by key; the memory is that of the different keys, and of `MADE` more."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self._put(np.sort(keys), None)
        if self.held > max(MADE, 2 * len(self.runs[0][0])):
            self.merged()

    def _put(self, keys: np.ndarray, counts: np.ndarray | None) -> None:
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        number = np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at) if len(at) else counts
        self.runs.append((keys[at], number))
        self.held += len(at)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.runs) != 1:
            keys, counts = (np.concatenate([r[i] for r in self.runs] or [np.zeros(0, np.int64)]) for i in (0, 1))
            self.runs, self.held = [], 0
            order = np.argsort(keys, kind="stable")
            self._put(keys[order], counts[order])
        return self.runs[0]
