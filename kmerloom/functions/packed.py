"""k-mers packed in two bits a base (numpy): A, C, G, T are 0 to 3, the first base highest.

Up to k = 31 a k-mer is one non-negative 64-bit number, up to 64 a pair (high, low) of unsigned
ones: the low word holds the last 32 bases.  Numbers sort as the strings do.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LONGEST, NARROW = 64, 31
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[[_b, _b + 32]] = _i


def strands(code: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window of ``m`` (0 to 32) bases and its reverse complement.  Windows grow by doubling:
    one of 2h bases is two of h, so m bases take about log2(m) passes."""
    if not m:
        return np.zeros(len(code) + 1, U), np.zeros(len(code) + 1, U)
    one, other = code.astype(U), U(3) - code
    f, r, h = one, other, 1
    for bit in bin(m)[3:]:
        n = len(f) - h
        f, r, h = f[:n] << U(2 * h) | f[h:], r[h:] << U(2 * h) | r[:n], 2 * h
        if bit == "1":
            n = len(f) - 1
            f, r, h = f[:n] << U(2) | one[h:], other[h:] << U(2 * h) | r[:n], h + 1
    return f, r


def canonical_windows(seq: bytes, k: int) -> tuple[np.ndarray | None, np.ndarray]:
    """(high, low) words of the canonical form of every window of ``k`` ACGT bases of either case, in order;
    windows with another character go.  The high word is None up to k = 31."""
    code = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(code) - k + 1
    if k <= 0 or n <= 0:
        return (None if k <= NARROW else np.zeros(0, U)), np.zeros(0, U)
    bad = code == 4
    whole = slice(None)
    if bad.any():
        seen = np.concatenate([[0], np.cumsum(bad)])
        whole = seen[k:] == seen[:n]
        code = np.where(bad, 0, code).astype(np.uint8)
    high, low = canonical_of(code, k)
    return None if high is None else high[whole], low[whole]


def text_codes(text: bytes) -> np.ndarray:
    """Codes of the two bases that stand for each byte of any text (`sequences.translate_text`)."""
    raw = np.frombuffer(text, np.uint8)
    return np.stack([raw >> 4 & 3, raw & 3], axis=1).ravel()


def text_windows(text: bytes, k: int) -> tuple[np.ndarray | None, np.ndarray]:
    """The same of the bases that stand for a text."""
    if k <= 0 or 2 * len(text) < k:
        return (None if k <= NARROW else np.zeros(0, U)), np.zeros(0, U)
    return canonical_of(text_codes(text), k)


class Few:
    """A bounded number of low words, to tell which of many words are among them."""

    def __init__(self, low: np.ndarray):
        self.low = np.unique(low)
        self.bits = max(16, 4 + len(self.low).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._cell(self.low)] = True

    def _cell(self, low: np.ndarray) -> np.ndarray:
        return (low * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def holds(self, low: np.ndarray) -> np.ndarray:
        out = self.seen[self._cell(low)]
        at = np.flatnonzero(out)  # few words go on from the table to the search
        if len(at):
            place = np.minimum(np.searchsorted(self.low, low[at]), len(self.low) - 1)
            out[at] = self.low[place] == low[at]
        return out


def canonical_of(code: np.ndarray, k: int) -> tuple[np.ndarray | None, np.ndarray]:
    """(high, low) words of every window of ``k`` of at least ``k`` base codes (0 to 3)."""
    if k <= NARROW:
        return None, np.minimum(*strands(code, k))
    n = len(code) - k + 1
    (a, b), (low, back) = strands(code, k - 32), strands(code, 32)
    f, r = (a[:n], low[k - 32 :]), (b[32 : 32 + n], back[:n])
    swap = (r[0] < f[0]) | (r[0] == f[0]) & (r[1] < f[1])
    return np.where(swap, r[0], f[0]), np.where(swap, r[1], f[1])


def distinct(high: np.ndarray | None, low: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """The same words in unsigned order, each once."""
    if high is None:
        low = np.sort(low)
        return None, low[np.append(True, low[1:] != low[:-1])] if len(low) else low
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    keep = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])) if len(low) else np.zeros(0, bool)
    return high[keep], low[keep]


def records(high: np.ndarray | None, low: np.ndarray) -> bytes:
    """16 bytes for each k-mer: high and low word, big-endian."""
    out = np.zeros((len(low), 2), ">u8")
    out[:, 0], out[:, 1] = 0 if high is None else high, low
    return out.tobytes()


def words(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) of 16-byte records; a rest of fewer bytes is ignored."""
    x = np.frombuffer(content, ">u8", len(content) // 16 * 2).astype(U).reshape(-1, 2)
    return x[:, 0], x[:, 1]


# Runs: neighbouring k-mers with one minimizer, stored as the bases that hold them.

#: The longest minimizer, and k-mers of a run at most (their number is one byte).
LONGEST_MINIMIZER, LONGEST_RUN = 12, 192


def minimizer_length(k: int) -> int:
    return min(LONGEST_MINIMIZER, (k + 1) // 2)


def _mixed_words(code: np.ndarray, m: int) -> np.ndarray:
    """The canonical words of ``m`` bases in another order (one to one), in which poor sequence does not come first."""
    x, mask = np.minimum(*strands(code, m)), U((1 << 2 * m) - 1)
    x = x * U(0x9E3779B97F4A7C15) & mask
    return (x ^ x >> U(m)) * U(0xBF58476D1CE4E5B9) & mask


def minimizers(code: np.ndarray, k: int) -> np.ndarray:
    """The least mixed word of every window of ``k`` base codes: equal for equal canonical k-mers."""
    m = minimizer_length(k)
    h, width, size = _mixed_words(code, m), 1, k - m + 1
    while width < size:
        step = min(width, size - width)
        h, width = np.minimum(h[: len(h) - step], h[step:]), width + step
    return h


def minimizers_of(high: np.ndarray | None, low: np.ndarray, k: int) -> np.ndarray:
    """The same of packed k-mers."""
    code = np.empty((len(low), k), np.uint8)
    for i in range(k):
        word, at = (low, i) if i < 32 else (high, i - 32)
        code[:, k - 1 - i] = word >> U(2 * at) & U(3)
    return minimizers(code.ravel(), k)[::k] if len(low) else np.zeros(0, U)


def runs(seq: bytes, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct k-mers, minimizers, byte offsets, bytes) of the runs that hold every distinct canonical ACGT
    k-mer of ``seq`` once.  A run is a byte with its number of k-mers and their bases, four a byte."""
    code = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(code) - k + 1
    if k <= 0 or n <= 0:
        return 0, np.zeros(0, U), np.zeros(1, np.int64), np.zeros(0, np.uint8)
    seen = np.concatenate([[0], np.cumsum(code == 4)])
    code[code == 4] = 0
    high, low = canonical_of(code, k)
    order = np.argsort(low, kind="stable") if high is None else np.lexsort((low, high))
    order = order[(seen[k:] == seen[:n])[order]]
    new = np.ones(len(order), bool)
    new[1:] = low[order[1:]] != low[order[:-1]]
    if high is not None:
        new[1:] |= high[order[1:]] != high[order[:-1]]
    keep = np.zeros(n, bool)
    keep[order[new]] = True
    least = minimizers(code, k)
    joint = np.zeros(n, bool)  # goes on with the run of the window before
    joint[1:] = keep[1:] & keep[:-1] & (least[1:] == least[:-1])
    first = np.maximum.accumulate(np.where(joint, 0, np.arange(n)))
    begin = np.flatnonzero(keep & ((np.arange(n) - first) % LONGEST_RUN == 0))
    held = np.cumsum(np.append(0, keep))
    number = np.diff(np.append(held[begin], held[-1]))
    return int(held[-1]), least[begin], *_written(code, begin, number, k)


def _written(code: np.ndarray, begin: np.ndarray, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    width = (number + k + 2) // 4  # bytes of number + k - 1 bases
    at = np.append(0, np.cumsum(width))
    base = np.repeat(begin - 4 * at[:-1], 4 * width) + np.arange(4 * at[-1])
    four = np.append(code, np.zeros(4, np.uint8))[np.minimum(base, len(code))].reshape(-1, 4)
    out = np.empty(at[-1] + len(begin), np.uint8)
    offsets = at + np.arange(len(at))
    body = np.ones(len(out), bool)
    body[offsets[:-1]] = False
    out[offsets[:-1]] = number
    out[body] = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return offsets, out


def read_runs(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(place of the run, high, low) of the k-mers of runs."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64), None if k <= NARROW else np.zeros(0, U), np.zeros(0, U)
    code = np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], axis=1).ravel()
    high, low = canonical_of(code, k)
    number = data[offsets[:-1]].astype(np.int64)
    run = np.repeat(np.arange(len(number)), number)
    at = 4 * (offsets[:-1][run] + 1) + np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number)
    return run, None if high is None else high[at], low[at]
