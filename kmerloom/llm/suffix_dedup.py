"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also
starts earlier in the corpus.

1. Blocks: documents are packed into blocks of about a megabyte and written once.
2. Routing: a window of ``length`` bytes is known by the smallest rolling hash of its k-byte
   grams.  Equal windows have equal minima, and neighbouring windows mostly share theirs, so a
   block sends one value per run of windows, once.  Values seen in two places anywhere (or
   twice in one block) come back to their blocks; windows of other values are unique, and
   hash collisions only add candidates.
3. Segments: the text under each run of candidate windows goes to the shard of its value.
   Equal segments of a block travel once; their later copies are marked at once.  A value
   with very many segments is split further by the content of whole windows.
   Blocks are dealt to salts: counts and equal segments are merged per salt before they are
   merged per shard, so no task gathers one row from every block of the corpus.
4. Suffix array: a shard sorts its window suffixes in two stages.  Only suffixes smaller than
   their successors are sorted directly (eight bytes a round, ties only); the others are
   induced by scanning the buckets of first bytes.  Neighbours in the array with a common
   prefix of ``length`` are the repeats, and all but the earliest window of each are marked.
5. Marks return to their blocks, where the intervals are joined and the text is cut.

Sorting stops at ``length`` bytes, since longer common prefixes change nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import materialize

BLOCK_BYTES, SLICE_BYTES, SHARD_BYTES, HOT_SEGMENTS = 1 << 20, 1 << 18, 3 << 20, 50_000
#: The number that stands for a null id.
NO_ID = -(2**63)
#: Blocks whose rows one salt of a shard gathers.
SALT_BLOCKS = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) >> np.uint64(17))


def gram_size(length: int) -> int:
    return 1 << max(0, (length // 3).bit_length() - 1)


def window_minima(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes the smallest hash of its grams, which content alone
    decides, and whether its first gram has that hash."""
    k = gram_size(length)
    h, span = _BYTE[text], 1
    mul = _MIX
    with np.errstate(over="ignore"):
        while span < k:
            h = h[:-span] * mul + h[span:]
            mul, span = mul * mul * np.uint64(3) | np.uint64(1), span * 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    w = length - k + 1  # grams in a window
    pad = -len(h) % w
    grid = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    m = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    return m, h[:n] == m


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(value, document, first window, windows, folds) of each run of windows with one value.

    A run folds if the smallest gram passes out of a window and the next one has another with
    that hash.  Only then can two windows of one run be equal: their first smallest grams
    would lie at different places."""
    out = []
    d = 0
    while d < len(offsets) - 1:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + SLICE_BYTES, "right")) - 1)
        lo, hi = int(offsets[d]), int(offsets[e])
        if hi - lo >= length:
            m, leaves = window_minima(data[lo:hi], length)
            size = np.diff(offsets[d : e + 1])
            doc = np.repeat(np.arange(d, e), size)[: len(m)]
            at = np.arange(lo, lo + len(m)) - offsets[doc]
            ok = at + length <= size[doc - d]
            first = ok.copy()
            first[1:] &= (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
            i = np.flatnonzero(first)
            j = np.flatnonzero(ok & np.append(first[1:] | ~ok[1:], True))
            gone = np.concatenate([[0], np.cumsum(leaves)])
            out.append((m[i], doc[i], at[i], j - i + 1, gone[j] > gone[i]))
        d = e
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def big_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; text must be padded by 8."""
    w = np.zeros(len(text) - 8, dtype=np.uint64)
    for j in range(8):
        w = w << np.uint64(8) | text[j : len(text) - 8 + j]
    return w


def suffix_order(text: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """Starts begin[s] .. begin[s]+wanted[s]-1 of all segments [begin, end) in the order of
    their first ``depth`` bytes, by two-stage sorting.  ``words`` are big_words of the text."""
    n = int(end[-1]) if len(end) else 0
    t = text[:n].astype(np.int16)
    step = np.empty(n, np.int16)
    step[:-1] = t[1:] - t[:-1]
    step[end - 1] = -1  # the end of a segment is smaller than any byte
    place = np.arange(n)
    decides = np.minimum.accumulate(np.where(step != 0, place, n)[::-1])[::-1]  # equal bytes follow their successor
    small = step[np.minimum(decides, n - 1)] > 0  # smaller than the successor: sorted directly
    next_small = np.minimum.accumulate(np.where(small, place, n)[::-1])[::-1]
    stop = np.minimum(next_small[begin + wanted - 1] + 1, end)  # induction starts at a directly sorted suffix or the end
    use = np.zeros(n + 1, np.int8)
    np.add.at(use, begin, 1)
    np.add.at(use, stop, -1)
    use = np.cumsum(use[:-1]) > 0
    # stage 1
    order = np.flatnonzero(small & use)
    order = order[np.argsort(words[order], kind="stable")]
    key = words[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(order) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        i = np.flatnonzero(tied)
        if not len(i):
            break
        p = order[i]
        key = words[np.minimum(p + d, len(words) - 1)]
        by = np.lexsort((key, group[i]))
        order[i] = p[by]
        key, g = key[by], group[i]
        fresh = np.concatenate([[False], (g[1:] == g[:-1]) & (key[1:] != key[:-1])])
        shift = np.zeros(len(order), np.int64)
        shift[i[fresh]] = 1
        group = group + np.cumsum(shift)
    # stage 2
    first = text[order]
    bounds = np.searchsorted(first, np.arange(257)) if len(order) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    opens = np.zeros(n + 1, bool)
    opens[begin] = True

    def push(found: np.ndarray, c: int) -> np.ndarray:
        """Hand the induced predecessors of sorted suffixes to their buckets; return those of bucket c."""
        p = found - 1
        p = p[(found > 0) & ~opens[found]]
        p = p[use[p] & ~small[p]]
        byte = text[p]
        by = np.argsort(byte, kind="stable")
        p, byte = p[by], byte[by]
        cut = np.flatnonzero(np.diff(byte)) + 1
        own = p[:0]
        for part in np.split(p, cut) if len(p) else ():
            b = int(text[part[0]])
            if b == c:
                own = part
            else:
                waiting[b].append(part)
        return own

    push_end = end[stop == end]
    opens_end = opens[push_end].copy()
    opens[push_end] = False  # the end of one segment is the beginning of the next
    push(push_end, -1)
    opens[push_end] = opens_end
    out = []
    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(now):
            out.append(now)
            now = push(now, c)
        direct = order[bounds[c] : bounds[c + 1]]
        if len(direct):
            out.append(direct)
            push(direct, c)
    sa = np.concatenate(out) if out else np.zeros(0, np.int64)
    window = np.zeros(n + 1, np.int8)
    np.add.at(window, begin, 1)
    np.add.at(window, begin + wanted, -1)
    return sa[(np.cumsum(window[:-1]) > 0)[sa]]


def repeats(segments: list[bytes], wanted: np.ndarray, rank: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of every window that equals an earlier one; ``rank`` holds the sort
    columns of a segment (last: its first window), most significant first."""
    size = np.array([len(s) for s in segments], dtype=np.int64)
    end = np.cumsum(size)
    begin = end - size
    text = np.frombuffer(b"".join(segments) + bytes(length + 16), np.uint8)
    words = big_words(text)
    sa = suffix_order(text, begin, end, wanted, length, words)
    if len(sa) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    live = np.arange(1, len(sa))  # neighbours whose common prefix still grows
    for d in [*range(0, length - 7, 8), max(0, length - 8)]:
        live = live[words[sa[live] + d] == words[sa[live - 1] + d]] if length >= 8 else live
    if length < 8:
        live = live[(words[sa[live]] >> np.uint64(64 - 8 * length)) == (words[sa[live - 1]] >> np.uint64(64 - 8 * length))]
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(sa), bool)
    same[live] = True
    group = np.cumsum(~same)
    member = same.copy()
    member[:-1] |= same[1:]
    p, g = sa[member], group[member]
    s = np.searchsorted(end, p, "right")
    w = p - begin[s]
    by = np.lexsort((rank[-1][s] + w, *[r[s] for r in rank[-2::-1]], g))
    g, s, w = g[by], s[by], w[by]
    later = np.concatenate([[False], g[1:] == g[:-1]])
    return s[later], w[later]


def _lists(values: np.ndarray, cut: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))


def _unpack(binary: bytes | None, dtype) -> np.ndarray:
    return np.frombuffer(binary or b"", dtype)


def squeeze(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def expand(data: bytes) -> bytes:
    return zstandard.decompress(data) if data else b""


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, nulls, sizes, bytes, data): documents packed in order of arrival, their texts
    compressed; a null id counts as the smallest number and is marked in nulls.  Written once, so block and row numbers stay what they are when a task is
    repeated."""

    def run(batches):
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 33
        ids, sizes, data, held = [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([seq]), pa.array([np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes()]), pa.array([np.array([i is None for i in ids]).tobytes()]),
                 pa.array([np.array(sizes, np.int64).tobytes()]), pa.array([held]), pa.array([squeeze(b"".join(data))])],
                names=["block", "ids", "nulls", "sizes", "bytes", "data"],
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                ids.append(i)
                sizes.append(len(t))
                data.append(t)
                held += len(t)
                if held >= BLOCK_BYTES or len(ids) >= 65_536:
                    yield flush()
                    seq, ids, sizes, data, held = seq + 1, [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return materialize(rows.mapInArrow(run, "block long, ids binary, nulls binary, sizes binary, bytes long, data binary"), "text-blocks")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, salt_blocks: int = SALT_BLOCKS) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    Earlier means a smaller id, then (rows of one id, repeated rows) the order of the packed
    rows, then a smaller start.  A null id comes before all others and is returned as null.
    Null texts are empty; texts under ``length`` bytes are kept whole.  Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    packed = blocks(docs, id_col, text_col)
    total, n_blocks = packed.agg(F.sum("bytes"), F.count("*")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // SHARD_BYTES))
    salts = max(1, -(-n_blocks // salt_blocks))
    names = ["shard", "salt", "block", "id", "doc", "first", "n", "data"]

    def values(batches):
        for b in batches:
            for block, sizes, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                text = np.frombuffer(expand(data), np.uint8)
                v, _, _, _, folds = runs(text, np.concatenate([[0], np.cumsum(_unpack(sizes, np.int64))]), length)
                v, at = np.unique(v, return_inverse=True)
                n = np.bincount(at, weights=1 + folds, minlength=len(v)).astype(np.int64)
                shard = (v % np.uint64(shards)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                v, n, shard = v[by], n[by], shard[by]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(v)]]) if len(v) else np.zeros(1, np.int64)
                keep = [(int(shard[x]), v[x:y].tobytes(), np.minimum(n[x:y], 2**31 - 1).astype(np.int32).tobytes()) for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keep], pa.int64()), pa.array([block % salts] * len(keep), pa.int64()), pa.array([block] * len(keep), pa.int64()), pa.array([k[1] for k in keep], pa.binary()), pa.array([k[2] for k in keep], pa.binary())],
                    names=["shard", "salt", "block", "v", "n"],
                )

    def count(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate([_unpack(x, np.uint64) for x in t.column("v").to_pylist()])
        n = np.concatenate([_unpack(x, np.int32) for x in t.column("n").to_pylist()])
        u, at = np.unique(v, return_inverse=True)
        return u, np.minimum(np.bincount(at, weights=n, minlength=len(u)), 2**31 - 1).astype(np.int32)

    def per_salt(t: pa.Table) -> pa.Table:
        u, n = count(t)
        return pa.table({"shard": t.column("shard")[:1], "salt": t.column("salt")[:1], "v": pa.array([u.tobytes()]), "n": pa.array([n.tobytes()])})

    def per_shard(t: pa.Table) -> pa.Table:
        """For every salt the corpus counts of its own values."""
        u, n = count(t)
        own = [n[np.searchsorted(u, _unpack(x, np.uint64))].tobytes() for x in t.column("v").to_pylist()]
        return pa.table({"shard": t.column("shard"), "salt": t.column("salt"), "v": t.column("v"), "n": pa.array(own, pa.binary())})

    def repeated(offers: pa.Table, counts: pa.Table) -> pa.Table:
        """To each block its values that repeat anywhere, and into how many parts they are split."""
        u, n = count(counts)
        out = []
        for b, x in zip(offers.column("block").to_pylist(), offers.column("v").to_pylist()):
            v = _unpack(x, np.uint64)
            c = n[np.searchsorted(u, v)]
            if (c > 1).any():
                out.append((b, v[c > 1].tobytes(), np.maximum(1, c[c > 1] // HOT_SEGMENTS).astype(np.int32).tobytes()))
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "v": pa.array([o[1] for o in out], pa.binary()), "split": pa.array([o[2] for o in out], pa.binary())})

    offers = packed.select("block", "sizes", "data").mapInArrow(values, "shard long, salt long, block long, v binary, n binary")
    sums = offers.groupBy("shard", "salt").applyInArrow(per_salt, "shard long, salt long, v binary, n binary")
    if salts > 1:
        sums = sums.groupBy("shard").applyInArrow(per_shard, "shard long, salt long, v binary, n binary")
    found = offers.groupBy("shard", "salt").cogroup(sums.groupBy("shard", "salt")).applyInArrow(repeated, "block long, v binary, split binary")
    answers = found.groupBy("block").agg(F.collect_list(F.struct("v", "split")).alias("answers"))

    def segments(batches):
        import xxhash

        for b in batches:
            for block, ids, sizes, data, answer in zip(*(b.column(i).to_pylist() for i in range(5))):
                if answer is None:  # nothing in this block repeats
                    continue
                data = expand(data)
                v = np.concatenate([_unpack(x["v"], np.uint64) for x in answer])
                split = np.concatenate([_unpack(x["split"], np.int32) for x in answer])
                by = np.argsort(v)
                v, split = v[by], split[by]
                ids, off = _unpack(ids, np.int64), np.concatenate([[0], np.cumsum(_unpack(sizes, np.int64))])
                val, doc, first, n, _ = runs(np.frombuffer(data, np.uint8), off, length)
                at = np.minimum(np.searchsorted(v, val), len(v) - 1)
                hit = np.flatnonzero(v[at] == val)
                parts = split[at[hit]]
                val, doc, first, n = val[hit], doc[hit], first[hit], n[hit]
                by = np.lexsort((first, doc, ids[doc]))  # so that the first of equal segments is the earliest
                seen: set[bytes] = set()
                sent: dict[int, list[tuple]] = {}
                marks = []
                for x, d, s, k, many in zip(val[by].tolist(), doc[by].tolist(), first[by].tolist(), n[by].tolist(), parts[by].tolist()):
                    lo = int(off[d]) + s
                    if many == 1:
                        pieces = [(x % shards, s, k)]
                    else:
                        key = [xxhash.xxh64_intdigest(data[lo + i : lo + i + length]) % many for i in range(k)]
                        pieces = [((x + y * 7919) % shards, s + i, 1) for i, y in enumerate(key)]
                    for shard, s, k in pieces:
                        seg = data[int(off[d]) + s : int(off[d]) + s + k - 1 + length]
                        if seg in seen:
                            marks.append((d, s, s + k - 1))
                        else:
                            seen.add(seg)
                            sent.setdefault(shard, []).append((int(ids[d]), d, s, k, seg))
                rows = [(shard, block % salts, block, *(np.array([y[i] for y in x], np.int64).tobytes() for i in range(4)), squeeze(b"".join(y[4] for y in x))) for shard, x in sent.items()]
                if marks:
                    m = np.array(marks, np.int64)
                    rows.append((-1 - block % shards, block % salts, block, b"", m[:, 0].tobytes(), m[:, 1].tobytes(), m[:, 2].tobytes(), b""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.binary()) for i in range(8)], names=names
                )

    def gather(t: pa.Table):
        """Segments of a shard in order of place, the earliest of equal ones apart from the rest:
        columns (id, block, doc, first, n), texts, numbers of the earliest, numbers of later copies."""
        cols, segs = [[] for _ in range(5)], []
        for b, i, d, f, k, data in zip(*(t.column(c).to_pylist() for c in ("block", "id", "doc", "first", "n", "data"))):
            k, data = _unpack(k, np.int64), expand(data)
            for into, x in zip(cols, (_unpack(i, np.int64), np.full(len(k), b, np.int64), _unpack(d, np.int64), _unpack(f, np.int64), k)):
                into.append(x)
            at = np.concatenate([[0], np.cumsum(k - 1 + length)]).tolist()
            segs += [data[x:y] for x, y in zip(at, at[1:])]
        cols = [np.concatenate(x) for x in cols]
        first: dict[bytes, int] = {}
        only, again = [], []
        for i in np.lexsort(cols[3::-1]).tolist():
            (again if first.setdefault(segs[i], i) != i else only).append(i)
        return cols, segs, np.array(only, np.int64), np.array(again, np.int64)

    def by_block(block: np.ndarray):
        """Slices of one block in an array of sorted blocks."""
        return zip(*(lambda c: (c, c[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist())) if len(block) else ()

    def collapse(t: pa.Table) -> pa.Table:
        """Of one salt: the earliest of equal segments go on, later copies become marks."""
        shard, salt = (t.column(c)[0].as_py() for c in ("shard", "salt"))
        if shard < 0:
            return t.select(names)
        (ids, block, doc, first, n), segs, only, again = gather(t)
        rows = []
        only, again = only[np.argsort(block[only], kind="stable")], again[np.argsort(block[again], kind="stable")]
        for x, y in by_block(block[only]):
            o = only[x:y]
            rows.append((shard, salt, int(block[o[0]]), *(c[o].tobytes() for c in (ids, doc, first, n)), squeeze(b"".join(segs[i] for i in o))))
        for x, y in by_block(block[again]):
            o = again[x:y]
            rows.append((-1 - shard, salt, int(block[o[0]]), b"", doc[o].tobytes(), first[o].tobytes(), (first[o] + n[o] - 1).tobytes(), b""))
        return pa.table({c: pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(names)})

    def sort(t: pa.Table) -> pa.Table:
        out_names = ["block", "doc", "lo", "hi"]
        if t.column("shard")[0].as_py() < 0:  # marks made on the way
            return pa.table({"block": t.column("block"), "doc": t.column("doc"), "lo": t.column("first"), "hi": t.column("n")})
        (ids, block, docs_, first, n), segs, only, again = gather(t)
        s, w = repeats([segs[i] for i in only], n[only], [ids[only], block[only], docs_[only], first[only]], length)
        s = only[s]
        o = np.lexsort((w, s))
        s, w = s[o], w[o]
        head = np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1)]) if len(s) else np.zeros(0, bool)
        i, j = np.flatnonzero(head), np.flatnonzero(np.append(head[1:], True)) if len(s) else np.zeros(0, np.int64)
        seg = np.concatenate([s[i], again])
        lo = np.concatenate([first[s[i]] + w[i], first[again]])
        hi = np.concatenate([first[s[i]] + w[j], first[again] + n[again] - 1])
        out = [[], [], [], []]
        by = np.argsort(block[seg], kind="stable")
        seg, lo, hi = seg[by], lo[by], hi[by]
        for x, y in by_block(block[seg]):
            for into, value in zip(out, (int(block[seg[x]]), docs_[seg[x:y]].tobytes(), lo[x:y].tobytes(), hi[x:y].tobytes())):
                into.append(value)
        return pa.table({c: pa.array(x, pa.int64() if c == "block" else pa.binary()) for c, x in zip(out_names, out)})

    # both joins are left joins of the same columns, so that they share one exchange of the blocks
    schema = "shard long, salt long, block long, id binary, doc binary, first binary, n binary, data binary"
    sent = packed.join(answers, "block", "left").select("block", "ids", "sizes", "data", "answers").mapInArrow(segments, schema)
    if salts > 1:
        sent = sent.groupBy("shard", "salt").applyInArrow(collapse, schema)
    marks = sent.groupBy("shard").applyInArrow(sort, "block long, doc binary, lo binary, hi binary")
    marks = marks.groupBy("block").agg(F.collect_list(F.struct("doc", "lo", "hi")).alias("marks"))

    def cut(batches):
        for b in batches:
            for ids, nulls, sizes, data, mark in zip(*(b.column(i).to_pylist() for i in range(5))):
                data = expand(data)
                ids, size = _unpack(ids, np.int64), _unpack(sizes, np.int64)
                off = np.concatenate([[0], np.cumsum(size)])
                doc, lo, hi = (np.concatenate([_unpack(m[c], np.int64) for m in mark or ()] or [np.zeros(0, np.int64)]) for c in ("doc", "lo", "hi"))
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, off[doc] + lo, 1)
                np.add.at(edge, off[doc] + hi + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                raw = np.frombuffer(data, np.uint8)
                out = []
                for d in range(len(ids)):
                    g = gone[off[d] : off[d + 1]]
                    n = int(g.sum())
                    kept = raw[off[d] : off[d + 1]][~g].tobytes() if n else data[off[d] : off[d + 1]]
                    out.append((int(size[d]), n, int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=np.frombuffer(nulls, bool)), *(pa.array([o[i] for o in out], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[i]) for i in range(5))],
                    names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return packed.join(marks, "block", "left").select("ids", "nulls", "sizes", "data", "marks").mapInArrow(
        cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
