"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 32 bytes marks one place in ``mean`` as a cut, so an insertion moves only
the chunks around it.  Every cut at least ``least`` bytes into a chunk ends it, or ``most`` bytes do.  By
default every cut counts, so the chunks of a passage agree from its first cut on, wherever it stands.  Chunks are deduplicated by a 128-bit digest: the earliest chunk of the
corpus stays, later ones are duplicates.  Adjacent duplicates form a run, and runs of ``run``
bytes or more are removed: single short chunks, such as the last one of a text, meet by chance.

Documents are packed into blocks; a block sends each of its digests once, with its smallest
id, to the digest's shard.  Shards are salted by block: winners are chosen per salt, then
among the salts, and only digests that a block must act on travel back.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .suffix_dedup import blocks, expand

GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)
#: Bytes that the hash of a place covers.
WINDOW = 32
#: Blocks whose digests one salt of a shard gathers.
SALT_BLOCKS = 4096
#: Bytes of text whose digests one shard gathers, and shards that one task takes in turn.
SHARD_BYTES, SHARDS = 8 << 20, 8


def cut_candidates(data: np.ndarray, mean: int) -> np.ndarray:
    """Places after which the gear hash of the last 32 bytes is in the lowest ``mean``-th of its range."""
    h, span = GEAR[data], 1
    while span < WINDOW and span < len(h):
        h = h.copy() if span == 1 else h
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return np.flatnonzero(h < np.uint32((1 << 32) // mean)) + 1


def chunk_ends(size: int, candidates: list[int], least: int, most: int) -> list[int]:
    """Ends of the chunks of a text whose cut candidates are sorted; the last chunk may be short."""
    ends, at = [], 0
    while at < size:
        k = bisect_left(candidates, at + least)
        end = min(candidates[k] if k < len(candidates) else size, at + most, size)
        ends.append(end)
        at = end
    return ends


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, mean: int = 40, most: int = 256, run: int = 80, salt_blocks: int = SALT_BLOCKS) -> DataFrame:
    """One row per input row: id, n_bytes, n_chunks, n_removed_chunks, n_removed, kept_sha256,
    kept (the bytes left).

    Earlier means a smaller id, then the order of the packed rows (repeated rows), then a
    smaller offset; a null id comes first and is returned as null.  Null texts are empty and
    have no chunks.  A text under ``run`` bytes is kept whole.  Extra columns are ignored; an
    empty table gives no rows.
    """
    packed = blocks(docs, id_col, text_col)
    total, n_blocks = packed.agg(F.sum("bytes"), F.count("*")).first()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, -(-(total or 0) // SHARD_BYTES))
    salts = max(1, -(-n_blocks // salt_blocks))
    tasks = max(partitions, shards * salts // SHARDS)

    def split(data: bytes, sizes: bytes):
        """(digest, document, offset, end) of every chunk of a block."""
        size = np.frombuffer(sizes, np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        marks = cut_candidates(np.frombuffer(data, np.uint8), mean)
        first = np.searchsorted(marks, off, "right")
        whole = np.searchsorted(marks, off + WINDOW)  # a cut looks at bytes of its own text only
        for d in range(len(size)):
            lo = int(off[d])
            at = 0
            for end in chunk_ends(int(size[d]), (marks[whole[d] : first[d + 1]] - lo).tolist(), least, most):
                yield hashlib.blake2b(data[lo + at : lo + end], digest_size=16).digest(), d, at, end
                at = end

    def offer(batches):
        for b in batches:
            for block, ids, sizes, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                own = np.frombuffer(ids, np.int64).tolist()
                best: dict[bytes, int] = {}
                for key, d, _, _ in split(expand(data), sizes):
                    if own[d] < best.get(key, 2**63):
                        best[key] = own[d]
                keys, least_id = np.frombuffer(b"".join(best), "V16"), np.array(list(best.values()), np.int64)
                shard = (keys.view(np.uint64)[::2] % np.uint64(shards)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                keys, least_id, shard = keys[by], least_id[by], shard[by]
                cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cut]), pa.array([block % salts] * n, pa.int64()), pa.array([block] * n, pa.int64()),
                     *(pa.array([x.tobytes() for x in np.split(v, cut[1:])] if n else [], pa.binary()) for v in (keys, least_id))],
                    names=["shard", "salt", "block", "keys", "ids"],
                )

    def gather(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests (as void16), ids, blocks and row numbers of all rows; each row has one block, or one
        for every digest."""
        keys = [np.frombuffer(x, "V16") for x in t.column("keys").to_pylist()]
        held = [len(k) for k in keys]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("ids").to_pylist()])
        if pa.types.is_binary(t.schema.field("block").type):
            block = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("block").to_pylist()])
        else:
            block = np.repeat(t.column("block").to_numpy(), held)
        return np.concatenate(keys), ids, block, np.repeat(np.arange(len(keys)), held)

    def winners(keys: np.ndarray, ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct digests, the id and block of the earliest, and the digest of each row."""
        k = keys.view(np.uint64).reshape(-1, 2)
        by = np.lexsort((block, ids, k[:, 1], k[:, 0]))
        k = k[by]
        head = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(head) - 1
        return keys[by][head], ids[by][head], block[by][head], number

    def per_salt(t: pa.Table) -> pa.Table:
        k, i, b, _ = winners(*gather(t)[:3])
        return pa.table({"shard": t.column("shard")[:1], "salt": t.column("salt")[:1], **{n: pa.array([x.tobytes()]) for n, x in (("keys", k), ("ids", i), ("block", b))}})

    def per_shard(t: pa.Table) -> pa.Table:
        """For every salt the global winners of its own digests."""
        keys, ids, block, row = gather(t)
        _, i, b, number = winners(keys, ids, block)
        salt = t.column("salt").to_pylist()
        parts = [np.flatnonzero(row == r) for r in range(len(salt))]
        return pa.table({
            "shard": pa.array([t.column("shard")[0].as_py()] * len(salt), pa.int64()), "salt": pa.array(salt, pa.int64()),
            **{n: pa.array([x[p].tobytes() for p in parts]) for n, x in (("keys", keys), ("ids", i[number]), ("block", b[number]))},
        })

    def reply(offers: pa.Table, won: pa.Table) -> pa.Table:
        """To each block: every digest of its offer that another block won."""
        best: dict = {}
        for k, p in zip(won.column("keys").to_pylist(), won.column("block").to_pylist()):
            best.update(zip(np.frombuffer(k, "V16").tolist(), np.frombuffer(p, np.int64).tolist()))
        blocks_, out = [], []
        for block, k in zip(offers.column("block").to_pylist(), offers.column("keys").to_pylist()):
            lost = b"".join(x for x in np.frombuffer(k, "V16").tolist() if best[x] != block)
            if lost:
                blocks_.append(block)
                out.append(lost)
        return pa.table({"block": pa.array(blocks_, pa.int64()), "lost": pa.array(out, pa.binary())})

    offers = packed.select("block", "ids", "sizes", "data").mapInArrow(offer, "shard long, salt long, block long, keys binary, ids binary").repartition(tasks, "shard", "salt")
    pairs = "shard long, salt long, keys binary, ids binary, block binary"
    won = offers.groupBy("shard", "salt").applyInArrow(per_salt, pairs)
    if salts > 1:
        won = won.repartition(max(partitions, shards // SHARDS), "shard").groupBy("shard").applyInArrow(per_shard, pairs)
    won = won.repartition(tasks, "shard", "salt")
    lost = offers.groupBy("shard", "salt").cogroup(won.groupBy("shard", "salt")).applyInArrow(reply, "block long, lost binary")
    lost = lost.groupBy("block").agg(F.collect_list("lost").alias("lost"))

    def cut(batches):
        for b in batches:
            for ids, nulls, sizes, data, gone in zip(*(b.column(i).to_pylist() for i in range(5))):
                data = expand(data)
                own, size = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
                off = np.concatenate([[0], np.cumsum(size)]).tolist()
                drop = {x[i : i + 16] for x in gone or () for i in range(0, len(x), 16)}
                first: dict[bytes, tuple] = {}
                chunks = list(split(data, sizes))
                for key, d, at, _ in chunks:
                    place = (int(own[d]), d, at)
                    if key not in first or place < first[key]:
                        first[key] = place
                out = [[0, 0, 0, 0, []] for _ in size]  # chunks, removed chunks, removed bytes, kept up to here, kept pieces
                i = 0
                while i < len(chunks):  # a run of chunks of one document, all duplicates or none
                    key, d, start, end = chunks[i]
                    again = key in drop or first[key] != (int(own[d]), d, start)
                    k = i + 1
                    while k < len(chunks) and chunks[k][1] == d and again == (chunks[k][0] in drop or first[chunks[k][0]] != (int(own[d]), d, chunks[k][2])):
                        end = chunks[k][3]
                        k += 1
                    o = out[d]
                    o[0] += k - i
                    if again and end - start >= run:
                        o[1] += k - i
                        o[2] += end - start
                        o[4].append(data[off[d] + o[3] : off[d] + start])
                        o[3] = end
                    i = k
                kept = [b"".join([*o[4], data[off[d] + o[3] : off[d + 1]]]) for d, o in enumerate(out)]
                long = [pa.array(x, pa.int64()) for x in (size, [o[0] for o in out], [o[1] for o in out], [o[2] for o in out])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, mask=np.frombuffer(nulls, bool)), *long, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                    names=[id_col, "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "kept_sha256", "kept"],
                )

    return packed.join(lost, "block", "left").select("ids", "nulls", "sizes", "data", "lost").mapInArrow(
        cut, f"`{id_col}` long, n_bytes long, n_chunks long, n_removed_chunks long, n_removed long, kept_sha256 string, kept binary"
    )
