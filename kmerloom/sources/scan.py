"""Scan of sequence files of any size.

Spark's text reader cuts files in blocks at lines and unpacks gzip.  What a block means depends on what came before:
whether a quality line is pending, the record, and the run of bases that goes on.  So a first pass sums
every block up (for either pending state), the summaries of a file are folded in order, one small row a
block, and a second pass reads the lines again with the state in which their block begins.

Runs leave as pieces.  A piece that goes on from an earlier one repeats its last k - 1 bases (``carry``), so the
pieces of a run have just the k-mers of the run, and no task holds more of it than a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import kernels, u64
from ..params import SketchParams
from ..session import small

PIECES = "path string, record_id long, header string, segment_id long, at long, carry int, seq string"
STATE = "path string, start long, pending boolean, record_id long, header string, segment_id long, at long, open boolean, tail binary"
SUMMARY = "path string, start long, pending boolean, ends_pending boolean, records long, header string, broken boolean, joins boolean, segments long, open boolean, length long, tail binary"
#: Bases of a piece, and blocks whose states are broadcast.
LONGEST, BLOCKS = 1 << 20, 2_000_000
_SPACE, _RUNS = b" \t\v\f\r\n", re.compile(b"[ACGT]+|[^ACGT]+")
_MARKED, _SEEN = re.compile(rb"^[ \t\v\f\r]*([>@+])([^\n]*)", re.M), re.compile(rb"[^ \t\v\f\r\n][^\n]*")


def events(text: bytes, pending: bool) -> Iterator[tuple[str, bytes]]:
    """What whole lines say, in order: a record with its header, a break of the run, or bases; at last ``pending`` or
    ``clear``, the state behind them."""
    at = 0
    while at < len(text):
        if pending:
            m = _SEEN.search(text, at)
            if not m:
                break
            pending, at = False, m.end()
            yield "break", b""
            continue
        m = _MARKED.search(text, at)
        for x in _RUNS.findall(text[at : m.start() if m else len(text)].translate(None, _SPACE).upper()):
            yield "bases" if x[:1] in b"ACGT" else "break", x
        if not m:
            break
        pending, at = m[1] == b"+", m.end()
        yield ("break", b"") if pending else ("record", m[2].rstrip(_SPACE))
    yield "pending" if pending else "clear", b""


@dataclass
class Summary:
    """A block that is entered with ``pending``: records begun and the last header; whether a run ended in it (broken) and whether
    bases come before that (joins the run before); runs begun since the last record, or in all
    (one that joins not counted); the run at its end: open, its length here, its last bases."""

    k: int
    pending: bool
    ends: bool = False
    records: int = 0
    header: bytes | None = None
    broken: bool = False
    joins: bool = False
    segments: int = 0
    open: bool = False
    length: int = 0
    tail: bytes = b""

    def __post_init__(self) -> None:
        self.ends = self.pending

    def add(self, text: bytes) -> None:
        for kind, x in events(text, self.ends):
            if kind == "bases":
                if not self.open:
                    self.joins |= not self.broken
                    self.segments += self.broken
                    self.length, self.tail = 0, b""
                self.open, self.length = True, self.length + len(x)
                self.tail = (self.tail + x[-self.k :])[-(self.k - 1) :] if self.k > 1 else b""
            elif kind in ("pending", "clear"):
                self.ends = kind == "pending"
            else:
                self.broken, self.open = True, False
                if kind == "record":
                    self.records, self.header, self.segments = self.records + 1, x, 0


@dataclass
class Run:
    """Where a file stands: record (-1 before the first), the number of its next or open run, and that run so far."""

    pending: bool = False
    record: int = -1
    header: bytes = b""
    segment: int = 0
    at: int = 0
    open: bool = False
    tail: bytes = b""

    def after(self, s: dict, k: int) -> Run:
        """The state behind a block with summary ``s``."""
        joined = s["joins"] and self.open
        if not s["broken"]:  # bases only, or nothing
            if not s["open"]:
                return Run(s["ends_pending"], self.record, self.header, self.segment, self.at, self.open, self.tail)
            tail = (self.tail if joined else b"") + s["tail"]
            return Run(s["ends_pending"], self.record, self.header, self.segment, (self.at if joined else 0) + s["length"], True, tail[len(tail) - min(len(tail), k - 1) :])
        if s["records"]:
            done, record, header = 0, self.record + s["records"], s["header"]
        else:  # the run before ended here, or one that came first did
            done, record, header = self.segment + (self.open or s["joins"]), self.record, self.header
        segment = done + s["segments"] - s["open"]
        return Run(s["ends_pending"], record, header, segment, s["length"] if s["open"] else 0, s["open"], s["tail"] if s["open"] else b"")


@dataclass
class Cutter:
    """Turns lines into pieces from a state on."""

    run: Run
    k: int
    rows: list[tuple] = field(default_factory=list)
    held: list[bytes] = field(default_factory=list)
    size: int = 0

    def flush(self) -> None:
        """The bases held go, as a piece of the open run."""
        if self.size:
            r, new = self.run, b"".join(self.held)
            seq = r.tail + new
            self.rows.append((max(r.record, 0), r.header.decode("utf-8", "replace"), r.segment, r.at - len(r.tail), len(r.tail), seq.decode()))
            r.at, r.tail = r.at + len(new), seq[len(seq) - min(len(seq), self.k - 1) :]
            self.held, self.size = [], 0

    def add(self, text: bytes) -> None:
        r = self.run
        for kind, x in events(text, r.pending):
            if kind in ("pending", "clear"):
                r.pending = kind == "pending"
                continue
            if kind == "bases":
                if not r.open:
                    r.open, r.at, r.tail = True, 0, b""
                for at in range(0, len(x), LONGEST):
                    self.held.append(x[at : at + LONGEST])
                    self.size += len(self.held[-1])
                    if self.size >= LONGEST:
                        self.flush()
                continue
            self.flush()
            r.segment += r.open
            r.open = False
            if kind == "record":
                r.record, r.header, r.segment = r.record + 1, x, 0


def _lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
    return spark.read.option("lineSep", "\n").text(paths).select(*where, F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line"))


def _blocks(batches) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(first of its block, rows of one block) of batches whose first columns are path and start."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        path, start = b.column(0), b.column(1)
        new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = path[lo].as_py(), start[lo].as_py()
            yield key != last, b.slice(lo, hi - lo)
            last = key


def summaries(lines: DataFrame, k: int) -> DataFrame:
    """SUMMARY rows of lines (path, start, line), two for each block."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]

    def table(done: list) -> pa.RecordBatch:
        rows = [(*key, s.pending, s.ends, s.records, (s.header or b"").decode("utf-8", "replace"), s.broken, s.joins, s.segments, s.open, s.length, s.tail) for key, both in done for s in both]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches):
        done: list = []
        for first, rows in _blocks(batches):
            if first:
                done.append(((rows.column(0)[0].as_py(), rows.column(1)[0].as_py()), [Summary(k, False), Summary(k, True)]))
            text = b"\n".join(rows.column(2).to_pylist())
            for s in done[-1][1]:
                s.add(text)
        if done:
            yield table(done)

    return lines.select("path", "start", "line").mapInArrow(run, SUMMARY)


def entry_states(found: DataFrame, k: int) -> DataFrame:
    """STATE rows: how each block of SUMMARY rows is entered.  A file's blocks, a small row each, meet in one task."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def fold(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        by = {(r["start"], r["pending"]): r | {"header": r["header"].encode()} for r in rows}
        state, out = Run(), []
        for start in sorted({r["start"] for r in rows}):
            out.append((rows[0]["path"], start, state.pending, state.record, state.header.decode("utf-8", "replace"), state.segment, state.at, state.open, state.tail))
            state = state.after(by[start, state.pending], k)
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.table([pa.array([r[i] for r in out], x) for i, x in enumerate(kinds)], names=names)

    return found.groupBy("path").applyInArrow(fold, STATE)


def scan(spark: SparkSession, paths: list[str] | str, k: int) -> DataFrame:
    """PIECES of files (or folders of them), gzip by name: runs of A, C, G and T in upper case, cut by records
    and by any other visible character, white space skipped.

    ``at`` is the place of a piece's first base in its run, of which ``carry`` bases (at most k - 1) are
    in the piece before too.  Files without bases have no row.
    """
    if k < 1:
        raise ValueError("k must be positive")
    lines = _lines(spark, paths)
    states = entry_states(summaries(lines, k), k)
    near = small(states, BLOCKS)
    rows = lines.join(near, ["path", "start"])
    if near is states:  # too many blocks to broadcast
        rows = rows.repartition("path", "start").sortWithinPartitions("path", "start", "row")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        path, cut = None, None

        def batch() -> pa.RecordBatch:
            r = cut.rows
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array([path] * len(r), pa.string()), *(pa.array([x[i] for x in r], t) for i, t in enumerate(kinds))], names=names)
            cut.rows = []
            return out

        for first, rows in _blocks(batches):
            if first:
                if cut:
                    cut.flush()
                    yield batch()
                path, state = rows.column(0)[0].as_py(), [rows.column(i)[0].as_py() for i in range(3, 10)]
                cut = Cutter(Run(*state[:2], state[2].encode(), *state[3:]), k)
            cut.add(b"\n".join(rows.column(2).to_pylist()))
            if cut.rows:
                yield batch()
        if cut:
            cut.flush()
            yield batch()

    made = rows.select("path", "start", "line", "pending", "record_id", "header", "segment_id", "at", "open", "tail").mapInArrow(run, PIECES)
    return made.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def whole_segments(pieces: DataFrame) -> DataFrame:
    """(path, record_id, header, segment_id, seq): runs put together, for those that fit in a row."""
    own = F.struct("at", F.expr("substr(seq, carry + 1)").alias("s"))
    runs = pieces.groupBy("path", "record_id", "header", "segment_id").agg(F.array_sort(F.collect_list(own)).alias("p"))
    return runs.select("path", "record_id", "header", "segment_id", F.array_join(F.col("p.s"), "").alias("seq"))


def piece_minima(pieces: DataFrame, p: SketchParams, buckets: int | None = None) -> DataFrame:
    """(path, bucket, rank): registers of whole files from their pieces, minima of minima; a file of any size is
    spread over as many tasks as it has blocks."""
    n = buckets or p.buckets

    def run(batches):
        for b in batches:
            for i, seq in enumerate(b.column(1)):
                reg = kernels.registers([seq.as_py().encode()], p, n)
                at = np.flatnonzero(reg != kernels.U(kernels.EMPTY))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(at), i))), pa.array(at.astype(np.int32)), pa.array(reg[at].view(np.int64))], names=["path", "bucket", "rank"])

    rows = pieces.select("path", "seq").mapInArrow(run, "path string, bucket int, rank long")
    return rows.groupBy("path", "bucket").agg(u64.umin(F.col("rank")).alias("rank"))
