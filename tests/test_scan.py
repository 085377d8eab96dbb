"""The scan of sequence files by blocks gives what a reading of the whole file gives."""

import gzip
import random

import numpy as np
import pytest

from kmerloom.functions import kernels
from kmerloom.params import SketchParams
from kmerloom.sources import scan as sc
from kmerloom.sources.sequences import parse_lines

FILES = [
    b"", b"\n\n", b"ACGT", b"acgt\nACGT\n", b">a\nAC GT\r\n\nac\n>b\nGGNTT\n", b"@r\nACGT\n+\n\n@@@@\nGG\n", b"ACRYGT\n>x", b"+\n+\nAC\n+\n>not a record\nGG\nTT\n", b"  >h 1 \nAC\n  +  \n  A\nGT\nNN\nAC",
    b">a\n>b\n>c\nACGTACGT\nACGT\n\n\nACGTNNACGT\nAA\n", b">one\n" + b"ACGTTGCA" * 9 + b"\n" + b"GATTACA\n" * 7 + b"n\n" + b"CCCC\n" * 3, b"@q1\nACGTAC\n+q1\n>>>>>>\n@q2\nTTGGN\n+\n@@@@@\n",
]


def by_blocks(content, cuts, k):
    """(pieces, what they put together): summary, fold and second pass over lines cut in blocks at these lines."""
    lines = content.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    blocks = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)])]
    state, rows = sc.Run(), []
    for block in blocks:
        cut = sc.Cutter(sc.Run(*vars(state).values()), k)
        for line in block:
            cut.add(line)
        cut.flush()
        rows += cut.rows
        sums = {}
        for pending in (False, True):
            s = sc.Summary(k, pending)
            s.add(b"\n".join(block))
            sums[pending] = vars(s) | {"ends_pending": s.ends, "header": s.header or b""}
        state = state.after(sums[state.pending], k)
        seen = [{n: v for n, v in vars(x).items() if x.open or n not in ("at", "tail")} for x in (state, cut.run)]
        assert seen[0] == seen[1], block
    whole = {}
    for record, header, segment, at, carry, seq in rows:
        have = whole.setdefault((record, header, segment), "")
        assert at + carry == len(have) and have[len(have) - carry :] == seq[:carry] and carry == min(k - 1, len(have))
        whole[record, header, segment] = have + seq[carry:]
    return rows, [(*key, s) for key, s in sorted(whole.items())]


@pytest.mark.parametrize("k", [1, 2, 5, 31])
def test_a_file_cut_at_every_line_gives_its_segments(k):
    for content in FILES:
        want = sorted(parse_lines(content))
        n = len(content.split(b"\n"))
        for a in range(n):
            for b in range(a, n):
                _, got = by_blocks(content, sorted({a, b} - {0}), k)
                assert got == want, (content, a, b)
        assert by_blocks(content, list(range(1, n)), k)[1] == want


def test_random_files_cut_anywhere():
    rng = random.Random(4)
    for _ in range(400):
        lines = [rng.choice([b"", b">h", b"@r", b"+", b"+x", b"  ", b"ACGT", b"acg", b"ANT", b"NN", b"TTTTTTT\r"]) for _ in range(rng.randrange(1, 14))]
        content = b"\n".join(lines) + b"\n"
        cuts = sorted(rng.sample(range(1, len(lines) + 1), rng.randrange(0, len(lines))))
        assert by_blocks(content, cuts, rng.choice([1, 3, 6]))[1] == sorted(parse_lines(content))


def test_long_runs_leave_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(sc, "LONGEST", 10)
    rows, got = by_blocks(b"ACGTTGCATT" * 5 + b"A\n" + b"ACG\n" * 9, [1, 4], 4)
    assert max(len(r[5]) for r in rows) <= 10 + 10 + 3 and got == [(0, "", 0, "ACGTTGCATT" * 5 + "A" + "ACG" * 9)]


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_spark_blocks_of_many_sizes(spark, tmp_path, small_blocks, monkeypatch):
    rng = random.Random(9)
    big = b">big one\n" + b"\n".join(bytes(rng.choice(b"ACGTacgt") if rng.random() < 0.99 else rng.choice(b"NR \t") for _ in range(60)) for _ in range(60)) + b"\n@r\nAC\n+\n@@\nGGT\n"
    want = set()
    for i, content in enumerate([*FILES, big]):
        (tmp_path / f"{i:02}.fna").write_bytes(content)
        want |= {(str(tmp_path / f"{i:02}.fna"), *x) for x in parse_lines(content)}
    (tmp_path / "z.fna.gz").write_bytes(gzip.compress(big))
    want |= {(str(tmp_path / "z.fna.gz"), *x) for x in parse_lines(big)}
    for size in (37, 1000, 1 << 20):
        small_blocks(size)
        assert {tuple(r) for r in sc.whole_segments(sc.scan(spark, str(tmp_path), 5)).collect()} == want
    monkeypatch.setattr(sc, "small", lambda df, rows: df)  # states too many to broadcast
    small_blocks(200)
    pieces = sc.scan(spark, str(tmp_path), 5)
    assert {tuple(r) for r in sc.whole_segments(pieces).collect()} == want


def test_registers_of_pieces_are_those_of_the_file(spark, tmp_path, small_blocks):
    rng = random.Random(11)
    content = b">a\n" + b"\n".join(bytes(rng.choice(b"ACGT") for _ in range(70)) for _ in range(120)) + b"\nNN\nACGTACGTACGTACGTACGTAC\n>b\n" + b"GATTACA" * 30 + b"\n"
    (tmp_path / "a.fna").write_bytes(content)
    p = SketchParams(1024, 21, True, 0.9, "mix")
    small_blocks(500)
    pieces = sc.scan(spark, [str(tmp_path / "a.fna")], p.k)
    assert pieces.count() > 10
    reg = kernels.registers([s.encode() for *_, s in parse_lines(content)], p, p.buckets)
    at = np.flatnonzero(reg != kernels.U(kernels.EMPTY))
    assert {r.bucket: r.rank for r in sc.piece_minima(pieces, p).collect()} == dict(zip(at.tolist(), reg[at].view(np.int64).tolist()))
