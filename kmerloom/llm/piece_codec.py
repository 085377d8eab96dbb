"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The model is a BPE vocabulary, whose encodings are exactly the piece sequences in which every
adjacent pair re-encodes to itself.  That is a max-plus (tropical) path problem with weights 0
(compatible) and minus infinity: a state is the last piece and where it ends, and one path
survives.  A giant document is cut into chunks.  For each chunk, in parallel, a transfer
matrix maps every state that may straddle its left edge to the states that straddle its right
edge.  The matrices are combined in a tree: products of ``fan`` neighbours, level by level up to one matrix a document,
then down again, where the states at the two edges of a node fix those between its children.  So no task
holds more than ``fan`` matrices of a document, however long it is, and every chunk is traced back on its own
between its two states.

The vocabulary is expected to leave one path.  Where it does not (none, or several), the document is encoded as one text.

A document of one chunk has the single entry state "start of text", so its trace-back is the
encoding itself and needs no matrix.
"""

from __future__ import annotations

import functools
import json
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
State = tuple[int, str]  # (where the piece ends, the piece); (0, "") is the start of the text
Matrix = dict[State, frozenset[State]]  # finite entries of a max-plus matrix


class Codec:
    """The library's processor and, on demand, the lattice of its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids) if ids else []

    # -- fragments: text that is already normalised (blanks as U+2581, no added prefix) --
    # A line feed is encoded as a byte and never merges, so it shields a fragment from the
    # prefix that the library adds: its first two ids are the prefix and the line feed.

    def fragment(self, norm: str) -> list[int]:
        return self.sp.encode("\n" + norm, num_threads=1)[2:]

    def fragment_text(self, ids: list[int]) -> str:
        return self.sp.decode(self.sp.encode("\n") + ids)[1:].replace(" ", BLANK)

    def _prepare(self) -> None:
        import ahocorasick

        sp, self.automaton = self.sp, ahocorasick.Automaton()
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        for p in pieces:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.chars = {c for p in pieces for c in p}
        self.longest = max(map(len, pieces), default=1)
        self.memo: dict[tuple[str, str], bool] = {}
        self.ids: dict[str, list[int]] = {}

    def follows(self, a: str, b: str) -> bool:
        """Whether piece b may stand after piece a ("": nothing) in an encoding."""
        got = self.memo.get((a, b))
        if got is None:
            if (a and a[0] not in self.chars) or b[0] not in self.chars:
                got = True  # a character outside the vocabulary is spelt in bytes and merges with nothing
            else:
                got = self.sp.encode("\n" + a + b, out_type=str, num_threads=1)[2:] == ([a, b] if a else [b])
            if len(self.memo) > 2_000_000:
                self.memo.clear()
            self.memo[a, b] = got
        return got

    def matches(self, norm: str) -> dict[int, list[str]]:
        """Pieces by the place where they end in ``norm``; unknown characters are pieces too."""
        if self.automaton is None:
            self._prepare()
        out: dict[int, list[str]] = defaultdict(list)
        for i, p in self.automaton.iter(norm):
            out[i + 1].append(p)
        for i, c in enumerate(norm):
            if c not in self.chars:
                out[i + 1].append(c)
        return out

    def transfer(self, norm: str, base: int, p: int, q: int, end: int) -> Matrix:
        """Matrix of the chunk [p, q) of a text of ``end`` characters; norm starts at ``base``
        and shows at least ``longest - 1`` characters around the chunk."""
        ends = self.matches(norm)
        if p == 0:
            entries: list[State] = [(0, "")]
        else:
            reach = range(p, min(p + self.longest, end + 1))
            entries = [(c, t) for c in reach for t in ends.get(c - base, ()) if c - len(t) < p and self.follows("", t)]
        nodes: dict[int, dict[str, int]] = defaultdict(dict)  # place -> piece -> entries that reach it
        for k, (c, t) in enumerate(entries):
            nodes[c][t] = 1 << k
        for i in range(p + 1, min(q + self.longest, end + 1)):
            for t in ends.get(i - base, ()):
                s = i - len(t)
                if p <= s < q and s in nodes:
                    mask = 0
                    for r, m in nodes[s].items():
                        if self.follows(r, t):
                            mask |= m
                    if mask:
                        nodes[i][t] = nodes[i].get(t, 0) | mask
        out: dict[State, set[State]] = {e: set() for e in entries}
        for i in range(q, min(q + self.longest, end + 1)):
            for t, m in nodes.get(i, {}).items():
                if i - len(t) < q and (q < end or i == end):
                    for k, e in enumerate(entries):
                        if m >> k & 1:
                            out[e].add((i, t))
        return {e: frozenset(x) for e, x in out.items() if x}

    def trace(self, norm: str, base: int, p: int, q: int, end: int, entry: State, leaves: State) -> list[int] | None:
        """Ids of the pieces after ``entry`` up to ``leaves`` in the chunk of `transfer`; None unless there is just one path."""
        ends = self.matches(norm)
        nodes: dict[int, dict[str, list[str]]] = defaultdict(dict)  # place -> piece -> pieces before it
        nodes[entry[0]][entry[1]] = []
        for i in range(p + 1, min(q + self.longest, end + 1)):
            for t in ends.get(i - base, ()):
                s = i - len(t)
                if p <= s < q and s in nodes and (before := [r for r in nodes[s] if self.follows(r, t)]):
                    nodes[i][t] = before
        path, at = [], tuple(leaves)
        while at != tuple(entry):
            before = nodes.get(at[0], {}).get(at[1], ())
            if len(before) != 1:
                return None
            path.append(at[1])
            at = (at[0] - len(at[1]), before[0])
        return [i for piece in reversed(path) for i in self.spelt(piece)]

    def spelt(self, piece: str) -> list[int]:
        """The id of a piece, or the bytes of a character outside the vocabulary."""
        got = self.ids.get(piece)
        if got is None:
            got = self.ids[piece] = self.fragment(piece) if piece[0] not in self.chars else [self.sp.piece_to_id(piece)]
        return got


def combine(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product; associative."""
    return {e: out for e, mid in a.items() if (out := frozenset().union(*(b.get(m, frozenset()) for m in mid)))}


def between(matrices: list[Matrix], entry: State, leaves: State) -> list[State] | None:
    """The states at the edges of neighbouring matrices, from ``entry`` to ``leaves``; None unless there is just one path of them."""
    reached = [frozenset([entry])]
    for m in matrices:
        reached.append(frozenset().union(*(m.get(s, frozenset()) for s in reached[-1])))
    if leaves not in reached[-1]:
        return None
    at = [leaves]
    for m, before in zip(reversed(matrices), reversed(reached[:-1])):
        came = [s for s in before if at[-1] in m.get(s, ())]
        if len(came) != 1:
            return None
        at.append(came[0])
    return at[::-1]


def only_end(m: Matrix, end: int) -> State | None:
    """The state that a whole text of ``end`` characters ends in, if there is just one."""
    states = [s for s in m.get((0, ""), ()) if s[0] == end]
    return states[0] if len(states) == 1 else None


def cuts(matrices: list[Matrix], end: int) -> list[int] | None:
    """Where the pieces of each chunk of one text begin, and the end."""
    last = only_end(functools.reduce(combine, matrices), end)
    states = last and between(matrices, (0, ""), last)
    return states and [c for c, _ in states]


def pack(m: Matrix) -> str:
    return json.dumps([[*e, sorted(x)] for e, x in sorted(m.items())])


def unpack(s: str) -> Matrix:
    return {(c, t): frozenset((i, u) for i, u in x) for c, t, x in json.loads(s)}


def _slices(texts: pa.Array, most: int = 1_000_000):
    """Bounds of slices with about ``most`` bytes of text, so that ids take bounded memory."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = 65_536, reach: int = 64, fan: int = 16) -> DataFrame:
    """One row per input row: id, n_tokens, token_ids, round_trip (decoding gives the text).

    Null and empty texts have no tokens and decode to the empty text.  Texts longer than
    ``chunk`` characters go through the scan; results do not depend on ``chunk``.  ``reach``
    is the context around a chunk and must exceed the longest piece; ``fan`` matrices are multiplied in
    one task.  Repeated rows are
    encoded one by one, null ids pass through, extra columns are ignored, and an empty table
    gives no rows.  A text that holds U+2581 is encoded as if that were a blank, as the
    library does, and so has round_trip false.
    """
    if chunk < reach:
        raise ValueError("chunk must be at least reach")
    if fan < 2:
        raise ValueError("fan must be at least 2")
    proto = open(model, "rb").read()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches):
        codec = Codec(proto)
        for b in batches:
            for at, to in _slices(b.column(1)):
                texts = b.column(1).slice(at, to - at).to_pylist()
                ids = codec.encode(texts)
                back = codec.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, to - at), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([x == y for x, y in zip(back, texts)])],
                    names=["id", "n_tokens", "token_ids", "round_trip"],
                )

    schema = "id long, n_tokens long, token_ids array<int>, round_trip boolean"
    small = rows.filter(F.length("text") <= chunk).mapInArrow(whole, schema)
    big = rows.filter(F.length("text") > chunk)
    norm = big.select("id", F.contains("text", F.lit(BLANK)).alias("literal"), F.monotonically_increasing_id().alias("row"), F.concat(F.lit(BLANK), F.translate("text", " ", BLANK)).alias("norm"))
    # one pass cuts a text; a chunk borrows its context from its neighbours
    cut = norm.select("id", "row", "literal", F.length("norm").alias("end"), F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("c"))
    side = lambda f, i: F.coalesce(f(F.get("c", i), F.lit(reach)), F.lit(""))
    whole_parts = F.transform("c", lambda x, i: F.concat(side(F.right, i - 1), x, side(F.left, i + 1)))
    parts = cut.select("id", "row", "literal", "end", F.posexplode(whole_parts).alias("k", "part"))
    parts = parts.select("id", "row", "end", "k", F.greatest(F.lit(0), F.col("k") * chunk - reach).alias("base"), "literal", "part")
    parts = materialize(parts.repartition("row", "k"), "piece-parts")  # spread the chunks, keep row numbers

    def matrix(batches):
        codec = Codec(proto)
        for b in batches:
            out = []
            for end, k, lo, part in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 6))):
                out.append(pack(codec.transfer(part, lo, k * chunk, min(end, (k + 1) * chunk), end)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(out, pa.string())], names=["row", "end", "k", "matrix"])

    chunks = parts.agg(F.max("k")).first()[0]
    if chunks is None:
        return small.withColumnRenamed("id", id_col)

    def product(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        m = functools.reduce(combine, map(unpack, t.column("matrix").to_pylist()))
        return pa.table({"row": t.column("row")[:1], "end": t.column("end")[:1], "k": pa.array([t.column("k")[0].as_py() // fan], pa.int32()), "matrix": [pack(m)]})

    def edges(batches):
        for b in batches:
            last = [only_end(unpack(m), end) for m, end in zip(b.column(3).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([json.dumps((0, ""))] * b.num_rows), pa.array([x and json.dumps(x) for x in last], pa.string())], names=["row", "node", "enters", "leaves"]
            )

    def opened(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        enters, leaves = (t.column(c)[0].as_py() for c in ("enters", "leaves"))
        at = leaves and between([unpack(x) for x in t.column("matrix").to_pylist()], tuple(json.loads(enters)), tuple(json.loads(leaves)))
        states = [json.dumps(x) for x in at] if at else [None] * (t.num_rows + 1)
        return pa.table({"row": t.column("row"), "node": t.column("k"), "enters": pa.array(states[:-1], pa.string()), "leaves": pa.array(states[1:], pa.string())})

    def trace(batches):
        codec = Codec(proto)
        for b in batches:
            ids, same = [], []
            for end, k, lo, literal, part, enters, leaves in zip(*(b.column(i).to_pylist() for i in range(2, 9))):
                got = None
                if leaves is not None:
                    codec.automaton or codec._prepare()
                    enters, leaves = tuple(json.loads(enters)), tuple(json.loads(leaves))
                    got = codec.trace(part, lo, k * chunk, min(end, (k + 1) * chunk), end, enters, leaves)
                ids.append(got)
                same.append(got is not None and not literal and codec.fragment_text(got) == part[enters[0] - lo : leaves[0] - lo])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=["id", "row", "k", "ids", "same"])

    node = F.floor(F.col("k") / fan).cast("int")
    tree = [materialize(parts.mapInArrow(matrix, "row long, end int, k int, matrix string"), "piece-matrices")]
    while chunks > 0:
        chunks //= fan
        tree.append(materialize(tree[-1].groupBy("row", node.alias("node")).applyInArrow(product, "row long, end int, k int, matrix string"), "piece-matrices"))
    states = tree.pop().mapInArrow(edges, "row long, node int, enters string, leaves string")
    for level in reversed(tree):
        children = level.withColumn("node", node).join(states, ["row", "node"])
        states = children.groupBy("row", "node").applyInArrow(opened, "row long, node int, enters string, leaves string")
    found = states.withColumnRenamed("node", "k")
    placed = parts.join(found, ["row", "k"]).select("id", "row", "end", "k", "base", "literal", "part", "enters", "leaves")
    traced = materialize(placed.mapInArrow(trace, "id long, row long, k int, ids array<int>, same boolean"), "piece-traced")
    stray = traced.groupBy("row").agg(F.bool_or(F.col("ids").isNull()).alias("stray")).filter("stray").select("row")
    giant = traced.join(stray, "row", "left_anti").groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x"), F.min("same").alias("same"))
    giant = giant.select("row", "id", F.flatten(F.transform("x", lambda p: p.ids)).alias("token_ids"), "same")
    giant = giant.select("id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.col("same").alias("round_trip"))
    # texts of another number of paths are put together again, without the first blank
    own = F.substring("part", F.col("k") * chunk - F.col("base") + 1, F.lit(chunk))
    again = parts.join(stray, "row").groupBy("row").agg(F.first("id").alias("id"), F.first("literal").alias("literal"), F.array_sort(F.collect_list(F.struct("k", own.alias("own")))).alias("x"))
    again = again.select("id", F.translate(F.expr("substring(array_join(transform(x, p -> p.own), ''), 2)"), BLANK, " ").alias("text"), "literal")
    rest = again.select("id", "text", "literal").mapInArrow(lambda bs: with_literal(bs, whole), schema)
    return small.unionByName(giant).unionByName(rest).withColumnRenamed("id", id_col)


def with_literal(batches, encode_batches):
    """``encode_batches`` on (id, text); round_trip is false where a third column says that the text held U+2581 itself."""
    for b in batches:
        literal, at = b.column(2), 0
        for out in encode_batches([b.select([0, 1])]):
            same = pc.and_(out.column(3), pc.invert(literal.slice(at, out.num_rows)))
            at += out.num_rows
            yield pa.RecordBatch.from_arrays([*out.columns[:3], same], names=out.schema.names)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """(id, text) of rows (id, token_ids); a null list decodes to the empty text."""
    proto = open(model, "rb").read()

    def run(batches):
        codec = Codec(proto)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.decode([x or [] for x in part.column(1).to_pylist()]), pa.string())], names=[id_col, "text"])

    return tokens.select(F.col(id_col).cast("long").alias(id_col), ids_col).mapInArrow(run, f"`{id_col}` long, text string")
