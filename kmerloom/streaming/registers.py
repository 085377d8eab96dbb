"""Registers kept up to date by a stream.

Bucket minima merge by minimum, so they are a plain streaming aggregate; the parity sketch is
not mergeable (flips cancel) and is derived from the minima when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.sequences import segments
from ..operators.kmers import explode_kmers
from ..operators.sketch import bucket_minima, hash_kmers
from ..params import SketchParams


def streaming_minima(texts: DataFrame, p: SketchParams, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """(id, bucket, rank) of a stream of (id, seq) parts; use output mode update or complete.
    k-mers that span two parts need the parts to overlap by k - 1 bases."""
    from pyspark.sql import functions as F

    parts = texts.select(id_col, F.explode(segments(F.col(seq_col))).alias("seq"))
    return bucket_minima(hash_kmers(explode_kmers(parts, p.k, id_col), p.k, p.canonical), p, id_col=id_col)
