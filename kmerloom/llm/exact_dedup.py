"""Exact dedup by skew-safe combining (DataFrame functions only).

1. local: every map task collapses its own equal texts (partial hash aggregation);
2. salted: the survivors of a digest are merged per salt, a salt holding whole map tasks;
3. global: the winners of the salts are merged per digest.

All three aggregations group by the digest *and* the normalised text, so texts are compared
in full and a digest collision cannot join two groups.  On the way back to the rows, frequent
digests are broadcast and the others shuffled, so no task gathers a large group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, attach, materialize

#: keep-order key: code points * STEP + (FLIP - id); decimals stay updatable in a hash aggregate.
STEP, FLIP = 10**20, 10**19


def _lit(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(21,0)")


def _best(id_col: str) -> Column:
    own = F.coalesce(_lit(FLIP) - F.col(id_col).cast("decimal(19,0)"), _lit(0))
    return (F.col("__cp").cast("decimal(10,0)") * _lit(STEP) + own).cast("decimal(38,0)")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and the columns ``keep``.

    Texts are equal when they agree after deletion of ASCII white space; a null text is empty.
    Of equal texts the one with the most code points, then the smallest id, stays; a null id
    loses to every other id and, alone in its group, is kept with a null keep_id.  Of rows that
    also share the id and the number of code points any one stays, so every group keeps exactly
    one row.  An empty table gives an empty result; other columns of the input are ignored,
    whatever their names.  ``digest`` replaces the SHA-256 that routes texts (tests force
    collisions with it); it never decides equality.
    """
    own_digest = digest is None
    digest = digest or (lambda c: F.unhex(F.sha2(c, 256)))
    raw = docs.select(*[F.col(c).alias(f"__keep_{c}") for c in keep], F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__raw"))
    base = raw.select(
        *[f"__keep_{c}" for c in keep],
        "__id",
        F.length("__raw").alias("__cp"),
        F.regexp_replace("__raw", SPACE, "").alias("__norm"),
    ).withColumn("__digest", digest(F.col("__norm").cast("binary")))
    merge = [F.max("__best").alias("__best"), F.sum("__n").alias("__n")]
    salted = (
        base.select(
            "__digest", "__norm", _best("__id").alias("__best"), F.lit(1).cast("long").alias("__n"),
            (F.spark_partition_id() % salts).alias("__salt"),
        )
        .groupBy("__digest", "__salt", "__norm").agg(*merge)
    )
    groups = salted.groupBy("__digest", "__norm").agg(*merge)
    by_digest = materialize(
        groups.groupBy("__digest").agg(F.max("__best").alias("__best"), F.sum("__n").alias("__n"), F.count("*").alias("__contents")),
        "exact-dedup",
    )
    content = ["__digest"] if own_digest else ["__digest", "__norm"]
    # the digest of each row is computed once more and written with a number of the row
    keyed = materialize((base.drop("__norm") if own_digest else base).withColumn("__row", F.monotonically_increasing_id()), "exact-rows")
    out = attach(keyed, by_digest.filter("__contents = 1").drop("__contents"), "__digest", "__n")
    cols = [*keyed.columns, "__best", "__n"]
    clash = by_digest.filter("__contents > 1").select("__digest")
    if clash.limit(1).count():  # two contents under one digest: attach by content
        texts = groups.join(clash, "__digest", "left_semi")
        back = base.withColumn("__row", -1 - F.monotonically_increasing_id()) if own_digest else keyed
        out = out.select(cols).unionByName(back.join(clash, "__digest", "left_semi").join(texts, ["__digest", "__norm"]).select(cols))
    own = F.col("__best") % _lit(STEP)
    keep_id = F.when(own > 0, (_lit(FLIP) - own).cast("long"))
    out = out.withColumn("__keep", keep_id).withColumn("__first", F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__cp") == ((F.col("__best") - own) / _lit(STEP)).cast("long")))
    # rows repeated in id and length are told apart by their number, where there are any
    again = materialize(out.filter("__first").groupBy(*content).agg(F.min("__row").alias("__only"), F.count("*").alias("__times")).filter("__times > 1").drop("__times"), "exact-again")
    if again.limit(1).count():
        chosen = out.filter("__first").join(again, content, "left").withColumn("__first", F.coalesce(F.col("__row") == F.col("__only"), F.lit(True)))
        out = out.filter("NOT __first").unionByName(chosen.select(out.columns))
    sha = F.lower(F.hex("__digest")) if own_digest else F.sha2(F.col("__norm").cast("binary"), 256)
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        F.col("__first").alias("kept"),
        sha.alias("text_sha256"),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
    )
