"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.llm.common import materialize, recorded, remove, table
from kmerloom.llm.exact_dedup import exact_dedup
from kmerloom.llm.mixing import mix
from kmerloom.llm.piece_codec import encode
from kmerloom.llm.queries import held_out
from kmerloom.llm.simhash import jaccard_near_duplicates
from kmerloom.llm.toxicity import toxicity
from kmerloom.session import small


#: The tables that the stages of one run have left, while `run` calls them.
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)
#: (stage, path) of tables left by stages that were called one by one, by session.
_left: dict[str, list[tuple[int, str]]] = {}


def _reads(df: DataFrame, paths: list[str]) -> set[str]:
    """Those of ``paths`` whose files the plan of ``df`` reads."""
    files = df.inputFiles()
    return {p for p in paths if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)}


def _stage(f: Callable) -> Callable:
    """Deletes the tables of a stage that its result does not read as soon as the stage has planned its result.

    What the result does read belongs to the run (see `run`).  Where stages are called one by one, it stays until a later
    stage is called on documents that do not read it, which thus have been written and read again; so
    stages may be chained without writing.  Callers who take turns between several
    chains of single stages in one session write each result before they go on."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app, own = spark.sparkContext.applicationId, _run.get()
        at = [stage for _, stage in STAGES].index(run_stage)
        if own is None:
            left = _left.get(app, [])
            live = _reads(docs, [p for _, p in left])
            _left[app] = [(k, p) for k, p in left if k >= at or p in live]
            for k, path in left:
                if k < at and path not in live:
                    remove(spark, path)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        live = _reads(out, paths)
        for path in set(paths) - live:
            remove(spark, path)
        if own is None:
            _left[app] += [(at, p) for p in live]
        else:
            own += live
        return out

    return run_stage


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written once so that it stays what it is, and that column's name.  Stages drop
    rows by it, since ids may be null or repeated."""
    row = _free(docs, "__row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def _without(rows: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """``rows`` less those of ``gone``, which are broadcast if a count finds few."""
    return rows.join(small(materialize(gone.select(row), "pipeline-gone")), row, "left_anti").drop(row)


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the rows predicted toxic; null and empty texts stay."""
    rows, row = _numbered(docs)
    return _without(rows, toxicity(rows, table(spark, sf_dir, "labels"), held_out(5, 0), keep=(row,)).filter("predicted = 1"), row)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside; null is empty) one row stays: the longest, then the
    smallest doc_id, nulls last."""
    rows, row = _numbered(docs)
    return _without(rows, exact_dedup(rows, keep=(row,)).filter("NOT kept"), row)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the row with the
    smallest doc_id stays, nulls last; of several such rows the first one."""
    rows, row = _numbered(docs)
    groups = materialize(jaccard_near_duplicates(rows, row), "pipeline-near")
    every = groups.unionByName(groups.select(F.col("component").alias(row), "component")).distinct()  # the first row of a group too
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))
    members = materialize(every.join(rows.select(row, "doc_id"), row).select(row, "component", order.alias("place")), "pipeline-members")
    stays = members.groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.row").alias(row))
    return _without(rows, members.join(stays, row, "left_anti"), row)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each row as often as the mix takes it (0, 1 or 2 times)."""
    rows, row = _numbered(docs)
    n = _free(docs, "__copies")
    taken = mix(rows, keep=(row,)).filter("copies > 0").select(row, F.col("copies").cast("int").alias(n))
    return rows.join(taken, row).withColumn(_free(docs, "__copy"), F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


@_stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip of every row."""
    return encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenise),
]

#: Learnt scores, fingerprints and piece ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents.

    The tables of a run are its own: those of a stage go once its result has been written, and what the
    result of the last stage reads stays."""
    docs = table(spark, sf_dir, "documents")
    read: list[str] = []  # what the stage at work reads
    token = _run.set([])
    try:
        for k, (_, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            if k + 1 == len(STAGES):
                return out
            docs = materialize(out, f"pipeline-{k}")
            for path in read + _run.get():
                remove(spark, path)
            _run.set([])
            read = [docs._written_at]
    finally:
        _run.reset(token)
