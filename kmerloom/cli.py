"""Command line: sketch, dist and eval.

Options are ``--name value`` or ``--name=value``; words without dashes are ignored, unknown
options are errors, and flags ignore a value.  Results go to standard output as TSV.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.paths import sketch_path
from .operators import dist, sketch
from .params import SketchParams
from .session import session
from .sources import lists, sequences, sketch_files, tables

USAGE = """usage: kmerloom sketch [--input-paths FILE] [--out-dir DIR] [--sketch-paths-out FILE] [--skip-existing] [sketch options]
       kmerloom dist (--all-to-all | --bipartite --qlist FILE --dblist FILE | --pairlist FILE) [--j0 X]
       kmerloom eval --pairlist FILE [--seed N] [--oph-buckets N] [sketch options]
sketch options: --kmer N --sketch-size BITS --j0 X --pos-mode value|mix|stripe --canonical true|false --threads N"""

ALIASES = {"kmerlen": "kmer", "manifest": "sketch-paths-out", "alltoall": "all-to-all", "j-threshold": "j0", "seed": "hash-seed"}
FLAGS = {"skip-existing", "all-to-all", "bipartite"}
VALUES = {"input-paths", "qlist", "dblist", "pairlist", "out-dir", "sketch-paths-out", "kmer", "sketch-size", "j0", "pos-mode", "canonical", "threads", "hash-seed", "oph-buckets"}
TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


class UsageError(ValueError):
    pass


@dataclass
class Request:
    mode: str
    options: dict[str, str] = field(default_factory=dict)
    flags: set[str] = field(default_factory=set)
    threads: int = 1

    def params(self) -> SketchParams:
        o = self.options
        canonical = o.get("canonical", "true").lower()
        if canonical not in TRUE | FALSE:
            raise UsageError(f"--canonical: {canonical}")
        try:
            return SketchParams(
                sketch_bits=_whole(o, "sketch-size", 8192), k=_whole(o, "kmer", 64), canonical=canonical in TRUE, j0=_number(o, "j0", 0.75),
                mode=o.get("pos-mode", "value"), seed=_whole(o, "hash-seed", 0), oph_buckets=_whole(o, "oph-buckets", 0),
            )
        except ValueError as e:
            raise UsageError(str(e)) from e


def _leading(pattern: str, o: dict[str, str], name: str, default):
    """A number at the start of the value; what follows it is ignored."""
    if name not in o:
        return default
    m = re.match(pattern, o[name])
    if not m:
        raise UsageError(f"--{name}: {o[name]}")
    return type(default)(m[0])


def _whole(o, name, default):
    return _leading(r"\s*\+?\d+", o, name, default)


def _number(o, name, default):
    return _leading(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", o, name, default)


def parse(argv: list[str]) -> Request:
    if not argv:
        return Request("")
    out, rest = Request(argv[0]), iter(range(1, len(argv)))
    for i in rest:
        if not argv[i].startswith("--"):
            continue
        name, given, value = argv[i][2:].partition("=")
        name = ALIASES.get(name, name)
        if name in FLAGS:
            out.flags.add(name)
        elif name in VALUES:
            if not given and i + 1 < len(argv) and not argv[i + 1].startswith("--"):
                value = argv[next(rest)]
            if not value:
                raise UsageError(f"--{name} requires a value")
            out.options[name] = value
        else:
            raise UsageError(f"unknown option: --{name}")
    out.threads = _whole(out.options, "threads", 1)
    if out.threads < 1:
        raise UsageError("--threads must be positive")
    return out


def check(r: Request) -> None:
    """Which options go together."""
    o, has = r.options, r.options.__contains__
    writes = has("out-dir") or has("sketch-paths-out") or "skip-existing" in r.flags
    both = has("qlist") or "bipartite" in r.flags
    shapes = [has("pairlist"), both, "all-to-all" in r.flags]
    rules = [
        (r.mode != "eval" and _whole(o, "hash-seed", 0) != 0, "a hash seed is for eval only"),
        (r.mode != "eval" and _whole(o, "oph-buckets", 0) != 0, "--oph-buckets is for eval only"),
        (has("qlist") != has("dblist"), "--qlist and --dblist go together"),
        (r.mode == "dist" and sum(shapes) > 1, "choose one of --all-to-all, --bipartite, --pairlist"),
        (r.mode == "eval" and not has("pairlist"), "eval requires --pairlist"),
        (r.mode == "eval" and (both or "all-to-all" in r.flags), "eval supports --pairlist only"),
        (r.mode == "eval" and (writes or has("input-paths")), "eval writes no sketches"),
        (r.mode == "dist" and (writes or has("input-paths")), "dist takes no sketch outputs or inputs"),
        ("bipartite" in r.flags and not has("qlist"), "--bipartite requires --qlist and --dblist"),
    ]
    for broken, said in rules:
        if broken:
            raise UsageError(said)


def _segments(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(id, segments) of the distinct paths (idx, path); files without bases have none."""
    files = sequences.file_contents(spark, paths.dropDuplicates(["path"]))
    runs = sequences.read_segments(files).groupBy("path").agg(F.collect_list("seq").alias("segments"))
    return files.select("path").join(runs, "path", "left").select(F.col("path").alias("id"), F.coalesce("segments", F.array().cast("array<string>")).alias("segments"))


def run_sketch(spark: SparkSession, r: Request, paths: list[str]) -> list[str]:
    """Writes the sketches; with --skip-existing only those that are missing, damaged or of other parameters."""
    p = r.params()
    inputs = spark.createDataFrame(list(enumerate(paths)), "idx long, path string")
    named = sketch_files.reject_duplicates(inputs.withColumn("output", sketch_path(F.col("path"), r.options.get("out-dir", ""))))
    outputs = [x.output for x in named.orderBy("idx").collect()]  # the list of files, given on the driver
    todo = named
    if "skip-existing" in r.flags:
        folders = sorted({str(Path(x).parent) for x in outputs})
        todo = sketch_files.pending(named, [x for x in folders if Path(x).exists()], p.sketch_bits, p.buckets, p.j0)
    if todo.limit(1).count():
        made = sketch.sketch_sequences(_segments(spark, todo.select("idx", "path")), p)
        rows = made.join(todo.select(F.col("path").alias("id"), F.col("output").alias("path")), "id")
        sketch_files.write_files(rows.select("path", "words", F.lit(p.sketch_bits).cast("long").alias("nbits"), F.col("num_buckets").cast("long").alias("kbuckets"), F.lit(p.j0).alias("j0")))
    if "sketch-paths-out" in r.options:
        tables.write_list(r.options["sketch-paths-out"], outputs)
    return outputs


def _load(spark: SparkSession, paths: DataFrame | list[str]) -> DataFrame:
    """(idx, path, words, kbuckets) by list position, repetitions included."""
    files = sequences.file_contents(spark, paths)
    once = sketch_files.read_sketches(files.dropDuplicates(["path"])).select("path", "words", "kbuckets")
    return files.select("idx", "path").join(once, "path").select("idx", "path", "words", "kbuckets")


def run_dist(spark: SparkSession, r: Request, stdin: list[str]) -> DataFrame:
    p, o = r.params(), r.options
    read = lambda f: tables.path_list(tables._read_text(f).split("\n"))
    if "pairlist" in o:
        pairs = lists.read_pairs(spark, o["pairlist"])
        got = dist.pair_list(pairs, _load(spark, lists.sides(pairs)), p).orderBy("pair_idx")
        return dist.format_dist(got.select(F.col("left").alias("path1"), F.col("right").alias("path2"), "jaccard", "pair_idx"))
    if "qlist" in o:
        return dist.format_dist(dist.bipartite(_load(spark, read(o["qlist"])), _load(spark, read(o["dblist"])), p))
    return dist.format_dist(dist.all_to_all(_load(spark, tables.path_list(stdin)), p))


def run_eval(spark: SparkSession, r: Request) -> DataFrame:
    pairs = lists.read_pairs(spark, r.options["pairlist"])
    return dist.evaluate_pairs(pairs, _segments(spark, lists.sides(pairs)), r.params()).orderBy("pair_idx").drop("pair_idx")


def main(argv: list[str] | None = None, stdin=None, out=None) -> int:
    argv, stdin, out = sys.argv[1:] if argv is None else argv, stdin or sys.stdin, out or sys.stdout
    if argv and argv[0] in ("--help", "-h"):
        print(USAGE, file=out)
        return 0
    try:
        r = parse(argv)
        if r.mode not in ("sketch", "dist", "eval"):
            print(USAGE, file=out)
            return 1
        check(r)
        r.params()
    except UsageError as e:
        print(f"usage error: {e}", file=sys.stderr)
        return 1
    spark = session("kmerloom")
    try:
        if r.mode == "sketch":
            source = tables._read_text(r.options["input-paths"]).split("\n") if "input-paths" in r.options else list(stdin)
            for name in run_sketch(spark, r, tables.path_list(source)):
                print(name, file=out)
            return 0
        rows = run_eval(spark, r) if r.mode == "eval" else run_dist(spark, r, [] if r.options.keys() & {"pairlist", "qlist"} else list(stdin))
        if r.mode == "eval":
            print(*rows.columns, sep="\t", file=out)
        for row in rows.toLocalIterator():  # printing is the driver's; tables stay on the cluster
            print(*(format(v, ".17g") if isinstance(v, float) else v for v in row), sep="\t", file=out)
        return 0
    except Exception as e:  # the command line reports, whatever failed
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
