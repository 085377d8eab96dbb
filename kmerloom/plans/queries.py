"""Queries over the test tables, one or more for each operator.

Texts become sequences by `translate_text` (two bases for each byte).  Pairwise results use
the table of passages (benchmark), whose size the result is the square of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import paths, sequences as sq, u64
from ..operators import checks, dist, estimate, kmers, manifest, metrics, simulate, sketch
from ..params import SketchParams
from ..session import scratch, spread
from ..sources import kmer_index, lists, ordered, scan, sequences as files, sketch_files, tables
from ..streaming.registers import streaming_minima
from . import experiment

K = 21
#: A small sketch whose registers SQL can follow, and the same with other positions or seeds.
SMALL = SketchParams(128, K, True, 0.5, "value")
MIX = SketchParams(128, K, True, 0.5, "mix")
STRIPE = SketchParams(256, K, True, 0.9, "stripe", oph_buckets=64)
SEEDED = SketchParams(128, K, True, 0.5, "value", seed=12345)
WIDE = SketchParams(8192, K, True, 0.9, "mix")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _seqs(spark: SparkSession, d: str, table: str = "benchmark") -> DataFrame:
    key = {"benchmark": "item_id", "documents": "doc_id", "pages": "page_id"}[table]
    text = "html" if table == "pages" else "text"
    return spread(_table(spark, d, table)).select(F.col(key).alias("id"), sq.translate_text(F.col(text)).alias("seq"))


def _segments(spark: SparkSession, d: str, table: str = "benchmark") -> DataFrame:
    return _seqs(spark, d, table).select("id", F.array("seq").alias("segments"))


def _neighbours(ids: DataFrame) -> DataFrame:
    """A pair list: every id with the next one."""
    nxt = F.lead("id").over(Window.orderBy("id"))
    return ids.select("id", nxt.alias("right")).filter("right IS NOT NULL").select(F.col("id").alias("pair_idx"), F.col("id").alias("left"), "right")


# -- sequences and k-mers --


def seq_translate(spark, d):
    return _seqs(spark, d, "documents")


def acgt_segments(spark, d):
    runs = sq.segments(F.col("text"))
    rows = _table(spark, d, "documents").select("doc_id", runs.alias("r"))
    return rows.select("doc_id", F.size("r").cast("long").alias("n_segments"), F.length(F.array_join("r", "")).cast("long").alias("bases"))


def kmer_explode(spark, d):
    return kmers.explode_kmers(_seqs(spark, d), K).select("id", F.col("pos").cast("long").alias("pos"), "kmer")


def kmer_revcomp(spark, d):
    return _seqs(spark, d, "documents").select("id", sq.revcomp(F.col("seq")).alias("rc"))


def kmer_canonical(spark, d):
    return kmers.count_kmers(_seqs(spark, d, "documents"), 5)


def kmer_distinct_count(spark, d):
    """Documents have one row each, so their sets are counted in the row."""
    rows = _seqs(spark, d, "documents").select(F.struct("id", sq.kmer_count(F.length("seq"), K).cast("long").alias("n_windows")).alias("row"), "seq")
    return kmers.whole_set_sizes(rows, K, "row").select("row.id", "row.n_windows", F.col("n").alias("n_distinct"))


def kmer_set_sizes(spark, d):
    """The same sizes from sets that are merged over rows."""
    return kmers.set_sizes(kmers.packed_sets(_seqs(spark, d), K))


def kmer_packed(spark, d):
    """Two bits a base in one LONG."""
    return kmers.packed_sets(_seqs(spark, d), K)


def kmer_packed_wide(spark, d):
    """The same of 40 bases, in two."""
    return kmers.packed_sets(_seqs(spark, d), 40).select("id", "kmer.hi", "kmer.lo")


def kmer_packed_text(spark, d):
    """Sets of texts as they are: windows with another character than ACGT of either case go."""
    raw = spread(_table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))
    return kmers.packed_sets(raw, 2, whole=True)


def kmer_non_acgt_filter(spark, d):
    raw = spread(_table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.upper(F.col("text")).alias("seq"))
    return kmers.count_kmers(raw, 4, distinct=True)


def exact_jaccard_all_pairs(spark, d):
    return kmers.jaccard_all_pairs(kmers.packed_sets(_seqs(spark, d), K, whole=True)).withColumn("jaccard", F.round("jaccard", 12))


def exact_jaccard_bipartite(spark, d):
    q = kmers.packed_sets(_seqs(spark, d), 31, whole=True)
    db = kmers.packed_sets(_seqs(spark, d, "documents"), 31, whole=True, sizes=True, among=kmers.few_kmers(q))
    return kmers.jaccard_bipartite(q, db).withColumn("jaccard", F.round("jaccard", 12))


def exact_jaccard_pairlist(spark, d):
    s = _seqs(spark, d)
    return kmers.jaccard_pairs(_neighbours(s.select("id")), kmers.packed_sets(s, 11, whole=True)).withColumn("jaccard", F.round("jaccard", 12))


def exact_nearest_neighbor(spark, d):
    s = kmers.packed_sets(_seqs(spark, d), K, whole=True)
    return kmers.nearest(kmers.jaccard_bipartite(s, s, exclude=F.col("query") == F.col("db"))).withColumn("jaccard", F.round("jaccard", 12))


def basename_exclusion_join(spark, d):
    """Passages stand for files; two have one base name when their ids agree mod 10."""
    s = kmers.packed_sets(_seqs(spark, d), K, whole=True)
    return kmers.jaccard_bipartite(s, s, exclude=F.col("query") % 10 == F.col("db") % 10).withColumn("jaccard", F.round("jaccard", 12))


def truth_columns(spark, d):
    s = _seqs(spark, d)
    info = _neighbours(s.select("id")).select(
        F.col("pair_idx").alias("pair_id"), F.col("left").alias("file1"), F.col("right").alias("file2"), (F.col("left") % 7).alias("mutation_count"), (F.col("left") % 5 * 100).alias("genome_length")
    )
    got = kmers.truth_rows(info, kmers.kmer_sets(s, 11))
    return got.withColumn("jaccard_true", F.round("jaccard_true", 12)).withColumn("mutation_rate", F.round("mutation_rate", 12))


def kmer_index_append(spark, d):
    """Sizes and batches of an index of passages: odd ids first, then all of them."""
    s = _seqs(spark, d)
    index = kmer_index.create_index(spark, scratch(spark, "kmer-index"), 40, 8)
    kmer_index.append(index, s.filter("id % 2 = 1"), 1)
    kmer_index.append(index, s, 2)
    return index.sizes


def kmer_index_probe(spark, d):
    """Passages against a stored index of all documents."""
    path = scratch(spark, "kmer-index")
    kmer_index.append(kmer_index.create_index(spark, path, 31, 16), _seqs(spark, d, "documents"), 1)
    found = kmer_index.probe(kmer_index.open_index(spark, path), kmers.packed_sets(_seqs(spark, d), 31, whole=True))
    return found.withColumn("jaccard", F.round("jaccard", 12))


def kmer_index_records(spark, d):
    """Number and digest of the records of each passage, read back from them."""
    made = kmer_index.to_records(_seqs(spark, d), 40).withColumn("path", F.col("id").cast("string"))
    back = kmer_index.read_records(made, 40).groupBy("path").agg(F.count("*").alias("n_read"))
    return made.join(back, "path").select("id", "n", "n_read", F.sha2("content", 256).alias("sha256"))


# -- unsigned arithmetic --


def _mixed(spark, d, table, key):
    rows = _table(spark, d, table)
    with u64.wrapping(spark):
        return rows.select("*", u64.mix64(key).alias("h"))


def mix64(spark, d):
    rows = _mixed(spark, d, "lineitem", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", "h")


def rotate_left_right(spark, d):
    h = F.col("h")
    return _mixed(spark, d, "orders", F.col("o_orderkey")).select("o_orderkey", u64.rotl(h, 13).alias("left13"), u64.rotr(h, 13).alias("right13"), u64.rotl(h, 64).alias("left64"))


def unsigned_min(spark, d):
    return _mixed(spark, d, "lineitem", F.col("l_orderkey")).groupBy("l_suppkey").agg(u64.umin(F.col("h")).alias("least"))


def unsigned_mod(spark, d):
    h = F.col("h")
    return _mixed(spark, d, "orders", F.col("o_orderkey")).select("o_orderkey", u64.umod(h, 64).alias("m64"), u64.umod(h, 192).alias("m192"), u64.umod(h, 1000).alias("m1000"))


# -- hashes, registers, sketches --


def _hashes(spark, d):
    return sketch.hash_kmers(kmers.explode_kmers(_seqs(spark, d), K), K)


def nt_hash_kmer(spark, d):
    return _hashes(spark, d).select("id", F.col("pos").cast("long").alias("pos"), "hash")


def oph_bucket_min(spark, d):
    return sketch.bucket_minima(_hashes(spark, d), SMALL)


def oph_nonempty_count(spark, d):
    return sketch.nonempty_counts(sketch.bucket_minima(_hashes(spark, d), SMALL))


def oph_densify(spark, d):
    return sketch.densify_minima(sketch.bucket_minima(_hashes(spark, d), SMALL), SMALL)


def oph_registers_kernel(spark, d):
    rows = sketch.registers_of(_segments(spark, d), SMALL, SMALL.buckets)
    return rows.select("id", F.posexplode("values").alias("bucket", "rank"))


def oph_match_estimate(spark, d):
    r = sketch.registers_of(_segments(spark, d), SMALL, SMALL.buckets)
    pairs = _neighbours(r.select("id"))
    got = pairs.join(r.select(F.col("id").alias("left"), F.col("values").alias("a")), "left").join(r.select(F.col("id").alias("right"), F.col("values").alias("b")), "right")
    est = estimate.oph_estimate(F.col("a"), F.col("b"))
    return got.select("pair_idx", est["mismatches"].alias("mismatches"), F.round(est["jaccard"], 12).alias("jaccard"))


def _positions(spark, d, p, buckets=None):
    values = sketch.densify_minima(sketch.bucket_minima(_hashes(spark, d), p, buckets), p, buckets)
    return sketch.bit_positions(values, p, buckets).select("id", "bucket", "position")


def bit_position_value(spark, d):
    return _positions(spark, d, SMALL)


def bit_position_stripe(spark, d):
    return _positions(spark, d, STRIPE, 64)


def bit_position_mix(spark, d):
    return _positions(spark, d, MIX)


def odd_sketch_words(spark, d):
    """The relational form."""
    return sketch.parity_words(sketch.densify_minima(sketch.bucket_minima(_hashes(spark, d), SMALL), SMALL), SMALL).filter("bits <> 0")


def odd_sketch_kernel(spark, d):
    """The kernel form of the same words."""
    rows = sketch.sketch_sequences(_segments(spark, d), SMALL)
    return rows.select("id", F.posexplode("words").alias("word", "bits")).filter("bits <> 0")


def seeded_sketch(spark, d):
    rows = sketch.sketch_sequences(_segments(spark, d), SEEDED)
    return rows.select("id", F.posexplode("words").alias("word", "bits")).filter("bits <> 0")


def _stored(spark, d, p, table="benchmark"):
    rows = sketch.sketch_sequences(_segments(spark, d, table), p)
    return dist.indexed(rows.select("id", F.col("id").cast("string").alias("path"), "words", F.col("num_buckets").cast("long").alias("kbuckets")), "id")


def _rounded(rows, *cols):
    for c in cols:
        rows = rows.withColumn(c, F.round(c, 9))
    return rows


def hamming_popcount(spark, d):
    return dist.all_to_all(_stored(spark, d, SMALL), SMALL).select("path1", "path2", "hamming")


def odd_estimate(spark, d):
    s = sketch.sketch_sequences(_segments(spark, d), SMALL)
    pairs = _neighbours(s.select("id"))
    got = pairs.join(s.select(F.col("id").alias("left"), F.col("words").alias("a")), "left").join(s.select(F.col("id").alias("right"), F.col("words").alias("b")), "right")
    got = got.select("pair_idx", estimate.words_estimate(F.col("a"), F.col("b"), F.lit(SMALL.buckets)).alias("est"))
    return _rounded(estimate.unpack(got), "raw", "estimate")


def dist_all_to_all(spark, d):
    return _rounded(dist.all_to_all(_stored(spark, d, SMALL), SMALL), "raw", "jaccard").select("path1", "path2", "hamming", "raw", "jaccard", "clipped")


def dist_bipartite(spark, d):
    s = _stored(spark, d, SMALL)
    return _rounded(dist.bipartite(s, s, SMALL), "raw", "jaccard").select("path1", "path2", "hamming", "raw", "jaccard", "clipped")


def dist_pairlist(spark, d):
    s = _stored(spark, d, SMALL)
    pairs = _neighbours(s.select("id")).select("pair_idx", F.col("left").cast("string").alias("left"), F.col("right").cast("string").alias("right"))
    return _rounded(dist.pair_list(pairs, s, SMALL), "jaccard")


def sketch_documents(spark, d):
    """Sketches of whole documents with production parameters: popcount and filled buckets."""
    docs = spread(_table(spark, d, "documents")).select(F.col("doc_id").alias("id"), "text")
    rows = sketch.sketch_sequences(docs, WIDE, segments_col="text", text=True)
    return rows.select("id", "num_buckets", "nonempty", F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w)).alias("ones"))


def _evaluated(spark, d, p):
    s = _segments(spark, d)
    return _rounded(dist.evaluate_pairs(_neighbours(s.select("id")), s, p), "jaccard_odd", "jaccard_oph", "odd_raw_estimate")


def eval_pairlist(spark, d):
    return _evaluated(spark, d, SMALL)


def seeded_eval(spark, d):
    return _evaluated(spark, d, SEEDED)


def bbit_estimate(spark, d):
    r = sketch.registers_of(_segments(spark, d), SMALL, SMALL.buckets)
    pairs = _neighbours(r.select("id"))
    got = pairs.join(r.select(F.col("id").alias("left"), F.col("values").alias("a")), "left").join(r.select(F.col("id").alias("right"), F.col("values").alias("b")), "right")
    return got.select("pair_idx", F.round(estimate.bbit_estimate(F.col("a"), F.col("b"), 4), 12).alias("jaccard"))


# -- accuracy --

EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def observations(spark, d):
    """Observations made of order lines: quantity is truth, discount and tax are errors."""
    true = F.col("l_quantity") / 50
    return _table(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("replicate"), F.col("l_orderkey").alias("pair_id"), F.when(F.col("l_returnflag") == "A", 1024).when(F.col("l_returnflag") == "N", 2048).otherwise(4096).alias("sketch_size"),
        (F.col("l_suppkey") % 3 * 10 + 11).cast("int").alias("kmerlen"), F.lit(0.5).alias("j0"), true.alias("jaccard_true"), (true + F.col("l_discount") - 0.05).alias("jaccard_odd"), (true + F.col("l_tax") - 0.04).alias("jaccard_base"),
        (F.col("l_discount") > 0.09).cast("int").alias("clipped"), (F.col("l_partkey") % 10 / 10).alias("empty_rate"),
    )


def jaccard_binning(spark, d):
    rows = metrics.with_bins(observations(spark, d), EDGES)
    return rows.groupBy("sketch_size", "bin_id", "bin_lo", "bin_hi", "bin_center").agg(F.count("*").alias("n"))


def pooled_rmse(spark, d):
    return _rounded(metrics.pooled_rmse(observations(spark, d), ["sketch_size"]), "rmse1", "rmse2", "rmse_difference", "clip_rate")


def pooled_rmse_bins(spark, d):
    return _rounded(metrics.pooled_rmse(metrics.with_bins(observations(spark, d), EDGES, strict=True), ["sketch_size", "bin_id"]), "rmse1", "rmse2", "rmse_difference", "clip_rate")


def macro_rmse_bias(spark, d):
    return _rounded(metrics.macro_summary(observations(spark, d), ["sketch_size"], "jaccard_odd"), "rmse", "bias", "clip_rate", "empty_rate")


def coverage_fraction_median(spark, d):
    return _rounded(metrics.coverage(observations(spark, d)), "median_true_jaccard", "fraction_j_ge_j0")


def method_pivot(spark, d):
    rows = observations(spark, d)
    parts = [metrics.macro_summary(rows, ["sketch_size"], c).withColumn("method", F.lit(m)) for c, m in (("jaccard_odd", "odd"), ("jaccard_base", "oph"))]
    return _rounded(metrics.method_pivot(parts[0].unionByName(parts[1]), ["sketch_size"], ("odd", "oph")), "odd", "oph", "rmse_difference")


def bootstrap_ci(spark, d):
    return metrics.pooled_with_intervals(observations(spark, d), ["sketch_size"], 2000, 7)


def observation_checks(spark, d):
    """The rules that the observations made of order lines break, with counts."""
    rows = observations(spark, d)
    bad = checks.observation_violations(rows, 7, 1, [1024, 2048, 4096], ["jaccard_true", "jaccard_odd"], ["jaccard_true", "jaccard_odd"])
    return bad.groupBy("rule").agg(F.count("*").alias("n"))


# -- generators, files, manifests, streams --


def _mutated(spark, d, replicate):
    """Every passage with a copy of 1 to 20 mutations, other ones for each replicate."""
    return simulate.mutated_copies(_seqs(spark, d), 1, 20, 2000 + 100_000 * replicate)


def synthetic_pairs(spark, d):
    pairs = _mutated(spark, d, 0)
    sets = kmers.packed_sets(pairs.select(F.col("file1").alias("id"), F.col("seq1").alias("seq")).union(pairs.select("file2", "seq2")), K, whole=True)
    return kmers.truth_rows(pairs.select("pair_id", "file1", "file2", "mutation_count", "genome_length"), sets)


def accuracy_experiment(spark, d):
    """Mutated passages, exact truth and both estimates: one row per replicate, k, size and pair."""
    return experiment.run(spark, experiment.Experiment(replicates=2, ks=(21, 31), sizes=(1024, 4096)), source=lambda r: _mutated(spark, d, r))


def accuracy_macro(spark, d):
    return experiment.analyse(accuracy_experiment(spark, d), experiment.Experiment())["macro"]


def schedule(spark, d):
    """A replicate for each line number of orders."""
    numbers = _table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("replicate")).distinct()
    return simulate.schedule_of(numbers, [21, 31, 64], [2048, 8192, 32768], 2000, 100000, 0)


def pooled_bin_intervals(spark, d):
    """Bins that the data extend at both ends, with intervals of 50 resamples."""
    found = metrics.binned_with_intervals(observations(spark, d), [0.3, 0.6, 0.9], 50, 7)
    return _rounded(found, *[c for c, t in found.dtypes if t == "double"])


def macro_intervals(spark, d):
    found = metrics.macro_with_intervals(observations(spark, d), ["sketch_size"], "jaccard_odd", 50, 7)
    return _rounded(found, *[c for c, t in found.dtypes if t == "double"])


def sketch_binary_roundtrip(spark, d):
    """Sketches as binary files and back; True where nothing changed."""
    rows = sketch.sketch_sequences(_segments(spark, d), SMALL)
    own = rows.select(F.col("id").cast("string").alias("path"), "words", F.lit(SMALL.sketch_bits).cast("long").alias("nbits"), F.col("num_buckets").cast("long").alias("kbuckets"), F.lit(SMALL.j0).alias("j0"))
    back = sketch_files.read_sketches(sketch_files.to_files(own)).select("path", F.struct("words", "nbits", "kbuckets", "j0").alias("b"))
    return own.join(back, "path").select("path", (F.col("b") == F.struct("words", "nbits", "kbuckets", "j0")).alias("same"))


def fasta_parse(spark, d):
    """Conversations as multi-record FASTA: one file each, one record a turn."""
    turns = _table(spark, d, "conversations")
    record = sq.wrap_fasta(F.concat_ws(" ", "role", F.col("turn").cast("string")), sq.translate_text(F.col("text")))
    whole = turns.select("conv_id", F.struct("turn", record.alias("r")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    content = F.array_join(F.transform("x", lambda r: r["r"]), "").cast("binary")
    got = files.read_segments(whole.select(F.col("conv_id").cast("string").alias("path"), content.alias("content")))
    return got.groupBy("path").agg(F.count("*").alias("n_records"), F.sum(F.length("seq")).cast("long").alias("bases"))


def fasta_scan(spark, d):
    """Documents as FASTA files of many records, read block by block: runs and bases of each record."""
    at = scratch(spark, "fasta")
    seq = F.replace(sq.translate_text(F.col("text")), F.lit("TTTT"), F.lit("NNTT"))
    record = sq.wrap_fasta(F.col("doc_id").cast("string"), seq)
    spread(_table(spark, d, "documents")).select(F.regexp_replace(record, "\n$", "").alias("value")).write.text(at)
    pieces = scan.scan(spark, at, K)
    new = F.length("seq") - F.col("carry")
    return pieces.groupBy(F.col("header").alias("id")).agg(F.count_if(F.col("carry") == 0).alias("n_segments"), F.sum(new).cast("long").alias("bases"))


def ordered_output(spark, d):
    """Orders as files of 700 rows in order of status, price and key: first and last key of each, and its rows."""
    rows = _table(spark, d, "orders").select("o_orderstatus", (F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderkey")
    at = scratch(spark, "ordered-output")
    ordered.write_ordered(rows, ["o_orderstatus", "cents", "o_orderkey"], at, 700)
    back = ordered.read_ordered(spark, at, "o_orderstatus string, cents long, o_orderkey long")
    place = F.struct("o_orderstatus", "cents", "o_orderkey")
    return back.groupBy("file").agg(F.count("*").alias("n"), F.min(place).o_orderkey.alias("first_key"), F.max(place).o_orderkey.alias("last_key"))


def assembly_filter_url(spark, d):
    """Customers as an assembly summary of 22 columns."""
    ftp = F.when(F.col("c_nationkey") == 3, "na").when(F.col("c_nationkey") == 4, "").otherwise(F.concat(F.lit("ftp://host/genomes/"), "c_name"))
    empty = [F.lit("")] * 18
    line = F.concat_ws("\t", F.col("c_name"), *empty, ftp, F.lit(""), F.lit(""))
    rows = tables.parse_assembly_lines(_table(spark, d, "customer").select(line.alias("value")))
    return manifest.with_urls(tables.eligible_assemblies(rows, ["Customer#000000001"])).select("assembly_accession", "genomic_fna_url", "local_filename")


def manifest_status_counts(spark, d):
    rows = _table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("long").alias("file_size"))
    return manifest.status_totals(rows)


def duplicate_output_guard(spark, d):
    rows = _table(spark, d, "pages").select(F.col("page_id").alias("idx"), paths.sketch_path(F.regexp_replace("url", r"[?#].*$", ""), "/out").alias("output"))
    return sketch_files.duplicate_outputs(rows)


def path_functions(spark, d):
    url = F.col("url")
    return _table(spark, d, "pages").select("page_id", paths.basename(url).alias("base"), paths.safe_name(url).alias("safe"), paths.without_gz(url).alias("plain"), paths.is_gzip(url).alias("gz"))


def genome_list(spark, d):
    """Pages as a list of genomes with comments, blank lines and relative paths, checked against a listing."""
    at = scratch(spark, "genome-list")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".fna"))
    line = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit(" # "), name)).when(F.col("page_id") % 7 == 0, " \t").when(F.col("page_id") % 2 == 0, F.concat(F.lit(" ./a//../b/"), name)).otherwise(F.concat(F.lit("/data/"), name))
    pages = _table(spark, d, "pages").select("page_id", line.alias("value"))
    pages.repartitionByRange("page_id").sortWithinPartitions("page_id").select("value").write.text(f"{at}/list")
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(f"{at}/b/"), name)).otherwise(F.concat(F.lit("/data/"), name))
    found = lists.read_genome_list(spark, f"{at}/list", _table(spark, d, "pages").select(own.alias("path")))
    return found.select("idx", "name", F.regexp_replace("path", ".*/genome-list-[0-9a-f]+", "").alias("path"))


def download_manifest(spark, d):
    """Events as manifest rows of their users' files, the last one of a file counting; users of odd number ask."""
    at = scratch(spark, "manifest")
    rows = _table(spark, d, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    path = F.concat(F.when(F.col("event_id") % 2 == 0, "g/./").otherwise("x/../g/"), F.col("user_id").cast("string"), F.lit(".gz"))
    rows = rows.select(F.col("event_id").cast("string").alias("assembly_accession"), path.alias("gzip_path"), F.concat(F.lit("u/"), F.col("event_type")).alias("genomic_fna_url"))
    tables.write_tsv(rows, f"{at}/m")
    known = lists.download_manifest(spark, f"{at}/m", "/data")
    asked = _table(spark, d, "events").filter("user_id % 2 = 1").select(F.concat(F.lit("/data/g/"), F.col("user_id").cast("string"), F.lit(".gz")).alias("path")).distinct()
    none = _table(spark, d, "region").select(F.concat(F.lit("/data/"), "r_name").alias("path"))
    return lists.with_manifest(asked.union(none), known)


def missing_pair_check(spark, d):
    docs = _table(spark, d, "documents").select("doc_id")
    return checks.one_sided(docs, _table(spark, d, "labels").select("doc_id"), "doc_id")


def last_row_by_key(spark, d):
    rows = _table(spark, d, "events").select("user_id", "event_id", "event_type")
    return tables.last_by_key(rows, "user_id", "event_id")


def part_set_jaccard(spark, d):
    """Sets other than k-mers: the parts of each supplier."""
    sets = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").cast("string").alias("kmer"))
    return kmers.jaccard_all_pairs(sets, repeated=True).withColumn("jaccard", F.round("jaccard", 12))


def streaming_registers(spark, d):
    """The registers of oph_bucket_min from a stream of the table, one batch for what is there."""
    schema = spark.read.parquet(f"{d}/benchmark.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "benchmark.parquet").parquet(d)
    out = scratch(spark, "stream-registers")
    minima = streaming_minima(stream.select(F.col("item_id").alias("id"), sq.translate_text(F.col("text")).alias("seq")), SMALL)
    run = (
        minima.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    )
    run.awaitTermination()
    return spark.read.parquet(out)


def queries() -> dict:
    found = (
        seq_translate, acgt_segments, kmer_explode, kmer_revcomp, kmer_canonical, kmer_distinct_count, kmer_set_sizes, kmer_packed, kmer_packed_wide, kmer_packed_text, kmer_non_acgt_filter, exact_jaccard_all_pairs,
        exact_jaccard_bipartite, kmer_index_append, kmer_index_probe, kmer_index_records, exact_jaccard_pairlist, exact_nearest_neighbor, basename_exclusion_join, truth_columns, mix64, rotate_left_right, unsigned_min,
        unsigned_mod, nt_hash_kmer, oph_bucket_min, oph_nonempty_count, oph_densify, oph_registers_kernel, oph_match_estimate, bit_position_value,
        bit_position_stripe, bit_position_mix, odd_sketch_words, odd_sketch_kernel, seeded_sketch, hamming_popcount, odd_estimate, dist_all_to_all,
        dist_bipartite, dist_pairlist, sketch_documents, eval_pairlist, seeded_eval, bbit_estimate, jaccard_binning, pooled_rmse, pooled_rmse_bins,
        macro_rmse_bias, coverage_fraction_median, method_pivot, bootstrap_ci, pooled_bin_intervals, macro_intervals, observation_checks, synthetic_pairs, accuracy_experiment, accuracy_macro, schedule, sketch_binary_roundtrip,
        fasta_parse, fasta_scan, ordered_output, assembly_filter_url, manifest_status_counts, duplicate_output_guard, path_functions, genome_list, download_manifest, missing_pair_check, last_row_by_key,
        part_set_jaccard, streaming_registers,
    )
    return {f.__name__: f for f in found}
