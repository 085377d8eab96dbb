"""Sequence expressions, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A total, deterministic map from any text to ACGT: two bases for each UTF-8 byte.
HEX, BASES = "0123456789ABCDEF", "ACGTACGTACGTACGT"


def translate_text(text: Column) -> Column:
    return F.translate(F.hex(F.coalesce(text, F.lit("")).cast("binary")), HEX, BASES)


def revcomp(seq: Column) -> Column:
    """Reverse complement in upper case; every character outside ACGTacgt becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCATGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def kmer_count(length: Column, k: int) -> Column:
    return F.greatest(length - k + 1, F.lit(0)) if k > 0 else F.lit(0)


def kmers(seq: Column, k: int) -> Column:
    """All windows of k characters; none if the sequence is shorter, or k is 0."""
    if k <= 0:
        return F.array().cast("array<string>")
    at = F.sequence(F.lit(1), F.length(seq) - k + 1)
    # Substrings of a long string cost its length each, those of bytes or arrays do not.  The
    # outer transform binds the converted sequence once.
    ascii_ = F.transform(F.array(seq.cast("binary")), lambda b: F.transform(at, lambda i: F.substr(b, i, F.lit(k)).cast("string")))[0]
    chars = F.transform(F.array(F.split(seq, "")), lambda c: F.transform(at, lambda i: F.array_join(F.slice(c, i, k), "")))[0]
    windows = F.when(F.length(seq) == F.octet_length(seq), ascii_).otherwise(chars)
    return F.when(F.length(seq) >= k, windows).otherwise(F.array().cast("array<string>"))


def canonical_kmers(seq: Column, k: int) -> Column:
    """Canonical form of every window: the reverse complement is made once for the sequence,
    and window i meets the mirrored window of it."""
    if k <= 0:
        return F.array().cast("array<string>")
    n = F.length(seq)
    at = F.sequence(F.lit(1), n - k + 1)
    last = (n - k + 2).alias("last")
    both = F.array(F.struct(seq.cast("binary").alias("f"), revcomp(seq).cast("binary").alias("r"), last))
    ascii_ = F.transform(both, lambda b: F.transform(at, lambda i: F.least(F.substr(b.f, i, F.lit(k)), F.substr(b.r, b.last - i, F.lit(k))).cast("string")))[0]
    lists = F.array(F.struct(F.split(seq, "").alias("f"), F.split(revcomp(seq), "").alias("r"), last))
    part = lambda c, i: F.array_join(F.slice(c, i, k), "")
    chars = F.transform(lists, lambda b: F.transform(at, lambda i: F.least(part(b.f, i), part(b.r, b.last - i))))[0]
    return F.when(n < k, F.array().cast("array<string>")).when(n == F.octet_length(seq), ascii_).otherwise(chars)


def segments(text: Column) -> Column:
    """Maximal ACGT runs after removal of white space, in upper case."""
    return F.regexp_extract_all(F.upper(F.regexp_replace(text, r"[\x09-\x0D\x20]", "")), F.lit("[ACGT]+"), F.lit(0))


def is_acgt(kmer: Column) -> Column:
    return kmer.rlike("^[ACGTacgt]+$")


def wrap_fasta(header: Column, seq: Column, width: int = 80) -> Column:
    """One FASTA record with lines of ``width`` bases."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), header, F.lit("\n"), F.when(F.length(seq) > 0, F.concat(body, F.lit("\n"))).otherwise(F.lit("")))
