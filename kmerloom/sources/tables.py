"""Lists, pair lists and TSV tables with fixed schemas."""

from __future__ import annotations

import gzip
import io
import json
import os
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAIR_INFO = "pair_id int, file1 string, file2 string, mutation_count long, genome_length long"
# Column names of published assembly summaries, in file order.
ASSEMBLY_COLUMNS = (
    "assembly_accession", "bioproject", "biosample", "wgs_master", "refseq_category", "taxid", "species_taxid", "organism_name",
    "infraspecific_name", "isolate", "version_status", "assembly_level", "release_type", "genome_rep", "seq_rel_date", "asm_name",
    "submitter", "gbrs_paired_asm", "paired_asm_comp", "ftp_path", "excluded_from_refseq", "relation_to_type_material",
)


def path_list(lines: list[str]) -> list[str]:
    """Non-empty lines as they are; order and repetitions stay."""
    return [s for s in (x.removesuffix("\n") for x in lines) if s]


def read_path_list(spark: SparkSession, path: str | None = None, stream=None) -> DataFrame:
    """(idx, path) of a list file, or of a stream (standard input) where no path is given."""
    lines = path_list(list(stream or sys.stdin)) if path is None else path_list(_read_text(path).split("\n"))
    return spark.createDataFrame(list(enumerate(lines)), "idx long, path string")


def _read_text(path: str) -> str:
    """A small driver-side file (lists and configurations)."""
    raw = Path(path).read_bytes()
    return (gzip.decompress(raw) if path.endswith(".gz") else raw).decode()


def parse_pairs(text: str) -> list[tuple[int, str, str]]:
    """(pair_idx, left, right); exactly two non-empty columns, blank lines skipped."""
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        if line:
            parts = line.split("\t")
            if len(parts) != 2 or not all(parts):
                raise ValueError(f"pair list line {number}: expected two tab-separated paths")
            out.append((len(out), *parts))
    return out


def pairs_of_lines(lines: DataFrame) -> DataFrame:
    """The same rules for (line_no, value) rows of a distributed table; a bad line fails the query."""
    parts = F.split("value", "\t", -1)
    good = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    checked = lines.filter("value <> ''").withColumn(
        "parts", F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit("pair list line "), F.col("line_no").cast("string"), F.lit(": expected two tab-separated paths"))).cast("array<string>"))
    )
    return checked.select(F.col("line_no").alias("pair_idx"), F.col("parts")[0].alias("left"), F.col("parts")[1].alias("right"))


def read_pair_info(spark: SparkSession, path: str) -> DataFrame:
    """PAIR_INFO rows; the first line is a header, rows of another width are dropped."""
    rows = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).filter(F.size("p") == 5).filter(F.col("p")[0] != "pair_id")
    names = [c.split() for c in PAIR_INFO.split(", ")]
    return rows.select(*[F.expr(f"try_cast(p[{i}] AS {t})").alias(n) for i, (n, t) in enumerate(names)])


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A TSV or gz-TSV file with a header."""
    reader = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in ``order`` wins."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def write_tsv(df: DataFrame, path: str, compress: bool = False) -> None:
    """TSV with a header, committed by the job or not at all."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def write_gzip_text(path: str, text: str) -> None:
    """A small gzip file whose bytes depend on the text alone, replaced in one step."""
    buffer = io.BytesIO()
    with gzip.GzipFile(fileobj=buffer, mode="wb", compresslevel=6, mtime=0) as f:
        f.write(text.encode())
    temporary = f"{path}.tmp"
    Path(temporary).write_bytes(buffer.getvalue())
    os.replace(temporary, path)


def write_list(path: str, values: list[str]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("".join(v + "\n" for v in values))


def write_json(path: str, value) -> None:
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True) + "\n")


def parse_assembly_lines(lines: DataFrame, pad: bool = False) -> DataFrame:
    """The 22 string columns of assembly-summary lines (value); comments and blanks go.  Short
    rows are dropped, or padded with empty strings."""
    n = len(ASSEMBLY_COLUMNS)
    rows = lines.filter("value <> '' AND NOT startswith(value, '#')").select(F.split("value", "\t", -1).alias("p"))
    rows = rows.select(F.concat("p", F.array_repeat(F.lit(""), n)).alias("p")) if pad else rows.filter(F.size("p") >= n)
    return rows.select(*[F.col("p")[i].alias(c) for i, c in enumerate(ASSEMBLY_COLUMNS)])


def assembly_comments(lines: DataFrame) -> DataFrame:
    return lines.filter("startswith(value, '#')")


def eligible_assemblies(rows: DataFrame, excluded: list[str] = (), limit: int | None = None, order: Column | str = "assembly_accession") -> DataFrame:
    """Rows with a download path whose accession is not excluded."""
    kept = rows.filter(~F.coalesce("ftp_path", F.lit("")).isin("", "na") & ~F.col("assembly_accession").isin(list(excluded)))
    return kept if limit is None else kept.orderBy(order).limit(limit)


def parse_number_or_fraction(raw: Column) -> Column:
    """``a/b`` or a decimal number; zero denominators give null."""
    parts = F.split(raw, "/")
    return F.when(raw.contains("/"), F.try_divide(parts[0].cast("double"), parts[1].cast("double"))).otherwise(raw.cast("double"))


def parse_time_report(lines: DataFrame) -> DataFrame:
    """(key, value) of ``key: value`` lines, split at the first ": "."""
    at = F.instr("value", ": ")
    return lines.filter(at > 0).select(F.trim(F.substring_index("value", ": ", 1)).alias("key"), F.trim(F.expr("substr(value, instr(value, ': ') + 2)")).alias("value"))


def find_kmer_length(config: str, section: str | None = None) -> int | None:
    """``kmerlen`` of a JSON configuration: in ``section`` first, then at the top, then anywhere."""
    def search(node):
        if isinstance(node, dict):
            if isinstance(node.get("kmerlen"), int):
                return node["kmerlen"]
            return next((x for v in node.values() if (x := search(v)) is not None), None)
        return None

    tree = json.loads(config)
    found = search(tree.get(section)) if section and isinstance(tree, dict) else None
    return found if found is not None else search(tree)
