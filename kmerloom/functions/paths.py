"""Path and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: str) -> str:
    """The folder of a path on the driver's side of a call."""
    return path.rstrip("/").rpartition("/")[0]


def absolute(path: Column, base: str = "", home: str = "") -> Column:
    """A path from ``base`` if it is relative, ~ replaced by ``home``, without empty, . and .. parts.
    Schemes (``hdfs://host``) stay; links are not followed."""
    at = F.when((path == "~") | path.startswith("~/"), F.concat(F.lit(home), F.substring(path, 2, 1 << 30))) if home else F.lit(None)
    full = F.coalesce(at, F.when(path.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?/"), path).otherwise(F.concat(F.lit(base + "/" if base else ""), path)))
    scheme = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", 0)
    rest = F.expr("array()").cast("array<string>")
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    parts = F.aggregate(F.split(F.substr(full, F.length(scheme) + 1), "/"), rest, step)
    return F.concat(scheme, F.lit("/"), F.array_join(parts, "/"))


def without_gz(name: Column) -> Column:
    return F.regexp_replace(name, r"\.gz$", "")


def is_gzip(path: Column) -> Column:
    return path.endswith(".gz")


def safe_name(name: Column) -> Column:
    """Letters and digits of any script, dot, dash and underscore stay; others become _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def sketch_path(path: Column, out_dir: str = "") -> Column:
    """Beside the input, or in ``out_dir`` under its name less ``.gz``."""
    if not out_dir:
        return F.concat(path, F.lit(".sketch"))
    return F.concat(F.lit(out_dir.rstrip("/") + "/"), without_gz(basename(path)), F.lit(".sketch"))


def genomic_url(ftp_path: Column) -> Column:
    """The genome's address: ``<path>/<last part>_genomic.fna.gz`` over https."""
    path = F.regexp_replace(F.rtrim(ftp_path, F.lit("/")), "^ftp://", "https://")
    return F.concat(path, F.lit("/"), basename(path), F.lit("_genomic.fna.gz"))
