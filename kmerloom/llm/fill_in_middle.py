"""Fill-in-the-middle transformation of texts.

Arrow batches of texts go through one pandas UDF: the regex library's finditer collects
the end offset of every unit in a compact array, two lookups in it give the places of the two
cuts, and hashlib gives the seed of a document and the digests of what comes out.  Everything
that decides a row depends on its id and its text alone, so the work is map-only: no shuffle, no
state, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: A unit: white space with the word after it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")
TYPES = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str, unit) -> array:
    """End offsets (code points) of the units of ``text``, eight bytes each."""
    return array("q", (m.end() for m in unit.finditer(text)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def seeds(doc_id: str | None, seed: int) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``; a null id is the text null."""
    digits = digest(f"{seed}:{'null' if doc_id is None else doc_id}")
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def transform(doc_id: str | None, text: str, unit, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, characters of the middle, output) of one text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = seeds(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (ends[k - 1] if k else 0 for k in (first, second))
    if h4 % 100 < spm_rate:
        return n, "spm", i, j - i, f"{SUFFIX}{text[j:]}{PREFIX}{text[:i]}{MIDDLE}{text[i:j]}"
    return n, "psm", i, j - i, f"{PREFIX}{text[:i]}{SUFFIX}{text[j:]}{MIDDLE}{text[i:j]}"


def restore(output: str, form: str) -> str:
    """The text that ``transform`` made ``output`` of.  The marks occur once each, since texts that
    hold one stay plain."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "spm":
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    else:
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row per input row: its id, n (units), form (plain, psm, spm), prefix_chars and
    middle_chars (code points, null if plain), output, and the SHA-256 digests (lowercase hex,
    UTF-8) of the output and of the text restored from output and form.

    ``rate`` percent of the texts are cut, and of these ``spm_rate`` percent get the suffix first.
    A null text counts as empty; empty texts and those that hold a mark stay plain, and a text of
    white space is one unit.  Equal ids get equal seeds, so repeated rows equal results; a null
    id is seeded as the word null.  A very long text costs eight bytes a unit besides itself and
    its output.  An empty table gives no rows; other columns are dropped, whatever their names.
    """

    @F.pandas_udf(TYPES)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        import regex

        unit = regex.compile(UNIT)
        rows = []
        for i, t in zip(ids, texts):
            n, form, prefix, middle, output = transform(i, t, unit, seed, rate, spm_rate)
            rows.append((n, form, prefix, middle, output, digest(output), digest(restore(output, form))))
        return pd.DataFrame(rows, columns=COLUMNS).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = cut(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), made.alias("made")).select(id_col, "made.*")
