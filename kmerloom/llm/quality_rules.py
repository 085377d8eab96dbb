"""Quality rules as weak supervision (DataFrame functions only).

Rules over counts of a document vote good (1), bad (-1) or abstain (0).  The label is
hidden; expectation-maximisation over the *counts of vote patterns* estimates the share of
good documents and each rule's accuracy, and a document is kept when its posterior
probability of being good reaches the threshold.  No labels are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, WORD, materialize

NO_SYMBOL = "[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """``value`` is a SQL expression over the counts; it votes good up to ``good`` and bad above
    ``bad`` (for ``rising`` rules: good from ``good`` on, bad below ``bad``); else it abstains."""

    name: str
    value: str
    good: float
    bad: float
    rising: bool = False

    def vote_sql(self) -> str:
        good, bad = (">=", "<") if self.rising else ("<=", ">")
        return f"CASE WHEN {self.value} {good} {self.good!r} THEN 1 WHEN {self.value} {bad} {self.bad!r} THEN -1 ELSE 0 END"


#: Ratios are compared as ``a / n``; n_words is at least 1 in them.
PER_WORD = "CAST(greatest(n_words, 1) AS DOUBLE)"
PER_CHAR = "CAST(greatest(word_chars, 1) AS DOUBLE)"
#: Several rules look at each kind of junk from different sides, so that their bad votes
#: coincide on junk and the hidden label can be told from chance.
RULES = (
    Rule("symbols_per_word", f"n_symbols / {PER_WORD}", 0.05, 0.15),
    Rule("symbols_per_char", f"n_symbols / {PER_CHAR}", 0.01, 0.03),
    Rule("letters", f"n_letters / {PER_CHAR}", 0.93, 0.88, True),
    Rule("lower_case", f"n_lower / {PER_CHAR}", 0.85, 0.78, True),
    Rule("capitals", f"n_capitals / {PER_CHAR}", 0.12, 0.3),
    Rule("shouts", f"n_shouts / {PER_WORD}", 0.1, 0.3),
    Rule("repeats", f"n_repeat_words / {PER_WORD}", 0.15, 0.4),
    Rule("distinct", f"n_distinct / {PER_WORD}", 0.25, 0.15, True),
    Rule("lines", "n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE)", 0.1, 0.35),
    Rule("long_words", f"word_chars / {PER_WORD}", 9.0, 12.0),
    Rule("short_words", f"word_chars / {PER_WORD}", 3.0, 2.5, True),
)
#: The start of the iteration: share of good documents, and how often a rule that votes is
#: right on good and on bad documents; bounds keep every likelihood ratio finite.
ROUNDS, START_GOOD, START_TRUE_GOOD, START_TRUE_BAD, FLOOR, CEILING, KEEP = 25, 0.85, 0.99, 0.5, 0.02, 0.999, 0.5


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts that
    only the rules read (n_lines, n_letters, n_lower, n_capitals, n_shouts, n_distinct).  A null text counts as empty.

    Three-word windows compare as strings (words hold no blanks).  Texts without a repeated
    window end at the distinct count; the rest sort (window, place) once, keep the places with
    an equal neighbour and add up the words covered in order of place."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    step = text.select(
        "doc_id",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", NO_SYMBOL, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("t", r"[^\p{Ll}]+", "")).cast("long").alias("n_lower"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("t", "[^!]+", "")).cast("long").alias("n_shouts"),
        F.filter(F.split("t", "\n", -1), lambda l: l.rlike(WORD)).alias("lines"),
    )
    step = step.select(
        "doc_id", "words", "word_chars", "n_symbols", "n_letters", "n_lower", "n_capitals", "n_shouts",
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= 3,
            F.expr("transform(sequence(0, size(words) - 3), i -> concat_ws(' ', words[i], words[i + 1], words[i + 2]))"),
        ).alias("windows"),
    ).drop("words")
    # places whose window repeats, in order; null where all windows differ
    step = step.withColumn(
        "places",
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ),
    ).drop("windows")
    step = step.withColumn(
        "places",
        F.expr("array_sort(transform(filter(places, (p, k) -> (k > 0 AND places[k - 1].w = p.w) OR (k < size(places) - 1 AND places[k + 1].w = p.w)), p -> p.i))"),
    )
    covered = F.expr("aggregate(places, named_struct('at', -3, 'n', 0L), (s, p) -> named_struct('at', p, 'n', s.n + least(3, p - s.at)), s -> s.n)")
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")


@dataclass(frozen=True)
class Model:
    """Share of good documents; accuracy of each rule on good and on bad documents."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def posterior(m: Model) -> Column:
    """Probability of good given the votes v0, v1, ...; an abstention says nothing."""
    odds = F.lit(m.good / (1 - m.good))
    for j, (a, b) in enumerate(zip(m.on_good, m.on_bad)):
        odds = odds * F.when(F.col(f"v{j}") == 1, F.lit(a / (1 - b))).when(F.col(f"v{j}") == -1, F.lit((1 - a) / b)).otherwise(F.lit(1.0))
    return odds / (odds + 1.0)


def fit_em(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> Model:
    """Fit the model to vote patterns (v0..vR-1, n).

    At most 3 ** R patterns exist, however many documents: they are aggregated on the cluster
    and each round sums them up there; the driver sees one row of sums.
    """
    m = Model(START_GOOD, (START_TRUE_GOOD,) * n_rules, (START_TRUE_BAD,) * n_rules)
    for _ in range(rounds):
        yes, no = F.col("n") * F.col("q"), F.col("n") * (1 - F.col("q"))
        sums = [F.sum(yes), F.sum("n")]
        for j in range(n_rules):
            v = F.col(f"v{j}")
            sums += [F.sum(F.when(c, x).otherwise(0.0)) for c, x in ((v == 1, yes), (v != 0, yes), (v == -1, no), (v != 0, no))]
        s = patterns.withColumn("q", posterior(m)).agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)]).first()
        if not s[1]:
            break
        share = lambda x, y, start: min(CEILING, max(FLOOR, x / y)) if y else start
        m = Model(
            min(0.99, max(0.01, s[0] / s[1])),
            tuple(share(s[2 + 4 * j], s[3 + 4 * j], START_TRUE_GOOD) for j in range(n_rules)),
            tuple(share(s[4 + 4 * j], s[5 + 4 * j], START_TRUE_BAD) for j in range(n_rules)),
        )
    return m


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: float = KEEP) -> DataFrame:
    """One row per input row: id, counts, base_failed, posterior, kept.

    The base (fewer than 50 words, or more than half of the words in repeated windows) always
    fails.  Null and empty texts have no words and so fail.  Repeated rows, null ids and
    extra columns change nothing; an empty table gives no rows.
    """
    got = counts(docs, id_col, text_col)
    voted = materialize(got.select("*", *[F.expr(r.vote_sql()).alias(f"v{j}") for j, r in enumerate(rules)]), "quality-votes")
    votes = [f"v{j}" for j in range(len(rules))]
    patterns = materialize(voted.groupBy(*votes).agg(F.count("*").alias("n")).coalesce(1), "quality-patterns")
    model = fit_em(patterns, len(rules))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return voted.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), posterior(model).alias("posterior"),
        (~base & (posterior(model) >= keep)).alias("kept"),
    )
