"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality_rules import CEILING, FLOOR, KEEP, ROUNDS, RULES, START_GOOD, START_TRUE_BAD, START_TRUE_GOOD

W = r"[^\x20\x09-\x0D]+"
S = r"[\x20\x09-\x0D]+"


def mixing(seed: int = 7) -> str:
    return rf"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{W}')), 0)::BIGINT AS size,
         coalesce('=' || source, '-') AS key FROM documents),
totals AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY key),
weighed AS (SELECT *, list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER)::BIGINT AS weight FROM totals),
ratios AS (SELECT *, source_size * 2.0::DOUBLE AS ceiling, source_size * 2.0::DOUBLE / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(ceiling) OVER f, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM ratios WINDOW f AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT arg_min(level, (ratio, source IS NULL, coalesce(source, ''))) FILTER (level <= ratio) AS cut FROM levels),
targets AS (
  SELECT key, source_size, CASE WHEN cut IS NULL OR ratio < cut THEN ceiling ELSE cut * weight END AS target FROM levels, cut),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY r.key ORDER BY r.size, coalesce(('0x' || substr(md5(r.doc_id::VARCHAR), 1, 3))::BIGINT, -1), r.doc_id NULLS FIRST) AS place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('{seed}:' || r.key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
  FROM rows_ r JOIN targets t USING (key))
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((floor(place * rate + off) - floor((place - 1) * rate + off))::BIGINT * size)::BIGINT AS taken
FROM placed"""


EXACT = rf"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '{S}', '', 'g') AS norm FROM documents),
r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM r"""


def quality() -> str:
    votes = ", ".join(f"{r.vote_sql()} AS v{j}" for j, r in enumerate(RULES))
    names = ", ".join(f"v{j}" for j in range(len(RULES)))
    every = range(len(RULES))
    odds = lambda m: f"({m}.pi / (1 - {m}.pi))" + "".join(
        f" * CASE v{j} WHEN 1 THEN {m}.a{j} / (1 - {m}.b{j}) WHEN -1 THEN (1 - {m}.a{j}) / {m}.b{j} ELSE 1.0::DOUBLE END" for j in every
    )
    post = lambda m: f"(({odds(m)}) / (({odds(m)}) + 1.0::DOUBLE))"
    share = lambda x, j, vote, start: (
        f"coalesce(least({CEILING}::DOUBLE, greatest({FLOOR}::DOUBLE, sum(CASE v{j} WHEN {vote} THEN {x} ELSE 0.0 END) / nullif(sum(CASE WHEN v{j} <> 0 THEN {x} ELSE 0.0 END), 0))), {start}::DOUBLE)"
    )
    rounds = [f"m0 AS MATERIALIZED (SELECT {START_GOOD}::DOUBLE AS pi, " + ", ".join(f"{START_TRUE_GOOD}::DOUBLE AS a{j}, {START_TRUE_BAD}::DOUBLE AS b{j}" for j in every) + ")"]
    for i in range(ROUNDS):
        acc = ", ".join(f"{share('n * q', j, 1, START_TRUE_GOOD)} AS a{j}, {share('n * (1 - q)', j, -1, START_TRUE_BAD)} AS b{j}" for j in every)
        rounds.append(f"m{i + 1} AS MATERIALIZED (SELECT least(0.99::DOUBLE, greatest(0.01::DOUBLE, sum(n * q) / sum(n)::DOUBLE)) AS pi, {acc} FROM (SELECT p.*, {post(f'm{i}')} AS q FROM patterns p, m{i}))")
    last = f"m{ROUNDS}"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '{W}') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{W}')) AS lines FROM t),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
rep AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c >= 2) GROUP BY doc_id),
c AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{S}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g'))::BIGINT AS n_lower,
         len(list_distinct(words))::BIGINT AS n_distinct, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_shouts,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
v AS MATERIALIZED (SELECT *, {votes} FROM c),
patterns AS MATERIALIZED (SELECT {names}, count(*) AS n FROM v GROUP BY ALL),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed,
       NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND {post(last)} >= {KEEP} AS kept
FROM v, {last}"""


MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (
  SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, array_to_string(units[1:i], '') AS p, array_to_string(units[i + 1:j], '') AS m, array_to_string(units[j + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c"""

#: Links are counted from the sets of shingles themselves; equal sets stand for one another.
OVERLAP = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS grams FROM w),
d AS MATERIALIZED (SELECT doc_id, len(grams)::BIGINT AS n, md5(array_to_string(list_sort(grams), chr(10))) AS digest, grams FROM g),
e AS MATERIALIZED (SELECT digest, min(doc_id) AS id, min(n) AS n FROM d WHERE n > 0 GROUP BY digest),
x AS MATERIALIZED (SELECT id, n, hash(gram) AS gram FROM (SELECT e.id, e.n, unnest(d.grams) AS gram FROM e JOIN d ON d.doc_id = e.id)),
l AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
sides AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON s.a = r.b),
c AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles, coalesce(c.component_id, e.id, d.doc_id) AS component_id
FROM d LEFT JOIN e ON e.digest = d.digest AND d.n > 0 LEFT JOIN c ON c.id = e.id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing(), "op4_exact_dedup": EXACT, "op9_quality_rules": quality(), "op11_part_enum": OVERLAP, "op12_fill_in_middle": MIDDLE}
