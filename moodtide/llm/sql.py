"""SQL twins (DuckDB) of the queries of this package that SQL can express."""

from __future__ import annotations

from . import pivots, rules

_GAP = r"[\x20\x09-\x0D]"

_CONDITIONS = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "digit_heavy": "10 * n_digits > 3 * word_chars",
}
_BITS = " + ".join(f"CASE WHEN {_CONDITIONS[rule]} THEN {rules.bit(rule)} ELSE 0 END" for rule in rules.RULES)

LEDGER = rf"""
texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
parts AS (
  SELECT rid, doc_id, x,
    list_filter(string_split_regex(x, '{_GAP}+'), lambda s: s <> '') AS ws,
    list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM texts
),
spots AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM parts WHERE len(ws) >= 3),
windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM spots),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
covered AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS spot FROM twice) GROUP BY rid),
measured AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(length(regexp_replace(x, '{_GAP}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(x) - length(regexp_replace(x, '[0-9]', '', 'g')) AS BIGINT) AS n_digits,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM parts LEFT JOIN covered USING (rid)
),
ledger AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM measured)"""

QUALITY_LEDGER = f"""WITH {LEDGER}
SELECT *, fail_bits & {rules.mask(rules.BASE)} <> 0 AS base_failed,
  fail_bits & {rules.mask(rules.BASE) | rules.mask(rules.POLICIES[rules.CURRENT])} = 0 AS kept
FROM ledger"""

_CASES = ", ".join(
    f"('{version}', '{rule}', {rules.mask(names)}, {rules.bit(rule)})" for version, names in rules.POLICIES.items() for rule in names
)
QUALITY_ABLATIONS = f"""WITH {LEDGER}
SELECT policy, rule,
  CAST(count(*) FILTER (WHERE fail_bits & b <> 0) AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (WHERE fail_bits & m = b) AS BIGINT) AS n_only,
  CAST(count(*) FILTER (WHERE fail_bits & m = 0) AS BIGINT) AS n_kept,
  CAST(count(*) FILTER (WHERE fail_bits & m & ~b = 0) AS BIGINT) AS n_kept_without
FROM ledger CROSS JOIN (VALUES {_CASES}) AS c(policy, rule, m, b) GROUP BY policy, rule"""

PIVOT_SEARCH = f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({pivots.SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % {pivots.QUERY_STEP} = 0 GROUP BY vec_id) a JOIN v b ON a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {pivots.TOP}"""

FILTER_AUDIT = rf"""WITH RECURSIVE
parts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
    list_filter(string_split_regex(coalesce(text, ''), '{_GAP}+'), lambda s: s <> '') AS ws
  FROM documents
),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT x, min(doc_id) AS first FROM parts GROUP BY x),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 3 * length(x) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(p.doc_id > first, false) THEN 'E' ELSE '' END AS mask
  FROM parts p JOIN least USING (x) LEFT JOIN marks USING (doc_id)
),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM fails GROUP BY part, mask
),
orders AS (
  SELECT '' AS o
  UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(f) WHERE NOT contains(o, f)
),
places AS (SELECT o, CAST(i AS INTEGER) AS step, o[i] AS f, left(o, i - 1) AS earlier FROM orders, range(1, 6) AS r(i) WHERE length(o) = 5),
counted AS (
  SELECT part, o, step, f,
    sum(n) FILTER (WHERE NOT gone AND NOT contains(mask, f)) AS kept, sum(n) FILTER (WHERE NOT gone AND contains(mask, f)) AS removed,
    sum(n) FILTER (WHERE gone AND contains(mask, f)) AS redundant, sum(n) FILTER (WHERE mask = f) AS unique_fails,
    sum(good) FILTER (WHERE NOT gone AND contains(mask, f)) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND contains(mask, f)) AS toxic_lost
  FROM (SELECT *, len(list_intersect(string_split(mask, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND mask <> '' AS gone FROM masks, places)
  GROUP BY part, o, step, f
)
SELECT part, o AS filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted"""

SQL = {
    "op5_quality_ledger": QUALITY_LEDGER,
    "quality_ablations": QUALITY_ABLATIONS,
    "op10_pivot_search": PIVOT_SEARCH,
    "op13_filter_audit": FILTER_AUDIT,
}
