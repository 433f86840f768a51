"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

from . import quality_rules as rules

_WORDS = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_LETTERS}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format('text')}, '{_LETTERS}') AS w FROM benchmark WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, (SELECT DISTINCT k FROM p))),
h AS MATERIALIZED (SELECT rid, item, k, i FROM g JOIN p USING (k, g)),
n AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS q FROM h) GROUP BY rid),
s AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM h WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""

OP7 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
g AS MATERIALIZED (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
h AS MATERIALIZED (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS q FROM g JOIN r USING (g)),
k AS (SELECT rid, string_agg(v, ' ' ORDER BY q) AS kept FROM (SELECT rid, unnest(w) AS v, generate_subscripts(w, 1) AS q FROM d) ANTI JOIN h USING (rid, q) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""


def _op5(alpha: float = 0.04, delta: float = 0.05) -> str:
    names = list(rules.RULES)
    value = {r: f"{a} / greatest({b}, 1)::DOUBLE" for r, (a, b) in rules.RULES.items()}
    rate = alpha / len(names)
    tried = ", ".join(f"struct_pack(rule := '{r}', value := {r})" for r in names)
    cuts = ", ".join(f"{c}::DOUBLE" for c in rules.CUTOFFS)
    verdict = " OR ".join(f"coalesce({value[r]} > (SELECT cutoff FROM best b WHERE b.stratum = coalesce(f.stratum, '') AND rule = '{r}'), false)" for r in names)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORDS}') GROUP BY rid),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
rp AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS q FROM g JOIN (SELECT rid, g FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (rid, g)) GROUP BY rid),
f AS MATERIALIZED (SELECT doc_id, stratum, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{rules.SYMBOLS}'))::BIGINT AS n_symbols,
  len(regexp_extract_all(t, '[A-Z][A-Z]'))::BIGINT AS n_capitals, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rp.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN ln USING (rid) LEFT JOIN rp USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
l AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
o AS (SELECT coalesce(stratum, '') AS stratum, t, max(good) AS good, {', '.join(f'max({v}) AS {r}' for r, v in value.items())} FROM m JOIN l USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2),
x AS (SELECT stratum, good, v.rule AS rule, v.value AS value FROM (SELECT stratum, good, unnest([{tried}]) AS v FROM o)),
tb AS MATERIALIZED (SELECT stratum, rule, cutoff, sum(good) AS n, sum(1 - good) AS n_bad, count(*) FILTER (good = 1 AND value > cutoff) AS wrong, count(*) FILTER (good = 0 AND value > cutoff) AS hits FROM x, (SELECT unnest([{cuts}]) AS cutoff) GROUP BY 1, 2, 3),
sz AS (SELECT stratum, max(n) AS n FROM tb GROUP BY 1),
ks AS (SELECT stratum, n, unnest(range(0, ceil(n * {rate})::BIGINT + 1)) AS k FROM sz WHERE n > 0),
tl AS (SELECT stratum, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({rate}) + (n - k) * ln(1 - {rate}))) OVER (PARTITION BY stratum ORDER BY k) AS tail FROM (SELECT stratum, n::DOUBLE AS n, k::DOUBLE AS k FROM ks)),
al AS (SELECT stratum, max(k) AS most FROM tl WHERE tail <= {delta} / ({len(names)} * (SELECT count(*) FROM sz)) GROUP BY 1),
best AS MATERIALIZED (SELECT stratum, rule, max(struct_pack(g := round(hits / n_bad - wrong / n, 9), c := cutoff)).c AS cutoff FROM tb JOIN al USING (stratum) WHERE wrong <= most AND hits * n > wrong * n_bad GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({verdict}) AS kept FROM m f
"""


OP5 = _op5()

_TERMS = r"[A-Za-z\x{80}-\x{10FFFF}]+"
_SHARE = "(1 + 1000000000::HUGEINT * ({} + 1) // ({} + v))"
OP12 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format('text')}, '{_TERMS}') AS w FROM documents),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT rid) AS docs FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c SEMI JOIN k USING (lang, term) GROUP BY lang, source),
l AS MATERIALIZED (SELECT lang, count(term) AS v, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format('coalesce(c.n, 0)', 'coalesce(s.total, 0)')} AS p, {_SHARE.format('k.n', 'l.total')} AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(o.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM e))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
