"""DuckDB SQL of the queries that SQL can express, written from their rules."""

import re
import string

from landfall.llm.license_scan import NOTICE_K, NOTICES, PHRASE_K, PHRASES
from landfall.llm.secret_scan import RULES

WORD = r"'[^\x20\x09-\x0D]+'"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, COALESCE(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {WORD}) AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) x),
twice AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, g) AS n FROM win) x WHERE n > 1),
cov AS (SELECT rid, COUNT(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(COALESCE(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.rid = w.rid),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             word_chars / greatest(n_words, 1) AS mean FROM m),
f AS (SELECT *, base_failed OR n_symbols > 0.2 * n_words OR n_dup_lines > 0.5 * n_lines
                OR mean < 2 OR mean > 15 AS fails FROM j),
-- each document once for every rule: six rules, the last being any of the five
e AS (SELECT source, rule, CASE rule WHEN 0 THEN n_words < 50 WHEN 1 THEN n_repeat_words > 0.5 * n_words WHEN 2 THEN n_symbols > 0.2 * n_words
             WHEN 3 THEN n_dup_lines > 0.5 * n_lines WHEN 4 THEN mean < 2 OR mean > 15 ELSE fails END AS broken FROM f, range(6) r(rule)),
h AS (SELECT source, rule, COUNT(*) AS n, COUNT(CASE WHEN broken THEN 1 END) AS x FROM e GROUP BY source, rule),
a AS (SELECT rule, SUM(x) / SUM(n) AS mean, var_samp(x / n) AS var, AVG(1 / n) AS inv FROM h GROUP BY rule),
b AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(COALESCE(var, 0) - mean * (1 - mean) * inv, 1e-9) - 1, 1), 1e6) AS s FROM a),
r AS (SELECT source, bool_or((x + s * mean) / (n + s) > 0.8) AS host_condemned FROM h JOIN b ON b.rule = h.rule GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT fails AND NOT host_condemned AS kept, fails, host_condemned
FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, {WORD})), 0) AS BIGINT) AS size,
                  ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(COALESCE(text, ''))), 1, 15))::BIGINT AS place,
                  row_number() OVER (PARTITION BY doc_id, source, text) AS copy FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
      FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS lim FROM s),
l AS (SELECT *, (SUM(source_size) OVER () * 1.5::DOUBLE
                 - COALESCE(SUM(lim) OVER (ORDER BY lim / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (SUM(w) OVER () - COALESCE(SUM(w) OVER (ORDER BY lim / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w),
-- the first source, by limit over weight, that does not reach its limit fixes the level of all
t AS (SELECT source, source_size, rank, least(lim, COALESCE(w * (SELECT arg_min(level, lim / w) FROM l WHERE level * w <= lim), lim)) AS target FROM l),
q AS (SELECT d.*, t.source_size, t.rank, t.target,
             SUM(size) OVER (PARTITION BY d.source ORDER BY place, doc_id NULLS FIRST, copy) AS cum
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT q.*, turn, (cum + turn * source_size) / target AS finish FROM q, range(2) r(turn) WHERE size > 0 AND target > 0),
c AS (SELECT *, SUM(size) OVER (ORDER BY finish, rank, place, doc_id NULLS FIRST, copy, turn) AS served FROM e),
x AS (SELECT source, place, doc_id, copy, COUNT(*) AS n FROM c
      WHERE served <= (SELECT 1.5 * SUM(size) FROM d) GROUP BY source, place, doc_id, copy)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(COALESCE(x.n, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN x ON x.doc_id IS NOT DISTINCT FROM q.doc_id AND x.source IS NOT DISTINCT FROM q.source AND x.place = q.place AND x.copy = q.copy
"""

LICENSE_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWER = f"translate(COALESCE(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def gram_rows() -> str:
    """Template grams as rows: label, is_phrase, n_grams, t_at, gram."""
    out = []
    for templates, k, phrase in ((PHRASES, PHRASE_K, "TRUE"), (NOTICES, NOTICE_K, "FALSE")):
        for label, text in templates:
            w = re.findall("[a-z0-9]+", text)
            out += [f"({quoted(label)}, {phrase}, {len(w) - k + 1}, {i}, {quoted(' '.join(w[i:i + k]))})"
                    for i in range(len(w) - k + 1)]
    return ", ".join(out)


def gram(k: int) -> str:
    return " || ' ' || ".join(f"ws[i + {n}]" for n in range(1, k + 1))


LICENSES = f"""
WITH tpl(label, is_phrase, n_grams, t_at, gram) AS (VALUES {gram_rows()}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, {LICENSE_WORD}) AS ws FROM documents),
g AS (SELECT rid, i, {gram(PHRASE_K)} AS g2, {gram(NOTICE_K)} AS g5
      FROM (SELECT rid, ws, unnest(range(len(ws))) AS i FROM d) x),
hit AS (SELECT rid, i, t.* FROM g JOIN tpl t ON t.gram = CASE WHEN t.is_phrase THEN g2 ELSE g5 END),
dia AS (SELECT DISTINCT rid, label, i - t_at AS d FROM hit),
isl AS (SELECT *, SUM(CASE WHEN step IS NULL OR step > CASE WHEN label IN ({', '.join(quoted(x) for x, _ in PHRASES)}) THEN 0 ELSE 4 END
                      THEN 1 ELSE 0 END) OVER (PARTITION BY rid, label ORDER BY d) AS span
        FROM (SELECT *, d - lag(d) OVER (PARTITION BY rid, label ORDER BY d) AS step FROM dia) x),
spn AS (SELECT h.rid, h.label, is_phrase, n_grams, span, COUNT(DISTINCT t_at) / n_grams AS share, MIN(i) AS lo, MAX(i) AS hi
        FROM hit h JOIN isl ON isl.rid = h.rid AND isl.label = h.label AND isl.d = h.i - h.t_at
        GROUP BY h.rid, h.label, is_phrase, n_grams, span),
ok AS (SELECT * FROM spn WHERE CASE WHEN is_phrase THEN share = 1 ELSE share >= 0.8 AND hi - lo < n_grams * 1.5 + 4 END)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, COUNT(CASE WHEN is_phrase THEN 1 END) AS n_base,
       MIN(CASE WHEN is_phrase THEN lo END) AS first_word, MAX(CASE WHEN is_phrase THEN lo END) AS last_word,
       COALESCE(string_agg(DISTINCT CASE WHEN is_phrase THEN label END, ',' ORDER BY CASE WHEN is_phrase THEN label END), '') AS base_labels,
       COALESCE(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, COALESCE(MAX(share), 0.0) AS score
FROM d LEFT JOIN ok ON ok.rid = d.rid GROUP BY d.rid, d.doc_id, ws
"""


def rule_matches(number: int, rule) -> str:
    """Matches of one rule with the lengths before them."""
    p = quoted(rule.pattern)
    return f"""SELECT rid, {number} AS kind, {quoted(rule.kind)} AS name, {rule.least} AS least, {rule.least_value} AS least_value,
        regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS b,
        regexp_extract_all(t, {p}, {2 if rule.least_value else 0}) AS v FROM d"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t FROM documents),
r AS ({' UNION ALL '.join(rule_matches(i, x) for i, x in enumerate(RULES))}),
x AS (SELECT rid, kind, name, least, least_value, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(b[:len(m)]) AS b, unnest(v) AS v FROM r),
y AS (SELECT rid, kind, name, length(m) AS n, length(m) >= least AND length(v) >= least_value AS holds,
             SUM(length(b) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM x),
s AS (SELECT rid, kind, name, CAST(e - n AS BIGINT) AS a, name || ':' || CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT) AS said
      FROM y WHERE holds)
SELECT d.doc_id, COUNT(CASE WHEN name = 'assign' THEN 1 END) AS n_assign, COUNT(CASE WHEN name = 'access' THEN 1 END) AS n_access,
       COUNT(CASE WHEN name = 'hex' THEN 1 END) AS n_hex,
       sha256(COALESCE(string_agg(said, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256,
       COALESCE(string_agg(said, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN s ON s.rid = d.rid GROUP BY d.rid, d.doc_id
"""

FILL_MIDDLE = """
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, CAST(length(t) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
y AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM z
"""


def assignment(n: int) -> str:
    """Nearest of the centroids c{n} per vector, by all components anew."""
    return f"""f{n} AS (SELECT rid, j, SUM((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{n} c ON c.i = e.i GROUP BY rid, j),
a{n} AS (SELECT rid, j, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, j) AS o FROM f{n}) x WHERE o = 1)"""


def moved(n: int) -> str:
    """Centroids c{n + 1}: floor of the mean, or the old one if empty."""
    return f"""m{n} AS (SELECT j, i, SUM(x) AS s, COUNT(*) AS n FROM a{n} JOIN e ON e.rid = a{n}.rid GROUP BY j, i),
c{n + 1} AS (SELECT c.j, c.i, CASE WHEN s IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
       FROM c{n} c LEFT JOIN m{n} m ON m.j = c.j AND m.i = c.i)"""


CENTROIDS = f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda x: isfinite(x))) = 64),
e AS (SELECT rid, unnest(range(64)) AS i, CAST(floor(64 * unnest(v)) AS BIGINT) AS x FROM k),
c0 AS (SELECT j, i, x FROM e JOIN (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || COALESCE(CAST(vec_id AS VARCHAR), '')),
           vec_id NULLS LAST, list_transform(v, lambda x: floor(64 * x))) - 1 AS j FROM k) s ON s.rid = e.rid WHERE j < 16),
{assignment(0)}, {moved(0)}, {assignment(1)}, {moved(1)}, {assignment(2)}, {moved(2)}, {assignment(3)},
g AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c3 GROUP BY j)
SELECT vec_id, CAST(a3.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(SUM(d) OVER (PARTITION BY a3.j) AS BIGINT) AS cluster_inertia,
       CAST(SUM(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a3 JOIN k ON k.rid = a3.rid JOIN g ON g.j = a3.j
"""

MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
             ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d),
k AS (SELECT g, min(doc_id) AS id, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT id, n, unnest(g) AS g FROM k),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id < b.id
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id AS a, id AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a),
f AS (SELECT s.doc_id, len(s.g) AS n, COALESCE(c.component_id, s.doc_id) AS component_id
      FROM s LEFT JOIN k ON k.g = s.g LEFT JOIN c ON c.id = k.id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM f
"""

SQL = {"op11_minhash": MINHASH, "op12_centroids": CENTROIDS, "op13_fill_middle": FILL_MIDDLE, "op1_license_scan": LICENSES, "op4_secret_scan": SECRETS, "op2_quality_hosts": QUALITY, "op5_mixing": MIXING}
