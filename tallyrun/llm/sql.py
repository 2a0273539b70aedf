"""DuckDB SQL for the operators that SQL can express over whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: near-duplicates by an inverted index over all shingles and least labels over all links
NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

#: counts per text, words in repeated windows of eight, and the line rules
QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 8) AS t(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS l FROM d),
lw AS (SELECT *, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
m AS (SELECT *, len(lw) AS n, strlen(array_to_string(lw, '')) AS size, length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) AS marks,
  len(list_filter(lw, lambda x: x IN ('|', '>', '»', '·', '•', '/', '::'))) AS seps,
  length(regexp_replace(l, '[^\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(l, '[^\p{{L}}]', '', 'g')) AS letters,
  len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) AS same,
  row_number() OVER (PARTITION BY doc_id, l ORDER BY pos) AS nth FROM lw),
f AS (SELECT *, (marks > 0 AND marks >= 0.3 * n) OR (n >= 3 AND seps >= 0.2 * n)
  OR (n >= 5 AND up > 0 AND NOT (up = 1 AND regexp_matches(l, '^\p{{Lu}}')) AND up > 0.7 * letters)
  OR (n >= 10 AND same > 0.5 * (n - 1))
  OR regexp_matches(l, '(?i)lorem ipsum|enable javascript|javascript is (disabled|required)|accept (all )?cookies|uses cookies|cookie policy|privacy policy|terms of (use|service)|sign up for our newsletter|click here to|skip to (main )?content')
  OR (n < 5 AND NOT regexp_matches(rtrim(l), '([.!?…:;"”’»)。！？]|\.'')$')) AS bad FROM m),
t AS (SELECT doc_id, count(*) FILTER (WHERE nth > 1) AS dup, sum(size) AS total, coalesce(sum(size) FILTER (WHERE bad), 0) AS lost FROM f GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(t.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(t.lost, 0) / greatest(coalesce(t.total, 1), 1) AS share
  FROM d LEFT JOIN t USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND share <= 0.3 AS kept FROM b
"""
