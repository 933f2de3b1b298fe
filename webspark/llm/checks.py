"""SQL checks of the package's queries, for DuckDB on the same tables. The other queries are tested
against brute force."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from webspark.llm import collocations, line_dedup, quality, revisits
from webspark.llm.merkle_check import merkle_sql
from webspark.plans.checks import _url_steps

_SPACE = r"[\x20\x09-\x0D]+"

_LINE_FREQUENCY = rf"""
WITH w AS (SELECT doc_id, source, text, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT r, i, array_to_string(words[i:i + {quality.WINDOW_WORDS - 1}], ' ') AS win
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - {quality.WINDOW_WORDS - 1})) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT j) AS n FROM
  (SELECT r, unnest(generate_series(i, i + {quality.WINDOW_WORDS - 1})) AS j FROM again) GROUP BY r),
l AS (SELECT r, source, doc_id, line, no, len(list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: x <> '')) AS n,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{_SPACE}', ' ', 'g'), ' ') AS norm
  FROM (SELECT r, source, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
f AS (SELECT l.source, norm FROM l JOIN w USING (r) GROUP BY l.source, norm
  HAVING count(DISTINCT (w.doc_id, w.text)) > {quality.MAX_DOCS}),
gone AS (SELECT r, count(*) AS lines, sum(l.n) AS words FROM l JOIN f
  ON f.norm = l.norm AND f.source IS NOT DISTINCT FROM l.source GROUP BY r),
b AS (SELECT w.doc_id, len(w.words)::BIGINT AS n_words,
    len(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone.lines, 0)::BIGINT AS boilerplate_lines,
    (len(w.words) - coalesce(gone.words, 0))::BIGINT AS words_left
  FROM w LEFT JOIN dup USING (r) LEFT JOIN cover USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words)
    AND words_left >= {quality.LEAST_LEFT} * n_words AS kept
FROM b
"""

# Beginnings as lists of turns, compared as lists.
_SNAPSHOTS = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
    {'r': role, 't': text} AS said FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(said ORDER BY k) AS whole FROM t GROUP BY conv_id),
u AS (SELECT whole, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY whole),
b AS (SELECT DISTINCT whole[1:n] AS start FROM (SELECT whole, unnest(generate_series(1, len(whole) - 1)) AS n FROM u))
SELECT conv_id, len(whole)::BIGINT AS n_turns, copies,
  array_to_string(list_transform(whole, lambda s: '<|im_start|>' || coalesce(s.r, 'unknown') || chr(10) || coalesce(s.t, '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM u WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.start = u.whole)
"""

_BARRED = ", ".join(f"'{n}'" for n in revisits.NOT_MERGED)
_REVISITS = f"""
WITH p AS (SELECT page_id, url, md5(url) AS old, md5(html) AS new, len(html)::VARCHAR AS size,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS base FROM pages),
records AS (
  SELECT 'a' AS kind, 2 * page_id AS record_id, url || '#old' AS url, base AS time, '"' || old || '"' AS etag, NULL AS modified,
    old AS digest, [('etag', '"' || old || '"'), ('content-type', 'text/html'), ('content-length', size), ('date', 'old')] AS h FROM p
  UNION ALL SELECT 'a', 2 * page_id + 1, url, base + INTERVAL 120 MINUTE, 'W/"' || new || '"', new, new,
    [('etag', 'W/"' || new || '"'), ('content-type', 'text/html'), ('content-length', size), ('date', 'new'), ('last-modified', new)] FROM p
  UNION ALL SELECT 'b', 3 * page_id, url, base + INTERVAL 60 MINUTE, 'W/"' || old || '"', NULL, NULL,
    [('etag', 'W/"' || old || '"'), ('date', 'again'), ('content-length', '0'), ('connection', 'X-Trace, close'), ('x-trace', old)] FROM p
  UNION ALL SELECT 'b', 3 * page_id + 1, url, base + INTERVAL 180 MINUTE,
    CASE page_id % 3 WHEN 0 THEN '"' || new || '"' WHEN 1 THEN 'other' END, new, NULL,
    list_filter([('etag', CASE page_id % 3 WHEN 0 THEN '"' || new || '"' WHEN 1 THEN 'other' END), ('last-modified', new),
      ('date', 'later'), ('cache-control', 'no-store')], lambda e: e[2] IS NOT NULL) FROM p
  UNION ALL SELECT 'b', 3 * page_id + 2, url, base - to_minutes(100000000), NULL, NULL, new, [] FROM p),
{_url_steps("u", "records", "url")},
s AS (SELECT u_canonical AS key, time, arg_max({{'id': record_id, 'etag': etag, 'modified': modified, 'digest': digest, 'h': h}}, record_id) AS f
  FROM u WHERE kind = 'a' AND u_canonical IS NOT NULL GROUP BY ALL),
q AS (SELECT * FROM u WHERE kind = 'b'),
j AS (SELECT q.*, s.f FROM q ASOF LEFT JOIN s ON q.u_canonical = s.key AND q.time > s.time),
t AS (SELECT *, digest = f.digest AS d, regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') AS e FROM j),
v AS (SELECT *, CASE WHEN f IS NULL THEN 'no_response'
    WHEN NOT coalesce(d, true) OR NOT coalesce(e, true) OR (e IS NULL AND NOT coalesce(modified = f.modified, true)) THEN 'changed'
    WHEN coalesce(d, false) OR coalesce(e, false) OR (e IS NULL AND coalesce(modified = f.modified, false)) THEN 'resolved'
    ELSE 'unvalidated' END AS verdict FROM t),
m AS (SELECT *, list_filter(h, lambda x: x[1] NOT IN ({_BARRED}, 'x-trace', 'close')) AS fresh FROM v)
SELECT record_id, f.id AS response_id, verdict, CASE WHEN verdict = 'resolved' THEN array_to_string(list_sort(list_transform(
    list_concat(list_filter(f.h, lambda x: NOT list_contains(list_transform(fresh, lambda y: y[1]), x[1])), fresh),
    lambda x: x[1] || '=' || x[2])), '|') END AS merged_headers
FROM m
"""

_LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, no, translate(trim(line, ' '), '{ascii_uppercase}', '{ascii_lowercase}') AS line FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)
  WHERE len(trim(line, ' ')) >= {line_dedup.NEAR_CHARS} OR regexp_matches(line, '[A-Za-z0-9]|[^\\x00-\\x7F]')),
d AS (SELECT line, len(line) AS n, min({{'d': doc_id, 'l': no}}) AS place FROM l GROUP BY line),
h AS MATERIALIZED (SELECT line, n, place FROM d WHERE n >= {line_dedup.NEAR_CHARS}),
-- One edit leaves the beginning or the end of the two lines as it is.
e AS (SELECT line, n, place, 'a' AS side, left(line, {line_dedup.NEAR_CHARS // 2 - 1}) AS part FROM h
  UNION ALL SELECT line, n, place, 'z', right(line, {line_dedup.NEAR_CHARS // 2 - 1}) FROM h),
near AS (SELECT x.line, min(y.place) AS place FROM e x JOIN e y
  ON x.side = y.side AND x.part = y.part AND y.n BETWEEN x.n - 1 AND x.n + 1 AND y.place < x.place
    AND (left(x.line, least(x.n, y.n) // 2) = left(y.line, least(x.n, y.n) // 2)
      OR right(x.line, least(x.n, y.n) // 2) = right(y.line, least(x.n, y.n) // 2))
    AND levenshtein(x.line, y.line) = 1 GROUP BY x.line),
k AS (SELECT l.*, d.place AS own, near.place AS other, coalesce(least(d.place, near.place), d.place) AS kept
  FROM l JOIN d USING (line) LEFT JOIN near USING (line))
SELECT doc_id, no::INT AS line_no, kept.d AS kept_doc_id, kept.l::INT AS kept_line_no, (kept <> own)::INT AS distance
FROM k WHERE kept < {{'d': doc_id, 'l': no}}
"""

_COLLOCATIONS = rf"""
WITH w AS MATERIALIZED (SELECT lang, piece, i, word, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM (
    SELECT lang, piece, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
      SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM (
        SELECT coalesce(lang, 'und') AS lang,
          unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents))) WINDOW p AS (PARTITION BY piece ORDER BY i)),
t AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, word AS p, count(*) AS f FROM w GROUP BY ALL),
f2 AS (SELECT lang, word, b, count(*) AS f FROM w WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, word, b, c, count(*) AS f FROM w WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
s AS (SELECT x.lang, x.word || ' ' || x.b AS phrase, x.f AS a, l.f AS l, r.f AS r, 1 AS k
    FROM f2 x JOIN f1 l ON l.lang = x.lang AND l.p = x.word JOIN f1 r ON r.lang = x.lang AND r.p = x.b
    WHERE x.f >= {collocations.LEAST} AND NOT EXISTS (SELECT 1 FROM f3 y WHERE y.lang = x.lang
      AND ((y.word = x.word AND y.b = x.b) OR (y.b = x.word AND y.c = x.b)) AND 100 * y.f >= {collocations.WITHIN_PERCENT} * x.f)
  UNION ALL SELECT x.lang, x.word || ' ' || x.b || ' ' || x.c, x.f, l.f, r.f, 1
    FROM f3 x JOIN f1 l ON l.lang = x.lang AND l.p = x.word JOIN f2 r ON r.lang = x.lang AND r.word = x.b AND r.b = x.c
  UNION ALL SELECT x.lang, x.word || ' ' || x.b || ' ' || x.c, x.f, l.f, r.f, 2
    FROM f3 x JOIN f2 l ON l.lang = x.lang AND l.word = x.word AND l.b = x.b JOIN f1 r ON r.lang = x.lang AND r.p = x.c),
v AS (SELECT *, ({collocations.SCALE}::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM s),
o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o JOIN t USING (lang))
WHERE rank <= {collocations.TOP}
"""

CHECKS: dict[str, str] = {
    "op1_line_frequency": _LINE_FREQUENCY,
    "op4_snapshots": _SNAPSHOTS,
    "op5_revisits": _REVISITS,
    "op10_line_dedup": _LINE_DEDUP,
    "op11_merkle": merkle_sql(),
    "op12_collocations": _COLLOCATIONS,
}
