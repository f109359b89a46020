"""DuckDB SQL of the queries that SQL can state, written from the contracts."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT doc_id, p, ws[p:p + 4] AS win FROM w, unnest(range(1, len(ws) - 3)) AS r(p)
), twice AS (
  SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM twice, unnest(range(p, p + 5)) AS r(q) GROUP BY doc_id
), line AS (
  SELECT doc_id, x,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
         regexp_matches(x, '(?i)(all rights reserved|(privacy|cookie) policy|uses cookies|terms of (use|service)|(enable|requires) javascript|lorem ipsum|click here|subscribe to our|sign up for our newsletter)') AS boiler,
         len(regexp_extract_all(x, '[|»›•·]')) AS seps,
         regexp_matches(x, '(?i)^[\x20\x09-\x0D]*(home|menu|search|log ?in|sign (in|up)|register|next|previous|share|read more|back to top|skip to (main )?content|contact( us)?|about( us)?)[\x20\x09-\x0D]*$') AS menu,
         regexp_matches(x, '[.!?…。！？]["''”’»)\]]*([\x20\x09-\x0D]|$)') AS sentence,
         len(regexp_extract_all(x, '[#*$%&!?|<>~=_]{2,}')) AS decorated
  FROM w, unnest(ls) AS u(x)
), judged AS (
  SELECT doc_id, length(x) AS c, CASE WHEN boiler THEN 'b' WHEN seps * 4 >= n OR menu THEN 'n'
         WHEN NOT sentence OR decorated * 4 >= n THEN 'p' END AS rule
  FROM line
), j AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (rule = 'p') AS np, count(*) FILTER (rule = 'n') AS nn,
         count(*) FILTER (rule = 'b') AS nb, sum(c) AS c, coalesce(sum(c) FILTER (rule IS NULL), 0) AS good
  FROM judged GROUP BY doc_id
), s AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(np, 0)::BIGINT AS n_bad_punctuation,
         coalesce(nn, 0)::BIGINT AS n_navigation, coalesce(nb, 0)::BIGINT AS n_boilerplate,
         coalesce(c, 0)::BIGINT AS line_chars, coalesce(good, 0)::BIGINT AS clean_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN j USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND line_chars - clean_chars <= line_chars * 0.3::DOUBLE AS kept
FROM s
"""

ORACLES["op2_sharding"] = r"""
WITH RECURSIVE shard AS (
  SELECT i::INT AS i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range(32) AS r(i)
), pref AS (
  SELECT i, ('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % 3203 AS o,
         ('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % 3202 + 1 AS k
  FROM shard
), prefs AS (
  SELECT list(o ORDER BY i) AS os, list(k ORDER BY i) AS ks FROM pref
), fill AS (
  SELECT 0::BIGINT AS t, -1::BIGINT AS got, list_transform(range(3203), lambda s: -1::INT) AS slots
  UNION ALL
  SELECT t + 1, pick, list_transform(range(3203), lambda s: CASE WHEN s = pick THEN (t % 32)::INT ELSE slots[s + 1] END)
  FROM (
    SELECT t, slots, (os[t % 32 + 1] + ks[t % 32 + 1]
           * list_filter(range(3203), lambda j: slots[(os[t % 32 + 1] + j * ks[t % 32 + 1]) % 3203 + 1] < 0)[1]) % 3203 AS pick
    FROM fill, prefs WHERE t < 3203
  )
), filled AS (
  SELECT got AS slot, ((t - 1) % 32)::INT AS shard FROM fill WHERE t > 0
)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 3203 AS slot FROM documents)
JOIN filled USING (slot)
"""

ORACLES["op10_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS w
  FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS r(p) WHERE len(ws) > 0
), win AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM d, (SELECT DISTINCT n FROM pat) AS lengths, unnest(range(1, len(ws) - n + 2)) AS r(p)
), hit AS (
  SELECT doc_id, p, pat.n, item_id FROM win JOIN pat ON win.w = pat.w AND win.n = pat.n
), counted AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS r(q) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hit GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op5_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 2], ' ') AS s
  FROM d, unnest(range(1, greatest(len(ws) - 1, 2))) AS r(p) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) AS c USING (doc_id)
"""

ORACLES["op3_license_scan"] = r"""
WITH t(licence, variant, txt) AS (VALUES
  ('AGPL-3.0', 0, 'This work is licensed under the GNU Affero General Public License, version 3.'),
  ('Apache-2.0', 0, 'Licensed under the Apache License, Version 2.0.'),
  ('BSD-3-Clause', 0, 'Redistribution and use in source and binary forms are permitted under the BSD License.'),
  ('CC-BY-4.0', 0, 'Licensed under CC BY 4.0.'),
  ('CC-BY-4.0', 1, 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
  ('CC-BY-NC-4.0', 0, 'Licensed under CC BY-NC 4.0.'),
  ('CC-BY-NC-4.0', 1, 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.'),
  ('CC0-1.0', 0, 'Dedicated to the public domain under the CC0 1.0 Universal dedication.'),
  ('GPL-3.0', 0, 'This work is licensed under the GNU General Public License, version 3.'),
  ('LGPL-3.0', 0, 'This work is licensed under the GNU Lesser General Public License, version 3.'),
  ('MIT', 0, 'Released under the MIT License.'),
  ('MIT', 1, 'Permission is hereby granted, free of charge, under the MIT License.'),
  ('MPL-2.0', 0, 'This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.')
), tt AS (
  SELECT licence, variant, term, count(*) AS tf FROM (
    SELECT licence, variant, unnest(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+')) AS term FROM t) GROUP BY ALL
), line AS (
  SELECT doc_id, p AS line, string_split(text, chr(10))[p] AS x FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(p)
), pass AS (
  SELECT doc_id, line, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS ws FROM line
  WHERE regexp_matches(x, '(?i)(licen[cs]ed?|copyright|redistribution|permission|public domain|creative commons|\bcc0\b)')
), f AS (
  SELECT doc_id, line, len(ws) AS words, term, count(*) AS tf FROM pass, unnest(ws) AS u(term) GROUP BY ALL
), nn AS (
  SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, line FROM f)
), idf AS (
  SELECT term, ln((1.0::DOUBLE + (SELECT n FROM nn)) / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM tt) LEFT JOIN (SELECT term, count(*) AS df FROM f GROUP BY term) USING (term)
), tv AS (
  SELECT licence, variant, term, tf * idf AS w FROM tt JOIN idf USING (term)
), tn AS (
  SELECT licence, variant, sqrt(sum(w * w)) AS tn FROM tv GROUP BY ALL
), v AS (
  SELECT doc_id, line, words, term, tf * coalesce(idf, ln(1.0::DOUBLE + (SELECT n FROM nn)) + 1) AS v FROM f LEFT JOIN idf USING (term)
), vn AS (
  SELECT doc_id, line, words, sqrt(sum(v * v)) AS vn FROM v GROUP BY ALL
), c AS (
  SELECT doc_id, line, words, licence, round(p / (vn * tn), 6) AS cosine
  FROM (SELECT doc_id, line, licence, variant, sum(v * w) AS p FROM v JOIN tv USING (term) GROUP BY ALL)
  JOIN tn USING (licence, variant) JOIN vn USING (doc_id, line)
), best AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY cosine DESC, licence) = 1
), good AS (
  SELECT * FROM best WHERE cosine >= 0.75
), own AS (
  SELECT doc_id, count(*) AS n_passages, sum(words) AS inside, first(licence ORDER BY cosine DESC, licence, line) AS own_licence,
         max(cosine) AS own_cosine FROM good GROUP BY doc_id
), j AS (
  SELECT d.doc_id, d.source, d.lang, coalesce(n_passages, 0)::BIGINT AS n_passages, own_licence, own_cosine,
         coalesce(own_licence IS NOT NULL AND inside >= 0.1::DOUBLE * len(regexp_extract_all(text, '[\p{L}\p{N}]+')), false) AS is_licence_file,
         CASE d.doc_id % 3 WHEN 0 THEN [source] WHEN 1 THEN [source || '/' || lang, source]
              ELSE [source || '/' || lang || '/' || (d.doc_id // 3000), source || '/' || lang, source] END || [''] AS dirs
  FROM documents d LEFT JOIN own USING (doc_id)
), speaks AS (
  SELECT dirs[1] AS dir, first(own_licence ORDER BY own_cosine DESC, own_licence) AS licence FROM j WHERE is_licence_file GROUP BY 1
), near AS (
  SELECT doc_id, first(speaks.licence ORDER BY far) AS licence, first(speaks.dir ORDER BY far) AS dir
  FROM (SELECT doc_id, far, dirs[far] AS dir FROM j, unnest(range(1, len(dirs) + 1)) AS r(far) WHERE own_licence IS NULL) JOIN speaks USING (dir) GROUP BY doc_id
)
SELECT j.doc_id, source, lang, n_passages, own_licence, own_cosine, is_licence_file, coalesce(own_licence, near.licence) AS licence, near.dir AS inherited_from
FROM j LEFT JOIN near USING (doc_id)
"""

ORACLES["op12_source_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
           translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), size AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), total AS (
  SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (t.n + 5 * s.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 5) // (s.n + 5 * s.v) AS q
  FROM g JOIN kept k USING (lang) JOIN size s USING (lang) JOIN total t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 3
), parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
