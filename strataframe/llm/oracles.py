"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k
      FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM d) WHERE word <> ''),
g AS (SELECT doc_id, k, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS words FROM w
      WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
full_windows AS (SELECT doc_id, k, words, min(doc_id) OVER (PARTITION BY words) AS least FROM g WHERE n = 13),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM full_windows WHERE least < doc_id),
kept AS (SELECT w.doc_id, count(*) AS n_words, count(gone.k) AS n_removed,
                coalesce(string_agg(w.word, ' ' ORDER BY w.k) FILTER (WHERE gone.k IS NULL), '') AS text
         FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.k = gone.k GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (SELECT item_id, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k, ws FROM iw WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, array_to_string(ws[k:k + 9], ' ') AS g, least(len(ws), 10) AS n FROM i),
d AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM dw),
sizes AS (SELECT DISTINCT n FROM wins),
g AS (SELECT doc_id, k, 10 AS n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g,
             count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m FROM d),
hits AS (SELECT doc_id, k, item_id, g.n FROM g JOIN wins USING (g) WHERE m = 10 AND wins.n = 10),
per AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN cov USING (doc_id)
"""

OP3 = r"""
WITH m AS (SELECT conv_id, turn, role, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS text, lag(turn, 1) OVER w AS before, lag(turn, 2) OVER w AS second FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, CASE WHEN before = turn - 1 THEN before END AS parent_turn, CASE WHEN second = turn - 2 THEN second END AS grand FROM m),
t AS (SELECT *, sum(CASE WHEN parent_turn IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM p)
SELECT conv_id, turn, role, text,
       ((parent_turn IS NOT NULL)::BIGINT + (grand IS NOT NULL)::BIGINT) AS n_quotes,
       ((parent_turn IS NOT NULL)::BIGINT + (grand IS NOT NULL)::BIGINT) AS n_linked,
       coalesce(parent_turn, -1) AS parent_turn, min(turn) OVER (PARTITION BY conv_id, run) AS thread,
       row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS place,
       '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' AS formatted
FROM t
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT doc, lang, unnest(range(len(ps))) AS pn, unnest(ps) AS piece FROM d),
ws AS (SELECT doc, lang, pn, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
w AS (SELECT doc, lang, pn, unnest(range(len(ws))) AS k, unnest(ws) AS a FROM ws),
g AS (SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e FROM w WINDOW o AS (PARTITION BY doc, pn ORDER BY k)),
f AS (SELECT lang, [a] AS g, count(*) AS f FROM g GROUP BY lang, a
      UNION ALL SELECT lang, [a, b], count(*) FROM g WHERE b IS NOT NULL GROUP BY lang, a, b HAVING count(*) >= 30
      UNION ALL SELECT lang, [a, b, c], count(*) FROM g WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= 30
      UNION ALL SELECT lang, [a, b, c, e], count(*) FROM g WHERE e IS NOT NULL GROUP BY lang, a, b, c, e HAVING count(*) >= 30),
cand AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
inner_parts AS (SELECT lang, a AS longer, g[s:s + n - 1] AS g FROM cand, range(1, 4) t(s), range(2, 4) u(n) WHERE n < len(g) AND s + n - 1 <= len(g)),
gone AS (SELECT DISTINCT c.lang, c.g FROM cand c JOIN inner_parts i ON c.lang = i.lang AND c.g = i.g AND 100 * i.longer >= 80 * c.a),
cuts AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
         FROM (SELECT *, unnest(range(1, len(g))) AS k FROM cand) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score,
                  row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, array_to_string(b.g, ' ')) AS rank
           FROM best b WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.lang = b.lang AND x.g = b.g)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

OP13 = r"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS r, * FROM documents),
part AS (SELECT r, doc_id, source, replace(text, chr(10), '') AS cut, text,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM raw),
crc_table AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i)),
crc_all AS (SELECT list(c ORDER BY i) AS codes FROM crc_table),
leaf AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                               lambda c, b: xor(c // 256, codes[xor(c % 256, b) + 1])), 4294967295) % 2 = 0
                     THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) END AS altered
         FROM part, crc_all),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf),
low(source, lvl, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM placed
  UNION ALL SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
tops AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM tops
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 3, n),
steps AS (
  SELECT p.r, l.lvl, l.pos AS spot, l.digest, p.pos // (3 ** l.lvl)::BIGINT AS own FROM placed p JOIN low l ON p.source IS NOT DISTINCT FROM l.source AND l.n > 1 AND l.pos // 3 = p.pos // (3 ** (l.lvl + 1))::BIGINT
  UNION ALL
  SELECT p.r, 1000 + l.lvl, l.pos, l.digest, t.pos // (3 ** l.lvl)::BIGINT FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source JOIN high l ON l.n > 1 AND l.pos // 3 = t.pos // (3 ** (l.lvl + 1))::BIGINT),
sides AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k, coalesce(string_agg(digest, '' ORDER BY spot) FILTER (WHERE spot < own), '') AS a, coalesce(string_agg(digest, '' ORDER BY spot) FILTER (WHERE spot > own), '') AS b FROM steps GROUP BY r, lvl),
proofs AS (SELECT r, string_agg(a || b, '' ORDER BY k) AS proof, max(k) AS height FROM sides GROUP BY r),
fold(r, k, digest) AS (SELECT r, 0::BIGINT, coalesce(altered, leaf) FROM leaf UNION ALL SELECT fold.r, sides.k, sha256(a || digest || b) FROM fold JOIN sides ON fold.r = sides.r AND sides.k = fold.k + 1),
folded AS (SELECT r, max_by(digest, k) AS digest FROM fold GROUP BY r)
SELECT p.doc_id, p.leaf, t.subroot, h.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = h.digest AS verified
FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source JOIN folded f USING (r) LEFT JOIN proofs USING (r), (SELECT digest FROM high WHERE n = 1) h
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": OP1, "op3_quotation_linking": OP3, "op8_decontamination": OP8, "op12_phrase_collocations": OP12, "op13_merkle_manifest": OP13}
