"""DuckDB SQL for the manifest of ``documents``, level by level in recursive tables."""

import string

_LEAF = "sha256(concat({}))".format(", ".join("coalesce(concat(strlen({0}::VARCHAR), ':', {0}::VARCHAR), '-')".format(c) for c in ("{d}", "{s}", "{l}", "{n}", "{t}")))


def _leaf(text: str) -> str:
    return _LEAF.format(d="doc_id", s="source", l="lang", n="n_chars", t=text)


_SIBLINGS = """coalesce(string_agg(h, '') OVER (PARTITION BY level, tree, k // 8 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (PARTITION BY level, tree, k // 8 ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind"""

#: A leaf and its way to the root; the CRC-32 is worked out from its polynomial.
MANIFEST_SQL = f"""
WITH RECURSIVE byte_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
marked AS (
  SELECT d.*, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
         list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) END AS crc
  FROM documents d, byte_table),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS leaf,
         CASE WHEN crc % 3 = 0 THEN {_leaf(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} ELSE {_leaf('text')} END AS claim
  FROM marked),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
forest AS (
  SELECT 0 AS level, tree, k, n, leaf AS h FROM ranked
  UNION ALL
  SELECT level + 1, tree, k // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY k)) FROM forest WHERE n > 1 GROUP BY level, tree, k // 8, n),
subroots AS (
  SELECT tree AS own, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n FROM forest WHERE n = 1),
top AS (
  SELECT 100 AS level, '#' AS tree, k, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, tree, k // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY k)) FROM top WHERE n > 1 GROUP BY level, tree, k // 8, n),
steps AS (
  SELECT level, tree, k, level + 1 AS to_level, tree AS to_tree, k // 8 AS to_k, {_SIBLINGS} FROM forest WHERE n > 1
  UNION ALL
  SELECT level, tree, k, level + 1, tree, k // 8, {_SIBLINGS} FROM top WHERE n > 1
  UNION ALL
  SELECT f.level, f.tree, f.k, 100, '#', s.k, NULL, NULL FROM forest f JOIN subroots s ON s.own = f.tree WHERE f.n = 1),
walk AS (
  SELECT doc_id, leaf, tree AS own, 0 AS level, tree, k, claim AS h, '' AS proof FROM ranked
  UNION ALL
  SELECT w.doc_id, w.leaf, w.own, s.to_level, s.to_tree, s.to_k,
         CASE WHEN s.before IS NULL THEN w.h ELSE sha256(s.before || w.h || s.behind) END, w.proof || coalesce(s.before || s.behind, '')
  FROM walk w JOIN steps s ON s.level = w.level AND s.tree = w.tree AND s.k = w.k)
SELECT w.doc_id, w.leaf, r.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM walk w JOIN top t ON t.n = 1 AND w.level = t.level AND w.tree = t.tree AND w.k = t.k JOIN subroots r ON r.own = w.own"""
