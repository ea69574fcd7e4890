"""DuckDB SQL of the operators that SQL can express, over whole tables: an independent, plain form of each result."""

from __future__ import annotations

# Every query vector against every other row, in whole numbers.
TOPK = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id,
    list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""

# Sets of shingles, their overlaps by a join on the shingle, and the least id within reach.
JACCARD = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
u AS (SELECT s, len(s) AS n, min(row) AS a FROM s GROUP BY s),
x AS (SELECT a, n, md5_number(unnest(s)) AS shingle FROM u),
met AS (SELECT p.a AS a, q.a AS b, any_value(p.n) AS m, any_value(q.n) AS n, count(*) AS k
  FROM x p JOIN x q ON p.shingle = q.shingle AND p.a < q.a AND 100 * least(p.n, q.n) >= 75 * greatest(p.n, q.n) GROUP BY p.a, q.a),
e AS (SELECT a, b FROM met WHERE 100 * k >= 75 * (m + n - k)),
near AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, a AS b FROM u UNION SELECT r.a, near.b FROM reach r JOIN near ON near.a = r.b),
first AS (SELECT u.a, min(doc_id) AS first FROM u JOIN s USING (s) GROUP BY u.a),
least AS (SELECT r.a, min(first) AS component_id FROM reach r JOIN first ON first.a = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(u.n AS BIGINT) AS n_shingles, CASE WHEN u.n = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM s JOIN u USING (s) JOIN least ON least.a = u.a
"""

# The final messages are the rows themselves: deltas and regenerations of the event log end in them.
CHAT = """
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
x AS (SELECT *, replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') AS r,
    replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS t FROM c),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS flat,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(r) + 1 + length(t) + length('<|im_end|>') + 1) AS chars FROM x GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(flat) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars FROM g
"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", f"({n_chars})", "text")) + ")"


# CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(range(0, 8 * strlen(CAST(doc_id AS VARCHAR))), lambda c, i:
    CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 AS INTEGER) + 1, 1)) AS BIGINT) ELSE 0 END) & 1 = 1
    THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 AS INTEGER) + 1, 1)) AS BIGINT) ELSE 0 END) >> 1, 3988292384)
    ELSE xor(c, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 AS INTEGER) + 1, 1)) AS BIGINT) ELSE 0 END) >> 1 END,
    CAST(4294967295 AS BIGINT)), 4294967295)"""


# Both trees level by level, every row's way up folded beside them.
MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf('n_chars')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf('CAST(n_chars AS HUGEINT) + 1')} ELSE {_leaf('n_chars')} END AS seen FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (SELECT tree, 0 AS level, idx, leaf AS node, n FROM l
  UNION ALL SELECT tree, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, level, idx // 2),
tops AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS trees FROM up WHERE n = 1),
over AS (SELECT 0 AS level, place AS idx, subroot AS node, trees AS n FROM tops
  UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM over WHERE n > 1 GROUP BY level, idx // 2),
way AS (SELECT row_number() OVER () AS row, l.*, 0 AS level, idx AS at, n AS width, seen AS node, '' AS proof FROM l
  UNION ALL SELECT w.row, w.doc_id, w.tree, w.leaf, w.seen, w.idx, w.n, w.level + 1, w.at // 2, (w.width + 1) // 2,
    sha256(CASE WHEN s.node IS NULL THEN w.node WHEN w.at % 2 = 1 THEN s.node || w.node ELSE w.node || s.node END), w.proof || coalesce(s.node, '')
  FROM way w LEFT JOIN up s ON s.tree = w.tree AND s.level = w.level AND s.idx = xor(w.at, 1) WHERE w.width > 1),
top_way AS (SELECT w.row, w.doc_id, w.leaf, t.subroot, 0 AS level, t.place AS at, t.trees AS width, w.node, w.proof FROM way w JOIN tops t USING (tree) WHERE w.width = 1
  UNION ALL SELECT w.row, w.doc_id, w.leaf, w.subroot, w.level + 1, w.at // 2, (w.width + 1) // 2,
    sha256(CASE WHEN s.node IS NULL THEN w.node WHEN w.at % 2 = 1 THEN s.node || w.node ELSE w.node || s.node END), w.proof || coalesce(s.node, '')
  FROM top_way w LEFT JOIN over s ON s.level = w.level AND s.idx = xor(w.at, 1) WHERE w.width > 1)
SELECT doc_id, leaf, subroot, (SELECT node FROM over WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
  node = (SELECT node FROM over WHERE n = 1) AS verified FROM top_way WHERE width = 1
"""

ORACLE = {"op3_topk": TOPK, "op7_jaccard": JACCARD, "op10_chat": CHAT, "op12_merkle": MERKLE}
