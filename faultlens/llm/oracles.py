"""DuckDB SQL giving the same rows as the registered queries, where SQL can."""

OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM v
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
), part AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM part LEFT JOIN counted ON id = a
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), best AS (
  SELECT text_sha256, count(*) AS group_size,
         arg_max(doc_id, (n, -doc_id)) AS keep_id
  FROM d GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN best USING (text_sha256)
"""

OP7 = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), k AS (
  SELECT *, translate(
      trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, pos, line, keeper IS NOT NULL AND k.doc_id <> keeper AS dropped
  FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP11 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP13 = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS a,
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS b,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS e
  FROM documents
), leaves AS (
  SELECT doc_id, tree,
    sha256(a || b || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || e) AS leaf,
    sha256(a || b || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || e) AS other,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos
  FROM d
), up AS (
  SELECT tree, 0 AS k, list(leaf ORDER BY doc_id) AS l FROM leaves GROUP BY tree
  UNION ALL
  SELECT tree, k + 1, list_transform(range(0, (len(l) + 1) // 2),
    lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))
  FROM up WHERE len(l) > 1
), sub AS (
  SELECT tree, l[1] AS subroot, k AS height, row_number() OVER (ORDER BY tree) - 1 AS place
  FROM up WHERE len(l) = 1
), over_ AS (
  SELECT 0 AS k, list(subroot ORDER BY tree) AS l FROM sub
  UNION ALL
  SELECT k + 1, list_transform(range(0, (len(l) + 1) // 2),
    lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))
  FROM over_ WHERE len(l) > 1
), steps AS (
  SELECT doc_id, leaves.tree, k, (pos >> k) % 2 AS side, l[xor(pos >> k, 1) + 1] AS sibling
  FROM leaves JOIN up ON leaves.tree = up.tree AND len(l) > 1
  UNION ALL
  SELECT doc_id, leaves.tree, height + k, (place >> k) % 2, l[xor(place >> k, 1) + 1]
  FROM leaves JOIN sub USING (tree) CROSS JOIN over_ WHERE len(l) > 1
), paths AS (
  SELECT doc_id, list(side ORDER BY k) AS sides, list(coalesce(sibling, '') ORDER BY k) AS siblings
  FROM steps GROUP BY doc_id
), fold AS (
  SELECT doc_id, 0 AS k, sides, siblings, tampered,
    CASE WHEN tampered THEN other ELSE leaf END AS h
  FROM (SELECT leaves.*, sides, siblings, coalesce(xor(4294967295, list_reduce(
          list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
            lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) % 7 = 0, false) AS tampered
        FROM leaves LEFT JOIN paths USING (doc_id))
  UNION ALL
  SELECT doc_id, k + 1, sides, siblings, tampered,
    sha256(CASE WHEN sides[k + 1] = 1 THEN siblings[k + 1] || h ELSE h || siblings[k + 1] END)
  FROM fold WHERE k < coalesce(len(sides), 0)
), root AS (
  SELECT l[1] AS root FROM over_ WHERE len(l) = 1
)
SELECT fold.doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(siblings, ''), '')) AS proof_sha256,
  h AS folded_root, h = root AS verified
FROM fold JOIN leaves USING (doc_id) JOIN sub USING (tree) CROSS JOIN root
WHERE k = coalesce(len(sides), 0)
"""

LLM_ORACLES = {"op4_embeddings": OP4, "op5_exact_dedup": OP5, "op7_line_dedup": OP7, "op11_topk": OP11, "op13_merkle": OP13}
