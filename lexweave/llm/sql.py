"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8232) || chr(8233)"
_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLE: dict[str, str] = {
    "p5_found": f"""SELECT chunk_id AS node_id FROM chunk WHERE length(trim(text, {_WHITE})) > 1200
      UNION ALL SELECT node_id FROM kb_node WHERE length(trim(contenuto, {_WHITE})) > 1200""",
    "p6_found": f"""WITH v AS (SELECT chunk_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM chunk WHERE {_USABLE} UNION ALL SELECT node_id, CAST(embedding AS DOUBLE[]) FROM kb_node WHERE {_USABLE}),
      u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))::DOUBLE[64] AS e FROM v),
      near AS (SELECT a.id AS q, b.id AS n, array_inner_product(a.e, b.e) AS s FROM u a, u b WHERE a.id <> b.id AND array_inner_product(a.e, b.e) >= 0.9),
      best AS (SELECT q, n FROM near QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, n) <= 5)
      SELECT DISTINCT least(q, n) AS node_id_a, greatest(q, n) AS node_id_b FROM best""",
    "p7_found": r"""WITH w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM chunk WHERE text IS NOT NULL),
      s AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS s FROM w WHERE len(w) >= 10),
      e AS (SELECT chunk_id, len(s) AS n, unnest(s) AS x FROM s),
      c AS (SELECT a.chunk_id AS p, b.chunk_id AS q, a.n AS n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.chunk_id < b.chunk_id GROUP BY ALL)
      SELECT p AS chunk_id_a, q AS chunk_id_b FROM c WHERE c >= 0.6 * (n + m - c)""",
    "p7_classes": r"""WITH w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM chunk WHERE text IS NOT NULL),
      k AS (SELECT w, min(chunk_id) AS class_id, count(*) AS copies FROM w WHERE len(w) >= 10 GROUP BY w),
      s AS (SELECT class_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS s FROM k),
      e AS (SELECT class_id, len(s) AS n, unnest(s) AS x FROM s),
      c AS (SELECT a.class_id AS p, b.class_id AS q, a.n AS n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY ALL),
      g AS (SELECT p AS class_id, count(*) AS links FROM c WHERE c >= 0.6 * (n + m - c) GROUP BY p),
      t AS (SELECT chunk_id, class_id, copies FROM w JOIN k USING (w))
      SELECT chunk.chunk_id, t.class_id, coalesce(t.copies, 1) AS copies, coalesce(g.links, 0) AS links FROM chunk LEFT JOIN t ON t.chunk_id = chunk.chunk_id LEFT JOIN g ON g.class_id = t.class_id""",
}
