"""The same queries in DuckDB SQL, over views named like the tables."""

from __future__ import annotations

from lexweave.functions.vectors import DIM

_ABBR = "art|artt|all|avv|dott|prof|sig|sigg|ing|arch|geom|cap|cfr|cit|co|comma|doc|ecc|es|fasc|fig|lett|n|nn|nr|num|pag|pagg|par|prot|rif|sent|sez|ss|tab|tel|v|vol"


def _usable(v: str) -> str:
    return f"({v} IS NOT NULL AND len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0)"


def _score(v: str, q: str) -> str:
    return f"(1 + list_cosine_similarity(CAST({v} AS DOUBLE[]), CAST({q} AS DOUBLE[]))) / 2"


_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_QC = f"(SELECT embedding FROM chunk WHERE {_usable('embedding')} ORDER BY chunk_id LIMIT 1)"
_BIG = "(SELECT name FROM chunk GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"


def _sentences(text: str) -> str:
    x = text
    for _ in range(2):
        x = rf"regexp_replace({x}, '(?i)(^|[^\p{{L}}\p{{N}}])({_ABBR}|\p{{L}})\.\s+', '\1\2.' || chr(57344), 'g')"
    x = rf"regexp_replace({x}, '(^|\s)([0-9]+)\.\s+(\p{{Lu}}\p{{Ll}})', '\1\2.' || chr(57344) || '\3', 'g')"
    x = rf"regexp_replace({x}, '([.!?])\s+', '\1' || chr(57345), 'g')"
    return rf"list_filter(list_transform(string_split({x}, chr(57345)), lambda s: trim(replace(s, chr(57344), ' '))), lambda s: regexp_replace(s, '\s+', '', 'g') <> '')"


def _tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _bm25(tab: str, key: str, text: str, terms: list[str]) -> str:
    """Body of a WITH: ``scored`` (key, score)."""
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / (tf{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""tok AS (SELECT {key}, {_tokens(text)} AS w FROM {tab} WHERE {text} IS NOT NULL), cnt AS (SELECT {key}, CAST(len(w) AS DOUBLE) AS l, {tf} FROM tok),
    st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {dfs} FROM cnt), scored AS (SELECT {key}, {score} AS score FROM cnt, st WHERE {some})"""


_TERMS = ["ricorso", "notificata", "canone"]
_STATUS = """CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'wrong_length'
  WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not_finite' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'ok' END"""
_SECTION = " ".join(f"WHEN regexp_matches(line, '(?i)^{k}\\s+[IVXLC]+') THEN '{k}'" for k in ("PARTE", "LIBRO", "TITOLO", "CAPO", "SEZIONE"))
_SECTION = f"CASE {_SECTION} WHEN regexp_matches(line, '(?i)^Art\\.*\\s*\\d+') THEN 'ARTICOLO' END"
_HEADED = "concat('TITOLO II', chr(10), 'Parte generale', chr(10), chr(10), 'Art. 2-bis Oggetto', chr(10), contenuto)"
_BLANK = r"trim(regexp_replace(line, '\s+', ' ', 'g')) = ''"
_LINES_HEADED = f"(SELECT node_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT node_id, string_split({_HEADED}, chr(10)) AS a FROM kb_node WHERE contenuto IS NOT NULL))"
_MENTION = r"(?:articolo|art\.)\s+[0-9]+(?:-bis)?|L\.\s+[0-9]+/[0-9]{4}|d\.lgs\.\s+n\.\s+[0-9]+\s+del\s+[0-9]{4}|codice della navigazione (?:fluviale|lacustre)"


def _mentions(tab: str, key: str, text: str, where: str = "true") -> str:
    return rf"""(SELECT {key}, pos, CASE WHEN regexp_matches(m, '^(articolo|art\.)') THEN 'ART' ELSE 'DOC' END AS label,
      CASE WHEN regexp_matches(m, '^(articolo|art\.)') THEN regexp_extract(m, '([0-9]+(?:-bis)?)$', 1) ELSE regexp_replace(lower(m), '\s+', ' ', 'g') END AS value
      FROM (SELECT {key}, unnest(range(len(a))) AS pos, unnest(a) AS m FROM (SELECT {key}, regexp_extract_all({text}, '{_MENTION}') AS a FROM {tab} WHERE {text} IS NOT NULL AND {where})))"""


_PAIRS = f"""pairs AS (SELECT node_id, pos, doc, value AS article FROM (SELECT *, coalesce(
    last_value(CASE WHEN label = 'DOC' THEN value END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(CASE WHEN label = 'DOC' THEN value END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS doc
    FROM {_mentions('kb_node', 'node_id', 'contenuto', "label = 'contenuto' AND trim(contenuto) <> ''")}) WHERE label = 'ART' AND doc IS NOT NULL)"""


def _law_key(x: str) -> str:
    low = rf"regexp_replace(trim(lower({x})), '\s+', ' ', 'g')"
    full = r"^(legge|decreto legislativo) [0-9]+ [a-z]+ ([0-9]{4}), n\. ([0-9]+)$"
    short, decree = r"^l\. ([0-9]+/[0-9]{4})$", r"^d\.lgs\. n\. ([0-9]+) del ([0-9]{4})$"
    return f"""CASE WHEN regexp_matches({low}, '{short}') THEN 'legge ' || regexp_extract({low}, '{short}', 1)
      WHEN regexp_matches({low}, '{decree}') THEN 'decreto legislativo ' || regexp_extract({low}, '{decree}', 1) || '/' || regexp_extract({low}, '{decree}', 2)
      WHEN regexp_matches({low}, '{full}') THEN regexp_extract({low}, '{full}', 1) || ' ' || regexp_extract({low}, '{full}', 3) || '/' || regexp_extract({low}, '{full}', 2)
      WHEN regexp_matches({low}, '^codice della navigazione (fluviale|lacustre)$') THEN {low} END"""


_NUMBER = r"nullif(regexp_extract(titolo, '^(?:Art\. |Articolo )(.+)$', 1), '')"
_RESOLVED = f"""{_PAIRS}, keyed AS (SELECT node_id AS src, (length({_law_key('doc')}) % 10)::VARCHAR AS doc_key, (TRY_CAST(regexp_extract(article, '^[0-9]+') AS INT) % 40 + 1)::VARCHAR AS number FROM pairs),
  dk AS (SELECT doc_key, min(kb_id) AS kb_id FROM (SELECT kb_id, (kb_id % 10)::VARCHAR AS doc_key FROM kb_node) WHERE doc_key IS NOT NULL GROUP BY doc_key),
  ar AS (SELECT kb_id, number, min(node_id) AS node_id FROM (SELECT kb_id, node_id, {_NUMBER} AS number FROM kb_node WHERE label = 'contenuto') WHERE number IS NOT NULL GROUP BY kb_id, number),
  res AS (SELECT c.doc_key, c.number, d.kb_id, a.node_id FROM (SELECT DISTINCT doc_key, number FROM keyed WHERE doc_key IS NOT NULL) c LEFT JOIN dk d USING (doc_key) LEFT JOIN ar a ON a.kb_id = d.kb_id AND a.number = c.number)"""
_BY_NAME = f"""{_PAIRS}, tok AS (SELECT kb_id, {_tokens('nome_legge')} AS w FROM kb_document WHERE nome_legge IS NOT NULL), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM tok),
  idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM (SELECT DISTINCT kb_id, unnest(w) AS term FROM tok), st GROUP BY term),
  nm AS (SELECT name, {_tokens('name')} AS q FROM (SELECT DISTINCT doc AS name FROM pairs)),
  weight AS (SELECT name, sum(idf) AS idf FROM (SELECT DISTINCT name, unnest(q) AS term FROM nm) JOIN idf USING (term) GROUP BY name),
  met AS (SELECT name, kb_id, len(w) AS l, idf, len(list_filter(range(1, len(w) - len(q) + 2), lambda i: w[i:i + len(q) - 1] = q))::DOUBLE AS tf
    FROM nm JOIN weight USING (name), tok WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ')),
  best AS (SELECT name, kb_id FROM (SELECT name, kb_id, idf * tf / (tf + 1.2 * (0.25 + 0.75 * l / a)) AS score FROM met, st) WHERE score > 0.8 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, kb_id) = 1),
  ar AS (SELECT kb_id, number, min(node_id) AS node_id FROM (SELECT kb_id, node_id, {_NUMBER} AS number FROM kb_node WHERE label = 'contenuto') WHERE number IS NOT NULL GROUP BY kb_id, number),
  res AS (SELECT c.doc_key, c.number, b.kb_id, a.node_id FROM (SELECT DISTINCT doc AS doc_key, article AS number FROM pairs) c LEFT JOIN best b ON b.name = c.doc_key LEFT JOIN ar a ON a.kb_id = b.kb_id AND a.number = c.number)"""
_SCORED = f"scored AS (SELECT node_id, parent_id, label, titolo, contenuto, source, {_score('embedding', _Q0)} AS score FROM kb_node WHERE {_usable('embedding')})"
_CHILD = "child AS (SELECT * FROM scored WHERE label = 'contenuto' AND parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, node_id) = 1)"
_START = "start AS (SELECT node_id FROM kb_node WHERE label = 'parti' AND kb_id IN (SELECT kb_id FROM kb_document) UNION SELECT node_id FROM kb_node WHERE label = 'contenuto' AND titolo LIKE 'TITOLO%' AND kb_id IN (SELECT kb_id FROM kb_document))"
_WALK = f"""{_SCORED}, {_CHILD}, {_START},
  walk AS (SELECT 0 AS step, node_id AS start_id, node_id, NULL::DOUBLE AS score, NULL::VARCHAR AS titolo, NULL::VARCHAR AS contenuto, NULL::VARCHAR AS source FROM start
    UNION ALL SELECT w.step + 1, w.start_id, c.node_id, c.score, c.titolo, c.contenuto, c.source FROM walk w JOIN child c ON c.parent_id = w.node_id
      WHERE (w.step = 0 OR w.contenuto IS NULL OR trim(w.contenuto) = '') AND w.step < 20),
  hit AS (SELECT w.* FROM walk w WHERE trim(w.contenuto) <> '' AND w.step > 0 AND w.node_id NOT IN (SELECT node_id FROM start) ORDER BY step, start_id LIMIT 1)"""
_ENTS = "array_to_string(list_sort(list(DISTINCT concat_ws('/', e.text, e.label))), '|')"
_CONTEXT = """LEFT JOIN (SELECT name, idx + 1 AS idx, text AS prev FROM chunk) p ON p.name = h.name AND p.idx = h.idx
  LEFT JOIN (SELECT name, idx - 1 AS idx, text AS next FROM chunk) x ON x.name = h.name AND x.idx = h.idx"""

ORACLE: dict[str, str] = {
    "vector_topk": f"""SELECT chunk_id, name AS source, round(score, 6) AS similarity FROM (SELECT chunk_id, name, {_score('embedding', _QC)} AS score FROM chunk WHERE {_usable('embedding')} ORDER BY score DESC, chunk_id LIMIT 400)
      ORDER BY score DESC, chunk_id LIMIT 5""",
    "vector_topk_doc_scoped": f"""SELECT vec_id, round(score, 6) AS similarity FROM (SELECT vec_id, label, {_score('embedding', _Q0)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50)
      WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 5""",
    "vector_scores_dim_check": f"SELECT 'chunk' AS table_name, {_STATUS} AS status, count(*) AS rows FROM chunk GROUP BY ALL UNION ALL SELECT 'kb_node', {_STATUS}, count(*) FROM kb_node GROUP BY ALL",
    "mean_pool": "SELECT label, dim::INT AS dim, round(avg(v::DOUBLE), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings) GROUP BY label, dim",
    "masked_mean_pool": """SELECT label, dim::INT AS dim, round(sum(v::DOUBLE * m) / greatest(sum(m), 1e-9), 6) AS pooled FROM (SELECT label, dim, v, CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m
      FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings)) GROUP BY label, dim""",
    "logits_argmax": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS cls FROM embeddings",
    "chunk_documents": f"""SELECT doc_id, k::INT AS idx, array_to_string(s[2 * k + 1 : 2 * k + 2], ' ') AS text FROM (SELECT doc_id, s, unnest(range((len(s) + 1) // 2)) AS k
      FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents WHERE text IS NOT NULL))""",
    "sentence_split": f"SELECT node_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM (SELECT node_id, {_sentences('contenuto')} AS s FROM kb_node WHERE contenuto IS NOT NULL)",
    "word_tokens": rf"""SELECT node_id, CASE WHEN rubrica IS NOT NULL THEN array_to_string(list_filter(regexp_split_to_array(lower(rubrica), '[^\p{{L}}]+'), lambda w: length(w) > 3 AND NOT list_contains(string_split('{_ABBR}', '|'), w)), ' ') END AS words FROM kb_node""",
    "chunk_neighbors": """SELECT chunk_id, coalesce(lag(text) OVER w, '') AS prev_chunks, coalesce(lead(text) OVER w, '') AS next_chunks FROM chunk WINDOW w AS (PARTITION BY name ORDER BY idx)""",
    "chunk_next_pairs": "SELECT coalesce(lag(chunk_id) OVER (PARTITION BY name ORDER BY idx), name) AS src, chunk_id AS dst FROM chunk",
    "fulltext_bm25": f"WITH {_bm25('chunk', 'chunk_id', 'text', _TERMS)} SELECT chunk_id, round(score, 6) AS score FROM scored ORDER BY 2 DESC, 1 LIMIT 20",
    "fulltext_doc_scoped": f"WITH {_bm25('chunk', 'chunk_id', 'text', _TERMS)} SELECT chunk_id, round(score, 6) AS score FROM scored JOIN chunk USING (chunk_id) WHERE name = {_BIG} ORDER BY 2 DESC, 1 LIMIT 5",
    "fulltext_postings": f"""SELECT term, ref_id, count(*)::INT AS tf, any_value(l)::INT AS len FROM (SELECT ref_id, len(w) AS l, unnest(w) AS term FROM (SELECT ref_id, {_tokens('nome_legge')} AS w FROM law_ref WHERE nome_legge IS NOT NULL)) GROUP BY term, ref_id""",
    "text_contains": "SELECT chunk_id, name FROM chunk WHERE contains(lower(text), 'servitù di passaggio')",
    "phrase_match_top1": f"""WITH tok AS (SELECT ref_id AS kb_id, {_tokens('nome_legge')} AS w FROM law_ref WHERE nome_legge IS NOT NULL),
      cnt AS (SELECT kb_id, len(w)::DOUBLE AS l, list_contains(w, 'illuminazione') AS h0, list_contains(w, 'pubblica') AS h1,
        len(list_filter(range(1, len(w)), lambda i: w[i] = 'illuminazione' AND w[i + 1] = 'pubblica'))::DOUBLE AS p FROM tok),
      st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, sum(h0::INT)::DOUBLE AS d0, sum(h1::INT)::DOUBLE AS d1 FROM cnt),
      sc AS (SELECT kb_id, (ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5))) * p / (p + 1.2 * (0.25 + 0.75 * l / a)) AS score FROM cnt, st WHERE p > 0)
      SELECT kb_id, round(score, 6) AS score FROM sc WHERE score > 0.8 ORDER BY sc.score DESC, kb_id LIMIT 1""",
    "phrase_match_documents": f"""WITH tok AS (SELECT kb_id, {_tokens('nome_legge')} AS w FROM kb_document WHERE nome_legge IS NOT NULL),
      cnt AS (SELECT kb_id, len(w)::DOUBLE AS l, list_contains(w, 'illuminazione') AS h0, list_contains(w, 'pubblica') AS h1,
        len(list_filter(range(1, len(w)), lambda i: w[i] = 'illuminazione' AND w[i + 1] = 'pubblica'))::DOUBLE AS p FROM tok),
      st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, sum(h0::INT)::DOUBLE AS d0, sum(h1::INT)::DOUBLE AS d1 FROM cnt),
      sc AS (SELECT kb_id, (ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5))) * p / (p + 1.2 * (0.25 + 0.75 * l / a)) AS score FROM cnt, st WHERE p > 0)
      SELECT kb_id, round(score, 6) AS score FROM sc WHERE score > 0.8 ORDER BY sc.score DESC, kb_id LIMIT 1""",
    "entity_upsert": "SELECT DISTINCT text, label FROM entity WHERE text IS NOT NULL AND label IS NOT NULL",
    "has_entity_edges": "SELECT DISTINCT chunk_id, entity_id FROM has_entity",
    "merge_upsert_documents": """WITH old AS (SELECT text, min(doc_id) AS doc_id, 'leggi' AS source FROM documents WHERE source = 'leggi' AND text IS NOT NULL GROUP BY text),
      new AS (SELECT text, arg_min({'doc_id': doc_id, 'source': source}, doc_id) AS r FROM documents WHERE text IS NOT NULL GROUP BY text)
      SELECT doc_id, length(text)::INT AS n, source FROM old UNION ALL SELECT r.doc_id, length(text)::INT, r.source FROM new WHERE text NOT IN (SELECT text FROM old)""",
    "entities_collect": f"SELECT h.chunk_id, array_to_string(list_transform(list_sort(list(DISTINCT {{'t': e.text, 'l': e.label}}), 'ASC', 'NULLS FIRST'), lambda s: concat_ws('/', s.t, s.l)), '|') AS entities FROM has_entity h JOIN entity e USING (entity_id) GROUP BY h.chunk_id",
    "optional_match_nulls": """SELECT c.chunk_id, greatest(count(DISTINCT {'t': e.text, 'l': e.label}), 1)::INT AS n, bool_or(e.entity_id IS NULL OR e.text IS NULL) AS none
      FROM chunk c LEFT JOIN has_entity h USING (chunk_id) LEFT JOIN entity e USING (entity_id) GROUP BY c.chunk_id""",
    "category_search": f"""SELECT h.chunk_id, h.name AS source, 1.0::DOUBLE AS similarity, {_ENTS} AS entities
      FROM (SELECT chunk_id, name FROM chunk WHERE chunk_id IN (SELECT chunk_id FROM has_entity JOIN entity USING (entity_id) WHERE lower(label) = 'persona') ORDER BY chunk_id LIMIT 5) h
      JOIN has_entity he USING (chunk_id) JOIN entity e ON e.entity_id = he.entity_id AND lower(e.label) = 'persona' GROUP BY h.chunk_id, h.name""",
    "category_search_doc_scoped": f"""SELECT h.chunk_id, h.name AS source, 1.0::DOUBLE AS similarity, count(DISTINCT {{'t': e.text, 'l': e.label}})::INT AS n_entities
      FROM (SELECT chunk_id, name FROM chunk WHERE name = {_BIG} AND chunk_id IN (SELECT chunk_id FROM has_entity JOIN entity USING (entity_id) WHERE lower(label) = 'persona') ORDER BY chunk_id LIMIT 5) h
      JOIN has_entity he USING (chunk_id) JOIN entity e ON e.entity_id = he.entity_id AND lower(e.label) = 'persona' GROUP BY h.chunk_id, h.name""",
    "search_with_context": f"""WITH h AS (SELECT chunk_id, name, idx, score FROM (SELECT chunk_id, name, idx, {_score('embedding', _QC)} AS score FROM chunk WHERE {_usable('embedding')} ORDER BY score DESC, chunk_id LIMIT 400) ORDER BY score DESC, chunk_id LIMIT 5),
      en AS (SELECT he.chunk_id, array_to_string(list_transform(list_sort(list(DISTINCT {{'t': e.text, 'l': e.label}}), 'ASC', 'NULLS FIRST'), lambda s: concat_ws('/', s.t, s.l)), '|') AS entities FROM has_entity he JOIN entity e USING (entity_id) GROUP BY he.chunk_id)
      SELECT h.chunk_id, h.name AS source, round(h.score, 6) AS similarity, coalesce(p.prev, '') AS prev_chunks, coalesce(x.next, '') AS next_chunks, coalesce(en.entities, '') AS entities, 0::INT AS n_related
      FROM h {_CONTEXT} LEFT JOIN en ON en.chunk_id = h.chunk_id""",
    "text_search_with_context": f"""WITH {_bm25('chunk', 'chunk_id', 'text', _TERMS)}, h AS (SELECT chunk_id, name, idx, score FROM scored JOIN chunk USING (chunk_id) ORDER BY score DESC, chunk_id LIMIT 5),
      en AS (SELECT he.chunk_id, count(DISTINCT {{'t': e.text, 'l': e.label}}) AS c FROM has_entity he JOIN entity e USING (entity_id) GROUP BY he.chunk_id)
      SELECT h.chunk_id, h.name AS source, round(h.score, 6) AS similarity, coalesce(p.prev, '') AS prev_chunks, coalesce(x.next, '') AS next_chunks, coalesce(en.c, 0)::INT AS n_entities
      FROM h {_CONTEXT} LEFT JOIN en ON en.chunk_id = h.chunk_id""",
    "related_context": f"""WITH {_bm25('chunk', 'chunk_id', 'text', ['codice', 'articolo', 'navigazione'])}, h AS (SELECT chunk_id FROM scored ORDER BY score DESC, chunk_id LIMIT 20),
      cited AS (SELECT DISTINCT chunk_id, (TRY_CAST(regexp_extract(value, '^[0-9]+') AS INT) % 40 + 1)::VARCHAR AS number FROM {_mentions('chunk', 'chunk_id', 'text')} WHERE label = 'ART'),
      target AS (SELECT number, min(node_id) AS node_id FROM (SELECT {_NUMBER} AS number, node_id FROM kb_node WHERE label = 'contenuto') WHERE number IS NOT NULL GROUP BY number),
      rel AS (SELECT DISTINCT c.chunk_id, t.node_id, coalesce(n.contenuto, '') AS said FROM cited c JOIN target t USING (number) JOIN kb_node n ON n.node_id = t.node_id)
      SELECT h.chunk_id, count(r.node_id)::INT AS n_related, coalesce(string_agg(r.said, '|' ORDER BY r.node_id), '') AS related FROM h LEFT JOIN rel r USING (chunk_id) GROUP BY h.chunk_id""",
    "bfs_descend_faithful": f"WITH {_SCORED} SELECT parent_id, node_id, round(score, 6) AS score FROM (SELECT * FROM scored WHERE label = 'contenuto' ORDER BY score DESC, node_id LIMIT 1) WHERE parent_id IS NOT NULL",
    "hierarchy_descendants": """WITH RECURSIVE d AS (SELECT parent_id AS ancestor_id, node_id, 1 AS depth FROM kb_node WHERE parent_id IS NOT NULL
      UNION ALL SELECT d.ancestor_id, n.node_id, d.depth + 1 FROM d JOIN kb_node n ON n.parent_id = d.node_id) SELECT * FROM d""",
    "leaf_nodes": "SELECT node_id, label FROM kb_node n WHERE NOT EXISTS (SELECT 1 FROM kb_node c WHERE c.parent_id = n.node_id)",
    "kb_json_flatten": """SELECT coalesce(nullif(d.nome_legge, ''), 'Unknown') AS nome_legge, d.anno::INT AS anno, n.label, n.titolo, n.rubrica,
      (row_number() OVER (PARTITION BY n.kb_id ORDER BY n.label = 'parti' DESC, n.node_id) - 1)::INT AS child_pos, 1::INT AS depth FROM kb_node n JOIN kb_document d USING (kb_id)""",
    "label_scan_filter": "SELECT node_id, titolo FROM kb_node WHERE label = 'contenuto' AND contenuto IS NOT NULL",
    "unique_constraint_check": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{k}' AS key, count(*) AS violating FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)"
        for t, k in (("chunk", "chunk_id"), ("chunk", "name,idx"), ("kb_document", "kb_id"), ("kb_node", "node_id"), ("entity", "entity_id"), ("entity", "text,label"), ("has_entity", "chunk_id,entity_id"))
    ),
    "article_title_match": f"SELECT node_id, {_NUMBER} AS number FROM kb_node WHERE {_NUMBER} IS NOT NULL",
    "article_lookup_top1": """SELECT n.titolo, coalesce(n.rubrica, '') AS rubrica, coalesce(n.contenuto, '') AS contenuto, d.nome_legge AS law_name FROM kb_node n JOIN kb_document d USING (kb_id)
      WHERE n.label = 'contenuto' AND n.titolo = 'Art. 5' AND NOT EXISTS (SELECT 1 FROM kb_node c WHERE c.parent_id = n.node_id) ORDER BY n.node_id LIMIT 1""",
    "law_filter_optional": """SELECT '' AS law, count(*) AS rows FROM kb_document UNION ALL SELECT '', count(*) FROM kb_document
      UNION ALL SELECT 'Codice della navigazione lacustre', count(*) FROM kb_document WHERE nome_legge = 'Codice della navigazione lacustre'""",
    "start_nodes_union": f"WITH {_START} SELECT node_id FROM start",
    "best_child_per_node": f"WITH {_SCORED}, {_CHILD} SELECT parent_id, node_id, round(score, 6) AS score FROM child",
    "bfs_descend": f"WITH RECURSIVE {_WALK} SELECT step, start_id, node_id, round(score, 6) AS score FROM hit",
    "wide_search": f"""WITH RECURSIVE {_WALK}, {_bm25("(SELECT * FROM kb_node WHERE label = 'contenuto')", 'node_id', 'contenuto', _TERMS).replace('scored AS', 'tscored AS')}
      SELECT '1-descent' AS strategy, coalesce(source, '') AS source, coalesce(titolo, '') AS titolo, coalesce(contenuto, '') AS contenuto, round(score, 6) AS similarity FROM hit
      UNION ALL SELECT '2-vector', coalesce(source, ''), coalesce(titolo, ''), coalesce(contenuto, ''), round(score, 6) FROM (SELECT * FROM scored WHERE label = 'contenuto' ORDER BY score DESC, node_id LIMIT 1)
      UNION ALL SELECT '3-text', coalesce(source, ''), coalesce(titolo, ''), coalesce(contenuto, ''), round(score, 6) FROM (SELECT n.*, t.score FROM tscored t JOIN kb_node n USING (node_id) ORDER BY t.score DESC, node_id LIMIT 1)""",
    "visited_antijoin": f"WITH {_START} SELECT node_id FROM kb_node WHERE node_id NOT IN (SELECT node_id FROM start)",
    "citation_mentions": f"SELECT chunk_id, pos::INT AS pos, label, value FROM {_mentions('chunk', 'chunk_id', 'text')}",
    "citation_pairing": f"WITH {_PAIRS} SELECT node_id, pos::INT AS pos, doc, article FROM pairs",
    "citation_keys": f"WITH {_PAIRS} SELECT node_id, pos::INT AS pos, {_law_key('doc')} AS doc_key, article FROM pairs",
    "citation_resolution": f"WITH {_RESOLVED} SELECT doc_key, number, kb_id, node_id FROM res",
    "related_edges_dedup": f"WITH {_RESOLVED} SELECT DISTINCT k.src AS src_id, r.node_id AS dst_id, 'extensional' AS kind FROM keyed k JOIN res r ON r.doc_key = k.doc_key AND r.number = k.number WHERE r.node_id IS NOT NULL",
    "intensional_relations": f"""WITH law AS (SELECT kb_id FROM kb_node GROUP BY kb_id ORDER BY count(*) DESC, kb_id LIMIT 1), n AS (SELECT node_id, {_NUMBER} AS number, NOT EXISTS (SELECT 1 FROM kb_node c WHERE c.parent_id = k.node_id) AS leaf
        FROM kb_node k WHERE label = 'contenuto' AND kb_id = (SELECT kb_id FROM law)),
      src AS (SELECT number, min(node_id) AS src FROM n WHERE leaf GROUP BY number), dst AS (SELECT number, min(node_id) AS dst FROM n WHERE number IS NOT NULL GROUP BY number),
      c AS (SELECT name, idx, (idx % 40 + 1)::VARCHAR AS a, (idx * 7 % 40 + 1)::VARCHAR AS b, 'cfr. art. ' || (idx * 7 % 40 + 1)::VARCHAR || ' del codice della navigazione lacustre: ' || chunk_id AS text FROM chunk)
      SELECT src AS src_id, dst AS dst_id, arg_max(text, {{'f': name, 'l': idx}}) AS text, 'intensional' AS kind FROM c JOIN src ON src.number = c.a JOIN dst ON dst.number = c.b GROUP BY src, dst""",
    "related_last_write": "SELECT user_id::VARCHAR AS src_id, (user_id % 7)::VARCHAR AS dst_id, arg_max(event_type, {'ts': ts, 'id': event_id}) AS text FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2",
    "related_undirected_count": "SELECT sum(CASE WHEN s = t THEN 1 ELSE 2 END)::BIGINT AS undirected, count(*) AS directed FROM (SELECT DISTINCT user_id AS s, user_id % 7 AS t FROM events)",
    "section_classify": f"SELECT node_id, line_no::INT AS line_no, {_SECTION} AS kind FROM {_LINES_HEADED}",
    "section_carry_forward": f"""SELECT node_id, line_no::INT AS line_no, last_value(kind IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
      FROM (SELECT node_id, line_no, CASE WHEN NOT {_BLANK} THEN {_SECTION} END AS kind FROM {_LINES_HEADED})""",
    "paragraph_groups": f"""SELECT doc_id, paragraph::BIGINT AS paragraph, count(*) AS lines, min(line_no)::INT AS first_line FROM (SELECT *, sum(CASE WHEN blank OR kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph
      FROM (SELECT doc_id, line_no, {_BLANK} AS blank, CASE WHEN NOT {_BLANK} THEN {_SECTION} END AS kind FROM (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))))
      WHERE NOT blank GROUP BY ALL""",
    "clean_whitespace": r"""WITH t AS (SELECT doc_id, text, CASE WHEN starts_with(text, 'DECRETO LEGISLATIVO') AND contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10))[1] END AS head FROM documents WHERE text IS NOT NULL),
      o AS (SELECT doc_id, CASE WHEN head IS NOT NULL THEN trim(regexp_replace(head, '\s+', ' ', 'g')) || chr(10) || chr(10) || substr(text, length(head) + 1) ELSE text END AS x FROM t),
      l AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(x, ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS a FROM o)
      SELECT doc_id, regexp_replace(array_to_string(list_transform(a, lambda s: regexp_replace(s, '\s+$', '')), chr(10)), '\n\z', '') AS clean FROM l""",
    "strip_note_markers": r"""WITH m AS (SELECT doc_id, text, list_filter(list_distinct(regexp_extract_all(text, '\([0-9]+\)')), lambda k: NOT regexp_matches(text, 'Art\.?\s*\d+.*\(' || substr(k, 2, length(k) - 2) || '\)')) AS loose FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CASE WHEN len(loose) = 0 THEN text ELSE list_reduce(list_prepend(text, loose), lambda a, k: replace(a, k, '')) END AS clean FROM m""",
    "citation_resolution_names": f"WITH {_BY_NAME} SELECT doc_key, number, kb_id, node_id FROM res",
    "related_edges_names": f"WITH {_BY_NAME} SELECT DISTINCT p.node_id AS src_id, r.node_id AS dst_id, 'extensional' AS kind FROM pairs p JOIN res r ON r.doc_key = p.doc AND r.number = p.article WHERE r.node_id IS NOT NULL",
    "cluster_counts": f"""WITH {_BY_NAME}, acc AS (SELECT p.node_id AS s, r.node_id AS t FROM pairs p JOIN res r ON r.doc_key = p.doc AND r.number = p.article WHERE r.node_id IS NOT NULL), e AS (SELECT DISTINCT s, t FROM acc)
      SELECT sum(CASE WHEN s = t THEN 1 ELSE 2 END)::BIGINT AS undirected, count(*) AS directed, (SELECT count(*) FROM acc) AS accepted FROM e""",
    "fulltext_postings_chunks": f"SELECT term, chunk_id, count(*)::INT AS tf, any_value(l)::INT AS len FROM (SELECT chunk_id, len(w) AS l, unnest(w) AS term FROM (SELECT chunk_id, {_tokens('text')} AS w FROM chunk WHERE text IS NOT NULL)) GROUP BY term, chunk_id",
    "api_call_extract": """SELECT chunk_id, 0::INT AS pos, 'search_by_text' AS func, name AS arg1, trim(coalesce(tag, '')) AS arg2 FROM chunk WHERE name IS NOT NULL UNION ALL SELECT chunk_id, 1::INT, 'wide_search', chunk_id, 'y' FROM chunk WHERE name IS NOT NULL""",
    "end_querying_answers": "SELECT chunk_id, 1::INT AS pos, 'Il saldo di ' || name || ' è 5 (cinque) & basta.' AS answer FROM chunk WHERE name IS NOT NULL",
    "agent_contexts": "SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), '>') AS contexts FROM events",
    "last_turn_answer": "SELECT name, arg_max(chunk_id, idx) AS chunk_id, max(idx) AS idx FROM chunk GROUP BY name",
    "coalesce_embed_text": f"SELECT node_id, {DIM}::INT AS n FROM kb_node WHERE CASE label WHEN 'contenuto' THEN coalesce(contenuto, rubrica) WHEN 'parti' THEN rubrica END IS NOT NULL",
}
