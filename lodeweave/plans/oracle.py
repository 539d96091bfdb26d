"""SQL for each query of plans.queries, written for DuckDB and on its own terms."""

from __future__ import annotations

STOP = "'the','and','for','with','that','this','into','from','your','task','flow','file'"

FILES = """files AS (SELECT doc_id, lang, source, 'docs/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path,
  octet_length(encode(coalesce(text, ''))) AS size, 1700000000000.0::DOUBLE + (doc_id % 1000) * 3600000.0::DOUBLE AS modified_at_ms, coalesce(text, '') AS content FROM documents),
facts AS (SELECT doc_id, path, size, content, CASE WHEN (SELECT max(modified_at_ms) FROM files) - modified_at_ms = 0 THEN 5.0::DOUBLE
  ELSE greatest(0.0::DOUBLE, 5.0::DOUBLE - ((SELECT max(modified_at_ms) FROM files) - modified_at_ms) / 86400000.0::DOUBLE) END AS recency, 2.0::DOUBLE AS importance, ceil(size / 4)::BIGINT AS token_cost FROM files)"""

CHUNKS = r"""lines AS (SELECT path, regexp_split_to_array(content, '\r?\n') AS l FROM files),
cut AS (SELECT path, i + 1 AS start_line, least(i + 12, len(l)) AS end_line, regexp_replace(array_to_string(l[i + 1 : i + 12], chr(10)), '^\s+|\s+$', '', 'g') AS text
  FROM (SELECT path, l, unnest(range(0, len(l), 12)) AS i FROM lines)),
chunks AS (SELECT path || '#' || start_line || '-' || end_line AS id, path AS file_path, 'doc' AS kind, start_line::INT AS start_line, end_line::INT AS end_line, ceil(length(text) / 4)::BIGINT AS token_estimate, text FROM cut WHERE text <> '')"""

TEXTS = """texts AS (SELECT 'b' || item_id AS task_id, coalesce(text, '') AS text FROM benchmark
  UNION ALL SELECT 'c' || conv_id || '-' || turn, coalesce(text, '') FROM conversations WHERE role = 'user')"""

TASKS = """texts AS (SELECT item_id AS task_id, 'review documentation of src' || item_id % 20 || ' ' || coalesce(text, '') AS text, CASE WHEN item_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS target FROM benchmark)"""

TERMS = f"""parts AS (SELECT task_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term, generate_subscripts(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 1) AS pos FROM texts),
terms AS (SELECT task_id, term, (row_number() OVER (PARTITION BY task_id ORDER BY min(pos)) - 1)::INT AS ord FROM parts WHERE length(term) >= 3 AND term NOT IN ({STOP}) GROUP BY task_id, term)"""

GRAMS = """grams AS (SELECT task_id, gram, count(*) AS m FROM (SELECT task_id, term AS gram FROM terms WHERE length(term) < 4
  UNION ALL SELECT task_id, substr(term, i::INT, 3) FROM (SELECT task_id, term, unnest(range(1, length(term) - 1)) AS i FROM terms WHERE length(term) >= 4)) GROUP BY ALL)"""

SEMANTIC = """tok AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM chunks) WHERE length(token) >= 2 GROUP BY ALL),
norms AS (SELECT id, sum(n * n) AS text_norm FROM tok GROUP BY id),
per_task AS (SELECT task_id, count(*) AS n_terms FROM terms GROUP BY 1),
gram_norm AS (SELECT task_id, sum(m * m) AS g FROM grams GROUP BY 1),
gram_dot AS (SELECT task_id, sum(m) AS d FROM grams JOIN terms USING (task_id) WHERE gram = term GROUP BY 1),
held AS (SELECT task_id, id, count(*) AS k FROM terms, chunks WHERE contains(lower(text), term) OR contains(lower(file_path), term) GROUP BY ALL),
dots AS (SELECT task_id, id, sum(n) AS d FROM tok JOIN terms ON token = term GROUP BY ALL),
crosses AS (SELECT task_id, id, sum(2 * n * m) AS c FROM tok JOIN grams ON token = gram GROUP BY ALL),
scored AS (SELECT t.task_id, c.id, file_path, kind, start_line, end_line, token_estimate,
  coalesce((coalesce(dots.d, 0) + coalesce(gd.d, 0)) / (sqrt(t.n_terms::DOUBLE) * sqrt((coalesce(text_norm, 0) + gn.g + coalesce(crosses.c, 0))::DOUBLE)), 0)
  + list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(0, coalesce(k, 0)), lambda i: 0.1::DOUBLE)), lambda a, b: a + b) AS score
  FROM per_task t CROSS JOIN chunks c JOIN gram_norm gn USING (task_id) LEFT JOIN gram_dot gd USING (task_id) LEFT JOIN norms ON norms.id = c.id
  LEFT JOIN held ON held.task_id = t.task_id AND held.id = c.id LEFT JOIN dots ON dots.task_id = t.task_id AND dots.id = c.id LEFT JOIN crosses ON crosses.task_id = t.task_id AND crosses.id = c.id),
hits AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, file_path, start_line)::INT AS rank FROM scored WHERE score > 0.18 QUALIFY rank <= 16),
sem AS (SELECT task_id, file_path AS path, max(score) * 0.92::DOUBLE AS semantic_score,
  'Semantic vector match from chunks ' || array_to_string(list(start_line || '-' || end_line ORDER BY rank)[1:3], ', ') AS reason, list_min(list(token_estimate ORDER BY rank)[1:3]) AS m_cost, list(id ORDER BY rank)[1:3] AS m_ids FROM hits GROUP BY ALL),
semantic AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY semantic_score DESC, path)::INT AS rank FROM sem QUALIFY rank <= 8)"""

SEEDS = """matched AS (SELECT task_id, path, list(term ORDER BY ord) AS found FROM terms, facts WHERE contains(path, term) OR contains(path[-12:], term) GROUP BY ALL),
named AS (SELECT task_id, path, sum(CASE WHEN contains(path, term) THEN 6 ELSE 0 END + CASE WHEN contains(path[-12:], term) THEN 5 ELSE 0 END) AS points,
  string_agg(CASE WHEN contains(path[-12:], term) THEN 'Path matches "' || term || '"; Symbol matches "' || term || '"' ELSE 'Path matches "' || term || '"' END, '; ' ORDER BY ord) AS why
  FROM terms, facts WHERE contains(path, term) GROUP BY ALL),
all_scores AS (SELECT t.task_id, f.path, (coalesce(points, 0) + 4)::DOUBLE AS score, concat_ws('; ', why, 'Documentation matches task intent') AS reason
  FROM texts t CROSS JOIN facts f LEFT JOIN named ON named.task_id = t.task_id AND named.path = f.path),
seeds AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path)::INT AS seed_rank FROM all_scores QUALIFY seed_rank <= 5)"""

EDGES = """up AS (SELECT c.path AS src, p.path AS dst FROM files c JOIN files p ON p.doc_id = c.doc_id // 10 WHERE c.doc_id >= 10),
edges AS (SELECT src, dst, kind, max(weight) AS weight FROM (SELECT src, dst, 'import' AS kind, 5 AS weight FROM up UNION ALL SELECT dst, src, 'caller', 3 FROM up UNION ALL SELECT src, dst, 'callee', 3 FROM up) GROUP BY ALL),
steps AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY kind, dst) AS ord FROM edges)"""

WALKS = """w1 AS (SELECT task_id, seed_rank, s.path AS seed, s.score AS base, e.dst AS path, 1 AS distance, e.ord AS o1, 0 AS o2, greatest(1, s.score - 2 + weight) AS score, 'dependency' AS role, 2 AS n FROM seeds s JOIN steps e ON e.src = s.path),
w2 AS (SELECT task_id, seed_rank, seed, base, e.dst AS path, 2 AS distance, o1, e.ord AS o2, greatest(1, base - 4 + weight) AS score, 'semantic-support' AS role, 3 AS n FROM w1 JOIN steps e ON e.src = w1.path),
events AS (SELECT task_id, path, 0 AS seed_rank, 0 AS distance, seed_rank AS o1, 0 AS o2, score, 'primary' AS role, 1 AS n FROM seeds
  UNION ALL SELECT task_id, path, seed_rank, distance, o1, o2, score, role, n FROM w1 UNION ALL SELECT task_id, path, seed_rank, distance, o1, o2, score, role, n FROM w2),
structural AS (SELECT *, row_number() OVER (PARTITION BY task_id, path ORDER BY score DESC, seed_rank, distance, o1, o2) AS pick FROM events QUALIFY pick = 1)"""

RANKED = """lists AS (SELECT file_path AS path, count(*) AS n_all FROM chunks GROUP BY 1),
both_sides AS (SELECT coalesce(s.task_id, m.task_id) AS task_id, coalesce(s.path, m.path) AS path, s.path IS NOT NULL AS here, m.path IS NOT NULL AS there, s.score AS s_score, s.role AS s_role, s.distance AS s_distance, s.n AS s_n,
  semantic_score, m_cost, m_ids FROM structural s FULL JOIN semantic m ON m.task_id = s.task_id AND m.path = s.path),
merged AS (SELECT task_id, b.path, here, there, coalesce(s_score, 0)::DOUBLE AS structural_score, coalesce(semantic_score, 0)::DOUBLE AS semantic_score,
  CASE WHEN here THEN 'structural' ELSE 'semantic' END AS source, CASE WHEN here THEN s_role ELSE 'semantic-support' END AS role,
  CASE WHEN NOT here THEN 'semantic' WHEN s_distance = 0 THEN 'seed' ELSE 'graph' END AS stage, CASE WHEN here AND there THEN least(s_distance, 2) WHEN here THEN s_distance ELSE 2 END AS dependency_distance,
  CASE WHEN here AND there THEN least(token_cost, m_cost) WHEN here THEN token_cost ELSE m_cost END AS token_cost, CASE WHEN here THEN coalesce(n_all, 0) ELSE len(m_ids) END AS n_chunks,
  CASE WHEN here AND there THEN 1 WHEN here THEN s_n ELSE 1 END AS n_path, recency, importance FROM both_sides b JOIN facts f ON f.path = b.path LEFT JOIN lists ON lists.path = b.path),
final AS (SELECT *, CASE WHEN structural_score > 0 THEN structural_score + greatest(0, 3 - dependency_distance) ELSE 0.0::DOUBLE END + structural_score * 1.4::DOUBLE + semantic_score * 1.1::DOUBLE + dependency_distance * -1.1::DOUBLE
  + recency * 0.4::DOUBLE + importance * 0.5::DOUBLE + token_cost * -0.08::DOUBLE + -1.0::DOUBLE AS score FROM merged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path)::INT AS rank FROM final QUALIFY rank <= 12)"""

_ALL = ",\n".join([FILES, CHUNKS, TASKS, TERMS, GRAMS, SEMANTIC, SEEDS, EDGES, WALKS, RANKED])

REASONS = """told AS (SELECT *, row_number() OVER (PARTITION BY task_id, path ORDER BY seed_rank, distance, o1, o2) AS spot FROM (
  SELECT task_id, path, 0 AS seed_rank, 0 AS distance, seed_rank AS o1, 0 AS o2, score, reason FROM seeds
  UNION ALL SELECT s.task_id, e.dst, s.seed_rank, 1, e.ord, 0, greatest(1, s.score - 2 + e.weight), CASE e.kind WHEN 'import' THEN e.dst || ' imported by ' || e.src || ' from seed ' || s.path
    WHEN 'caller' THEN e.dst || ' calls or is called from ' || e.src ELSE e.dst || ' reached through ' || e.kind || ' edge from ' || e.src END FROM seeds s JOIN steps e ON e.src = s.path
  UNION ALL SELECT w1.task_id, e.dst, w1.seed_rank, 2, w1.o1, e.ord, greatest(1, w1.base - 4 + e.weight), CASE e.kind WHEN 'import' THEN e.dst || ' imported by ' || e.src || ' from seed ' || w1.seed
    WHEN 'caller' THEN e.dst || ' calls or is called from ' || e.src ELSE e.dst || ' reached through ' || e.kind || ' edge from ' || e.src END FROM w1 JOIN steps e ON e.src = w1.path)),
won AS (SELECT task_id, path, spot AS won FROM told QUALIFY row_number() OVER (PARTITION BY task_id, path ORDER BY score DESC, spot) = 1),
s_reasons AS (SELECT told.task_id, told.path, list_reduce(list(reason ORDER BY spot), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || '; ' || b END) AS s_reason
  FROM told JOIN won ON won.task_id = told.task_id AND won.path = told.path WHERE spot >= won GROUP BY ALL),
reasoned AS (SELECT r.*, CASE WHEN s_reason IS NULL THEN m.reason WHEN m.reason IS NULL OR contains(s_reason, m.reason) THEN s_reason ELSE s_reason || '; ' || m.reason END AS reason
  FROM ranked r LEFT JOIN s_reasons s ON s.task_id = r.task_id AND s.path = r.path LEFT JOIN semantic m ON m.task_id = r.task_id AND m.path = r.path)"""

PACKED = """entries AS (SELECT *, ceil(length(content) / 4)::BIGINT AS raw_tokens, ceil(length(summary) / 4)::BIGINT AS short FROM (
  SELECT r.task_id, r.rank, r.path, r.role, r.stage, r.score, r.reason, f.content, role IN ('primary', 'manual') OR score >= 14 AS prefer, CASE WHEN role IN ('dependency', 'semantic-support') THEN 'dependency' ELSE 'summary' END AS bucket,
    'Imports ' || up.dst AS note, concat('Purpose: Supporting documentation relevant to the task. Reason: ', r.reason, ' Public API: None detected Key invariants: Preserve observed behavior while editing this file. Dependencies: ', coalesce('Imports ' || up.dst, 'None detected')) AS summary
    FROM reasoned r JOIN facts f ON f.path = r.path LEFT JOIN up ON up.src = r.path)),
fold AS (SELECT DISTINCT task_id, 0 AS rank, 0::BIGINT AS raw, 0::BIGINT AS summary, 0::BIGINT AS dependency, []::VARCHAR[] AS items, []::VARCHAR[] AS omitted FROM entries
  UNION ALL SELECT task_id, rank, raw + CASE WHEN take = 'raw' THEN raw_tokens ELSE 0 END, summary + CASE WHEN take = 'summary' AND bucket = 'summary' THEN short ELSE 0 END,
    dependency + CASE WHEN take = 'summary' AND bucket = 'dependency' THEN short ELSE 0 END,
    CASE WHEN take IS NULL THEN items ELSE list_append(items, path || ':' || take) END, CASE WHEN take IS NULL THEN list_append(omitted, path) ELSE omitted END
    FROM (SELECT e.task_id, e.rank, e.path, e.bucket, e.raw_tokens, e.short, s.raw, s.summary, s.dependency, s.items, s.omitted, CASE WHEN prefer AND s.raw + raw_tokens <= 4000 THEN 'raw'
      WHEN (bucket = 'summary' AND s.summary + short <= 2000) OR (bucket = 'dependency' AND s.dependency + short <= 1200) THEN 'summary' END AS take
      FROM fold s JOIN entries e ON e.task_id = s.task_id AND e.rank = s.rank + 1)),
packed AS (SELECT *, raw + summary + dependency AS total FROM fold QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY rank DESC) = 1)"""

PROMPT_TEXT = r"""parts_of AS (SELECT e.*, CASE WHEN list_contains(p.items, e.path || ':raw') THEN 'raw' WHEN list_contains(p.items, e.path || ':summary') THEN 'summary' END AS take FROM entries e JOIN packed p USING (task_id)),
notes AS (SELECT task_id, string_agg(note, chr(10) ORDER BY rank) AS notes FROM (SELECT task_id, note, min(rank) AS rank FROM parts_of WHERE take IS NOT NULL AND note IS NOT NULL GROUP BY ALL) GROUP BY task_id),
bodies AS (SELECT task_id, count(take) AS n_included, string_agg(path || ' [' || role || '/' || stage || '] score=' || printf('%.1f', score) || ' reason=' || reason, chr(10) ORDER BY rank) AS rationale,
  string_agg(concat('## ', path, chr(10), 'Purpose: ', CASE WHEN role IN ('primary', 'manual') THEN 'Raw implementation preserved because it is a high-priority editing surface.' ELSE 'Raw source preserved because its implementation details are likely material.' END,
    chr(10), 'Reason: ', reason, chr(10), '```', chr(10), content, chr(10), '```'), chr(10) || chr(10) ORDER BY rank) FILTER (WHERE take = 'raw') AS raws,
  string_agg(concat('- ', path, ': ', summary, ' Public API: None. Key invariants: Preserve observed behavior while editing this file.'), chr(10) ORDER BY rank) FILTER (WHERE take = 'summary') AS summaries,
  CASE WHEN count(*) >= 12 THEN ['Ranked candidate set truncated to the top 12 files.'] ELSE [] END AS cut FROM parts_of GROUP BY task_id),
prompts AS (SELECT t.task_id, t.target, coalesce(n_included, 0) AS n_included, coalesce(dependency, 0) AS used_dependency, coalesce(total, 0) AS used_total, concat('# Task', chr(10), text, chr(10), chr(10), '# Operating Constraints', chr(10), 'Use the compiled context first before relying on unstated repository assumptions.', chr(10),
  'Call out omitted files if they block a safe change.', chr(10), 'Recent session context: none', chr(10), chr(10), '# Retrieval Rationale', chr(10), coalesce(rationale, 'No retrieval rationale available.'), chr(10), chr(10), '# Selected Raw Files', chr(10), coalesce(raws, 'No raw files included.'), chr(10), chr(10),
  '# Compressed Summaries', chr(10), coalesce(summaries, 'No summaries generated.'), chr(10), chr(10), '# Dependency Notes', chr(10), coalesce(notes, 'No dependency notes recorded.'), chr(10), chr(10), '# Related Tests', chr(10), 'No related tests selected.', chr(10), chr(10),
  '# Explicit Omissions', chr(10), coalesce(nullif(array_to_string(list_concat(omitted, cut), chr(10)), ''), 'No omissions recorded.'), chr(10), chr(10), '# Token Accounting', chr(10),
  'Usage: raw=', coalesce(raw, 0), ', summaries=', coalesce(summary, 0), ', dependencies=', coalesce(dependency, 0), ', tests=0, total=', coalesce(total, 0)) AS prompt
  FROM texts t LEFT JOIN bodies USING (task_id) LEFT JOIN packed USING (task_id) LEFT JOIN notes USING (task_id))"""

_PACKED = "RECURSIVE " + ",\n".join([_ALL, REASONS, PACKED])
_PROMPTS = ",\n".join([_PACKED, PROMPT_TEXT])

LOG = f"""log AS (SELECT 'r' || conv_id % 10 AS repo_id, conv_id * 1000 + turn AS seq, conv_id || '-' || turn AS task_id, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
texts AS (SELECT * FROM log), {TERMS},
picked AS (SELECT log.repo_id, log.seq, coalesce(list(term ORDER BY ord) FILTER (WHERE ord < 3), []) AS files FROM log LEFT JOIN terms USING (task_id) GROUP BY ALL)"""


def _sql(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def oracle_sql() -> dict[str, str]:
    out = {
        "file_records": _sql("SELECT f.path, 'markdown' AS language, f.size, false AS is_test, modified_at_ms, round(recency, 6) AS recency_score, importance AS file_importance_score, token_cost FROM files f JOIN facts USING (doc_id)", FILES),
        "chunk_documents": _sql("SELECT id, file_path, kind, start_line, end_line, token_estimate, md5(text) AS text_md5 FROM chunks", FILES, CHUNKS),
        "task_intent": _sql(
            """SELECT task_id, CASE WHEN regexp_matches(lower(text), 'fix|bug|regression|error|broken') THEN 'bugfix' WHEN regexp_matches(lower(text), 'refactor|rename|cleanup|simplify') THEN 'refactor'
            WHEN regexp_matches(lower(text), 'docs|documentation|readme|guide') THEN 'docs' WHEN regexp_matches(lower(text), 'add|build|implement|create|support') THEN 'feature' ELSE 'general' END AS intent FROM texts""", TEXTS,
        ),
        "task_terms": _sql("SELECT task_id, ord, term FROM terms", TEXTS, TERMS),
        "term_trigrams": _sql("SELECT task_id, gram, m AS n FROM grams", TEXTS, TERMS, GRAMS),
        "structural_seeds": _sql("SELECT task_id, path, score, reason, seed_rank FROM seeds", FILES, TASKS, TERMS, SEEDS),
        "expand_two_hops": _sql("SELECT task_id, path, score::DOUBLE AS structural_score, role, CASE WHEN distance = 0 THEN 'seed' ELSE 'graph' END AS stage, distance::INT AS dependency_distance FROM structural", FILES, TASKS, TERMS, SEEDS, EDGES, WALKS),
        "semantic_chunks": _sql("SELECT task_id, id, round(score, 6) AS score, rank FROM hits", FILES, CHUNKS, TASKS, TERMS, GRAMS, SEMANTIC),
        "semantic_files": _sql("SELECT task_id, path, round(semantic_score, 6) AS semantic_score, reason, 'semantic-support' AS role, m_cost AS token_cost, rank FROM semantic", FILES, CHUNKS, TASKS, TERMS, GRAMS, SEMANTIC),
        "rerank_top12": _sql("SELECT task_id, path, round(score, 6) AS score, source, role, stage, dependency_distance::INT AS dependency_distance, token_cost, n_chunks::INT AS n_chunks, n_path::INT AS n_path, rank FROM ranked", _ALL),
        "overrides_applied": _sql(
            """SELECT task_id, path, round(score, 6) AS score, source, role, stage, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path)::INT AS rank FROM (
            SELECT r.task_id, r.path, CASE WHEN p.path IS NULL THEN r.score ELSE greatest(r.score, 1000.0) END AS score, CASE WHEN p.path IS NULL THEN r.source ELSE 'manual' END AS source,
              CASE WHEN p.path IS NULL THEN r.role ELSE 'manual' END AS role, CASE WHEN p.path IS NULL THEN r.stage ELSE 'override' END AS stage
              FROM ranked r LEFT JOIN pins p ON p.task_id = r.task_id AND p.path = r.path WHERE r.rank > 1
            UNION ALL SELECT p.task_id, p.path, 1000.0, 'manual', 'manual', 'override' FROM pins p WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.task_id = p.task_id AND r.path = p.path))""",
            _ALL, "pins AS (SELECT t.task_id, f.path FROM texts t JOIN files f ON f.doc_id = t.task_id LEFT JOIN ranked r ON r.task_id = t.task_id AND r.rank = 1 WHERE r.path IS NULL OR r.path <> f.path)",
        ),
        "budget_pack": _sql("SELECT task_id, array_to_string(items, ',') AS items, array_to_string(omitted, ',') AS omitted, raw AS used_raw, summary AS used_summary, dependency AS used_dependency, 0::BIGINT AS used_tests, total AS used_total FROM packed", _PACKED),
        "compiled_prompts": _sql("SELECT task_id, target, substr(sha1(prompt), 1, 12) AS prompt_id, ceil(length(prompt) / 4)::BIGINT AS token_estimate, n_included::INT AS n_included, used_dependency, used_total FROM prompts", _PROMPTS),
        "agent_payloads": _sql(
            """SELECT task_id, target, md5(CASE WHEN target = 'claude' THEN 'You are Claude operating on a compiled engineering brief. Use the supplied repository context, explain your reasoning briefly, and avoid relying on files outside the provided scope.'
            ELSE 'You are Codex working inside a repository-aware workflow. Use the provided compiled context first, preserve behavior unless the task requires change, and call out omitted files when blocked.' END) AS system_md5,
            md5(CASE WHEN target = 'claude' THEN concat('Repository task brief:', chr(10), prompt, chr(10), chr(10), 'Response expectations:', chr(10), '- Prompt ID: ', substr(sha1(prompt), 1, 12), chr(10), '- Explain the plan briefly before major edits.', chr(10), '- Note assumptions when context was omitted by budget.')
            ELSE concat('# Compiled Task', chr(10), prompt, chr(10), chr(10), '# Operating Notes', chr(10), 'Prompt ID: ', substr(sha1(prompt), 1, 12), chr(10), 'Prefer editing the listed files directly.', chr(10), 'If context is omitted by budget, say so before making a risky change.') END) AS user_md5 FROM prompts""", _PROMPTS,
        ),
        "link_edges": "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL",
        "edge_dedupe": "SELECT src, dst, 'reference' AS kind, max(weight)::INT AS weight FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS src, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)) AS dst, page_id % 4 + 2 AS weight FROM pages) GROUP BY src, dst",
        "import_resolution": _sql(
            "SELECT src, module, min(h.path) AS dst FROM want w JOIN have h ON h.have = w.want OR ends_with(h.have, '/' || w.want) OR ends_with(w.want, '/' || h.have) GROUP BY src, module", FILES,
            "have AS (SELECT path, regexp_replace(path, '[.]md$', '') AS have FROM files)",
            """want AS (SELECT path AS src, CASE doc_id % 3 WHEN 0 THEN '../' || coalesce(lang, 'none') || '/' || half || '.md' WHEN 1 THEN './' || half ELSE '../../../' || half END AS module,
              CASE doc_id % 3 WHEN 2 THEN half ELSE 'docs/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || half END AS want FROM (SELECT *, lpad((doc_id // 2)::VARCHAR, 9, '0') AS half FROM files))""",
        ),
        "snapshot_diff": """WITH a AS (SELECT user_id::VARCHAR AS path, count(*) AS size, max(ts) AS at FROM events WHERE event_id % 3 <> 0 GROUP BY 1), b AS (SELECT user_id::VARCHAR AS path, count(*) AS size, max(ts) AS at FROM events WHERE event_type <> 'error' GROUP BY 1)
            SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size = b.size AND a.at = b.at THEN 'reused' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path""",
        "index_metrics": _sql(
            """SELECT count_if(change = 'added')::BIGINT AS added_files, count_if(change = 'changed')::BIGINT AS changed_files, count_if(change = 'removed')::BIGINT AS removed_files, count_if(change = 'reused')::BIGINT AS reused_files,
            (SELECT count(*) FROM chunks JOIN diff ON file_path = path WHERE change = 'reused') AS reused_chunks, least((SELECT count(*) FROM edges), (SELECT count(*) FROM edges WHERE kind <> 'caller')) AS reused_edges FROM diff""",
            FILES, CHUNKS, EDGES,
            """diff AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'reused' END AS change FROM files WHERE doc_id % 7 <> 0 OR doc_id % 11 <> 0)""",
        ),
        "recent_sessions": _sql("SELECT repo_id, seq, row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC)::INT AS recency, array_to_string(files, ',') AS files FROM picked QUALIFY recency <= 3", LOG),
        "memory_pins": _sql(
            """SELECT repo_id, string_agg(f, ',' ORDER BY spot) AS memory FROM (SELECT repo_id, f, min(spot) AS spot FROM (
            SELECT repo_id, f, row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC, i) AS spot FROM (SELECT repo_id, seq, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM newest) QUALIFY spot <= 4) GROUP BY ALL) GROUP BY repo_id""",
            LOG, "newest AS (SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC) <= 3)",
        ),
        "session_retention": _sql("SELECT repo_id, seq FROM picked QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC) <= 20", LOG),
        "handoff_history": """WITH log AS (SELECT user_id % 50 AS repo_id, event_id AS seq, event_type || event_id % 3 AS prompt_id FROM events),
            one AS (SELECT repo_id, prompt_id, max(seq) AS seq FROM log GROUP BY ALL)
            SELECT repo_id, seq, prompt_id, row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC)::INT AS position FROM one QUALIFY position <= 5""",
        "override_state": """WITH RECURSIVE log AS (SELECT user_id % 50 AS repo_id, event_id % 11 AS path, CASE event_type WHEN 'click' THEN 'pin' WHEN 'view' THEN 'exclude' ELSE 'include' END AS action,
              row_number() OVER (PARTITION BY user_id % 50, event_id % 11 ORDER BY event_id) AS k FROM events),
            walk AS (SELECT DISTINCT repo_id, path, 0::BIGINT AS k, 'none' AS state FROM log
              UNION ALL SELECT w.repo_id, w.path, l.k, CASE l.action WHEN 'include' THEN 'pinned' WHEN 'pin' THEN CASE w.state WHEN 'pinned' THEN 'none' ELSE 'pinned' END ELSE CASE w.state WHEN 'excluded' THEN 'none' ELSE 'excluded' END END
              FROM walk w JOIN log l ON l.repo_id = w.repo_id AND l.path = w.path AND l.k = w.k + 1)
            SELECT repo_id, path, state FROM walk QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY k DESC) = 1""",
        "language_breakdown": """WITH c AS (SELECT coalesce(lang, 'none') AS language, count(*) AS n_files FROM documents GROUP BY 1)
            SELECT language, n_files, (SELECT string_agg(language || ':' || n_files, ', ' ORDER BY n_files DESC, language) FROM c) AS languages FROM c""",
        "index_diagnostics": _sql("SELECT (SELECT count(*) FROM files) AS file_count, 0::BIGINT AS test_count, (SELECT count(*) FROM files) AS symbol_count, (SELECT count(*) FROM chunks) AS chunk_count, (SELECT count(*) FROM edges) AS edge_count, 0.0::DOUBLE AS chunk_reuse_ratio", FILES, CHUNKS, EDGES),
        "dense_similarity": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
            SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 5) AS score FROM e AS q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
            QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, e.v) DESC, e.vec_id) <= 8""",
    }
    out["override_stream"] = out["override_state"]  # a stream's end is what all rows tell
    return out
