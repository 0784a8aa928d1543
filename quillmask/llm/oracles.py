"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_EACH = "SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w"

ORACLES = {
    "op3_chat_format": r"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
     each AS ({_EACH}),
     wide AS (SELECT doc_id, j, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM each WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
     again AS (SELECT doc_id, j FROM (SELECT doc_id, j, count(*) OVER (PARTITION BY s) AS c FROM wide WHERE n = 35) WHERE c > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + 35)) AS j FROM again),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS s, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
     each AS ({_EACH}),
     three AS (SELECT doc_id, word || ' ' || lead(word) OVER f || ' ' || lead(word, 2) OVER f AS s FROM each WINDOW f AS (PARTITION BY doc_id ORDER BY j)),
     sets AS (SELECT DISTINCT doc_id, s FROM three WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
     size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
     shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
     links AS (SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * shared.n >= 90 * (p.n + q.n - shared.n)),
     near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
     reach(x, y) AS (SELECT x, y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(doc_id, coalesce(min(y), doc_id)) AS component_id
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN reach ON x = doc_id GROUP BY doc_id""",
}
