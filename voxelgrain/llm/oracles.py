"""SQL for the checking engine, where SQL can express an operator."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_ASSIGN = """(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return (
        f"SELECT doc_id, n, '{kind}' AS kind, {order} AS k, unnest(range(1, len(hits) + 1)) AS i, hits, gaps, vals, {least} AS least "
        f"FROM (SELECT doc_id, n, regexp_extract_all(t, '{pattern}', 0) AS hits, string_split_regex(t, '{pattern}') AS gaps, "
        f"regexp_extract_all(t, '{pattern}', {group}) AS vals FROM d)"
    )


ORACLES = {
    "op1_secret_scan": (
        "WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents), "
        f"f AS ({_found('assign', 0, '(?i:' + _ASSIGN + ')', 2, 8)} UNION ALL {_found('access', 1, 'AKIA[A-Z0-9]+', 0, 16)} "
        f"UNION ALL {_found('hex', 2, '[0-9a-f]{32,}', 0, 32)}), "
        "p AS (SELECT n, kind, k, list_sum(list_transform(gaps[1:i], lambda x: length(x))) "
        "+ coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS size FROM f WHERE length(vals[i]) >= least), "
        "g AS (SELECT n, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c, "
        "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + size AS BIGINT), ',' ORDER BY s, k) AS spans FROM p GROUP BY n) "
        "SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, coalesce(spans, '') AS spans, "
        "sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (n)"
    ),
    "op5_conversation_tree": (
        "WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL "
        "SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]') "
        "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, "
        "CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, "
        "sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, "
        r"CAST(sum(23 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars "
        "FROM c GROUP BY conv_id"
    ),
    "op8_exact_copies": (
        f"SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, "
        f"sha256({LOWERED}) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY {LOWERED})"
    ),
}
