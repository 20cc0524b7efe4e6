"""SQL for DuckDB beside the queries that SQL can express over whole tables.

The others need trained models, hashes that SQL lacks, positions of pattern
matches, or merges in sequence; tests hold those against brute force.
"""

from __future__ import annotations

from .chat import ASSISTANT, END, SYSTEM, USER
from .quality import RULES, STOP_WORDS

_BLANK = r"[ \t\n\x0B\f\r]"


def _rule(rule) -> str:
    over, _, under = rule.ratio.partition(" / ")
    ratio = f"coalesce({over} / nullif({under}, 0), 0)" if under else over
    parts = [f"{ratio} >= {rule.low}"] * (rule.low is not None) + [f"{ratio} <= {rule.high}"] * (rule.high is not None)
    return " AND ".join(parts)


OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK[1:]}')) AS ls FROM d),
windows AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(repr(s) for s in sorted(set(STOP_WORDS)))}))) AS n_stop_words FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"({_rule(r)})" for r in RULES)} AS kept FROM b
"""


def _text(s: str) -> str:
    return " || ".join(f"'{part}'" for part in s.split("\n")).replace(" || ''", "") + " || chr(10)" * s.count("\n")


_HEAD, _TAIL = USER.split("{}")
_NAMED = f"'{_HEAD}' || role || {_text(_TAIL)}"
OP3 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS position FROM t),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT n.conv_id, p.perspective, n.position, n.role, CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS role_label,
    CASE WHEN role = 'system' THEN {_text(SYSTEM)} WHEN role = perspective THEN {_text(ASSISTANT)} ELSE {_NAMED} END || text || {_text(END)} AS rendered FROM n JOIN p ON p.conv_id IS NOT DISTINCT FROM n.conv_id),
s AS (SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY position) AS BIGINT) AS "end" FROM r)
SELECT conv_id, perspective, position, role_label, CASE WHEN role_label = 'user' THEN role END AS name, rendered, "end" - length(rendered) AS start, "end",
CASE WHEN role_label = 'assistant' THEN "end" - length(rendered) + {len(ASSISTANT)} END AS train_start, CASE WHEN role_label = 'assistant' THEN "end" END AS train_end FROM s
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN least m ON m.a = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id
"""

ORACLE_SQL = {"op2_quality_rules": OP2, "op3_chat_rotation": OP3, "op9_embeddings": OP9}
