"""Names of the training-data queries and, where SQL can express them, their statements."""

from __future__ import annotations

from lodestone.llm import queries as q


def queries() -> dict:
    return {name: getattr(q, name) for name in dir(q) if name.startswith("op")}


#: START and END stand for the template's marks, ESC for its escape character.
OP2 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '␛', '')))
    + 2 * len(regexp_extract_all(text, '<\\||</?s>|\\[/?INST\\]|<</?SYS>>')) AS escaped
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + length(role) + 12 + 1 + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2}
