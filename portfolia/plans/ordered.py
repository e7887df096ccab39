"""Conversations and event streams (items 72, 73, 109)."""

from __future__ import annotations

from portfolia import bindings as b
from portfolia.operators import conversations as c
from portfolia.plans.registry import query, sql

#: A small piece, so that texts have several.
PIECE = 400

# Systems messages count as user messages here, which creates runs to merge.
RUN_MESSAGES = [
    "conv_id", "turn", "CASE WHEN role = 'system' THEN 'user' ELSE role END AS role", "type", "text",
    "CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('SELECT ', CAST(turn AS STRING)) END AS statement",
    "CASE WHEN turn % 4 = 1 THEN CAST(turn AS STRING) END AS suggestions",
]

RUNS = """
SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
  SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS opens
  FROM {}) z"""

# Rows of texts, each with the piece in which it begins, and the pieces.
SIZED = f"""SELECT *, coalesce(sum(strlen(text) + 2) OVER (PARTITION BY conv_id, run ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {PIECE} AS part FROM {{}}"""
PIECES = """SELECT conv_id, run, CAST(part AS BIGINT) AS part, CASE WHEN part > 0 THEN chr(10) || chr(10) ELSE '' END
  || string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM sized GROUP BY conv_id, run, part"""


@query("coalesce_turns", sql(
    """SELECT conv_id, CAST(run AS BIGINT) AS run, first_turn, role, type, n_messages, statement, suggestions, part, text
FROM heads JOIN pieces USING (conv_id, run)""", "messages",
    m="SELECT " + ", ".join(RUN_MESSAGES).replace("STRING", "VARCHAR") + " FROM messages", runs=RUNS.format("m"),
    heads="""SELECT conv_id, run, min(turn) AS first_turn, role, arg_min(type, turn) AS type, count(*) AS n_messages,
  arg_max(statement, turn) FILTER (role = 'assistant' AND statement IS NOT NULL) AS statement,
  arg_max(suggestions, turn) FILTER (role = 'assistant' AND suggestions IS NOT NULL) AS suggestions
FROM runs GROUP BY conv_id, run, role""",
    sized=SIZED.format("(SELECT * FROM runs WHERE text <> '') t"), pieces=PIECES))
def _coalesce(spark, d):
    return c.coalesce_turns(b.messages(spark, d).selectExpr(*RUN_MESSAGES), ["statement", "suggestions"], PIECE)


@query("alternate_roles", sql(
    """SELECT conv_id, CAST(run AS BIGINT) AS run, first_turn, role, part, text AS content FROM (
  SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY first_turn) AS next_role FROM turns) t
JOIN pieces USING (conv_id, run) WHERE next_role IS DISTINCT FROM role""", "messages",
    raw="SELECT * EXCLUDE (opens, run), run AS raw_run FROM (" + RUNS.format("messages") + ") y",
    kept="SELECT * EXCLUDE (opens) FROM (" + RUNS.format(
        "(SELECT * FROM raw WHERE role IN ('user', 'assistant'))") + ") y",
    used="""SELECT * FROM kept k WHERE raw_run = (SELECT min(raw_run) FROM kept x
  WHERE x.conv_id = k.conv_id AND x.run = k.run) AND NOT (run = 1 AND role = 'assistant')""",
    turns="""SELECT conv_id, run, role, min(turn) AS first_turn
FROM used GROUP BY conv_id, run, role HAVING role = 'user' OR count(*) FILTER (type = 'text') > 0""",
    said="""SELECT * FROM used u WHERE CASE WHEN role = 'user' THEN turn = (SELECT min(turn) FROM used x
  WHERE x.conv_id = u.conv_id AND x.run = u.run) ELSE type = 'text' END""",
    sized=SIZED.format("said"), pieces=PIECES))
def _alternate(spark, d):
    return c.alternate_roles(b.messages(spark, d), PIECE)


@query("assemble_events", sql(
    """SELECT stream_id, CAST(coalesce(part, 0) AS BIGINT) AS part,
  CASE WHEN failed THEN 'error' WHEN done_no IS NOT NULL THEN 'done' ELSE 'open' END AS status,
  CASE WHEN failed THEN 0 ELSE n_texts END AS n_texts,
  CASE WHEN failed THEN error_text ELSE coalesce(CASE WHEN part = last_part THEN rtrim(CASE WHEN part = 0 THEN
      ltrim(text, chr(10) || ' ') ELSE text END, chr(10) || ' ')
    WHEN part = 0 THEN ltrim(text, chr(10) || ' ') ELSE text END, '') END AS text,
  CASE WHEN NOT failed THEN tool_result END AS tool_result
FROM records LEFT JOIN pieces USING (stream_id)""", "stream_events",
    numbered="""SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS no,
  CASE kind WHEN 'text' THEN body
    WHEN 'tool_use' THEN 'I used the following tool to serve your request: **' || body || '**' || chr(10) || chr(10)
    WHEN 'tool_results' THEN body || chr(10) || chr(10) END AS said FROM stream_events""",
    ends="""SELECT stream_id, min(no) FILTER (kind = 'done') AS done_no, min(no) FILTER (kind = 'error') AS error_no
FROM numbered GROUP BY 1""",
    marked="""SELECT n.*, done_no, error_no, coalesce(error_no < coalesce(done_no, error_no + 1), false) AS failed,
  no < coalesce(done_no, no + 1) AS live FROM numbered n JOIN ends USING (stream_id)""",
    records="""SELECT stream_id, failed, done_no, count(*) FILTER (live AND kind = 'text') AS n_texts,
  trim(max(body) FILTER (no = error_no)) AS error_text,
  arg_max(body, no) FILTER (live AND kind = 'tool_results') AS tool_result FROM marked GROUP BY 1, 2, 3""",
    sized=f"""SELECT *, coalesce(sum(strlen(said)) OVER (PARTITION BY stream_id ORDER BY no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {PIECE} AS part
FROM marked WHERE live AND NOT failed AND said IS NOT NULL""",
    pieces="""SELECT stream_id, part, string_agg(said, '' ORDER BY no) AS text,
  max(part) OVER (PARTITION BY stream_id) AS last_part FROM sized GROUP BY stream_id, part"""))
def _assemble(spark, d):
    return c.assemble_events(b.stream_events(spark, d), PIECE)
