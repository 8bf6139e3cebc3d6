"""DuckDB forms of the adapters, used as the first common table expressions of every registered query's SQL."""

from __future__ import annotations

EVENT_FRAMES = """frames AS (
  SELECT concat(user_id, '_', event_type) AS token, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6 AS time,
    CASE WHEN user_id % 50 = 7 OR k % 11 = 0 THEN NULL WHEN k % 9 = 0 THEN 0.0::DOUBLE ELSE 100 + value END AS f0,
    40.0::DOUBLE + k AS intensity, concat('S', user_id % 13) AS speaker, event_type AS tone, (user_id % 40)::VARCHAR AS item
  FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
)"""

ORDER_FRAMES = """frames AS (
  SELECT l_orderkey::VARCHAR AS token, rn * 0.01::DOUBLE AS time, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 80 + l_extendedprice / 400 END AS f0,
    40 + l_quantity AS intensity, concat('S', l_orderkey % 13) AS speaker, concat('T', l_orderkey % 5) AS tone, (l_orderkey % 40)::VARCHAR AS item
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem)
)"""

INTERVALS = """intervals AS (
  SELECT token, 'Rime 1' AS tier, t0 + (t9 - t0) * a AS t1, t0 + (t9 - t0) * b AS t2, label
  FROM (SELECT token, min(time) AS t0, max(time) AS t9 FROM frames WHERE tone <> 'view' GROUP BY token),
    (VALUES (0.0::DOUBLE, 0.1013579::DOUBLE, ''), (0.1013579, 0.3517283, 't'), (0.3517283, 0.7012467, 'a'), (0.7012467, 0.9531357, 'n'), (0.9531357, 1.0, '')) p(a, b, label)
)"""

METADATA = """metadata AS (
  SELECT concat(' ', c_custkey % 500, '_Purchase.WAV') AS key, c_custkey AS line, (c_nationkey % 5)::VARCHAR AS dialect, 'x' AS tone FROM customer WHERE c_custkey % 3 <> 0
)"""

DECISIONS = """decisions AS (
  SELECT token, CASE WHEN n % 7 = 0 THEN concat('L', n % 4) END AS label, n % 11 = 0 AS excluded, CASE WHEN n % 13 = 0 THEN 'listen again' END AS note
  FROM (SELECT DISTINCT token, split_part(token, '_', 1)::INTEGER + 3 * length(token) AS n FROM frames) WHERE n % 7 = 0 OR n % 11 = 0 OR n % 13 = 0
)"""


def frames_sql(body: str, base: str = EVENT_FRAMES) -> str:
    """The adapter's table expressions, then the given ones: body starts with further expressions or with SELECT."""
    body = body.strip()
    return f"WITH {base}\n{body}" if body.upper().startswith("SELECT") else f"WITH {base},\n{body}"
