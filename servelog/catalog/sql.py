"""The same views as SQL common table expressions."""

from __future__ import annotations

REQUEST_LOG = """
request_log AS (
  SELECT event_id AS seq, printf('req-%08d', event_id) AS request_id, ts,
    epoch_us(ts) AS ts_us, user_id AS api_key, 'm' || (user_id % 3) AS model,
    CASE WHEN user_id % 10 = 0 THEN 'high' ELSE 'default' END AS priority,
    CASE WHEN event_id % 4 = 0 THEN 'async' ELSE 'sync' END AS mode,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
    'w' || (event_id % 4) AS worker_id, k AS prefix_id, md5('p' || k) AS prefix_hash,
    k * 100 AS max_tokens, value / 50 AS temperature, k / 100.0::DOUBLE AS top_p,
    k::DOUBLE AS queue_wait_ms, value AS inference_ms, k + value AS total_ms,
    64 + 8 * k AS prompt_tokens, CASE WHEN k % 3 = 0 THEN 32 + 4 * k ELSE 0 END AS cached_tokens,
    user_id || ':' || (k % 5) AS idem_key, event_type, props
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

API_KEYS = """
api_keys AS (
  SELECT sha256(user_id::VARCHAR) AS key_hash, 't' || (user_id % 10) AS tenant_id, 10 AS rps_limit
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 <> 0))"""

WORKERS = """
worker_models AS (SELECT * FROM (VALUES ('w0','m0'),('w0','m1'),('w1','m1'),('w1','m2'),
  ('w2','m0'),('w3','m0'),('w3','m1')) AS t(worker_id, model)),
workers AS (SELECT DISTINCT worker_id FROM worker_models)"""

REGISTRY = """
registry AS (
  SELECT 's' || s_suppkey AS worker_id, 'm' || ((s_suppkey + i) % 5) AS model,
    coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 8 END, 16) AS max_batch,
    coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 4 END, 1) AS max_concurrent,
    s_suppkey % 6 AS inflight
  FROM supplier, range(2) AS r(i))"""

# Chain hashes need recursion: use WITH RECURSIVE in front.
CHAINS = """
chain_steps AS (
  SELECT doc_id AS seq, lang AS worker_id, 1 AS depth, md5(substr(text, 1, 64)) AS chain_hash,
    NULL::VARCHAR AS parent_hash, text
  FROM documents WHERE length(text) >= 64
  UNION ALL
  SELECT seq, worker_id, depth + 1, md5(chain_hash || substr(text, depth * 64 + 1, 64)),
    chain_hash, text
  FROM chain_steps WHERE length(text) >= (depth + 1) * 64),
chains AS (SELECT seq, worker_id, depth, chain_hash, parent_hash FROM chain_steps)"""

JOB_EVENTS = REQUEST_LOG + """,
job_events AS (SELECT api_key || ':' || prefix_id AS job_id, seq, ts_us, event_type AS status
  FROM request_log)"""

WORK_LOG = """
work_log AS (
  SELECT l_orderkey AS batch_no, l_suppkey AS worker_id, l_partkey AS prefix_id,
    epoch_us(l_shipdate) AS ts_us, l_quantity AS tokens, l_extendedprice / 1000 AS busy_ms,
    epoch_us(l_shipdate) // 86400000000 AS day, l_orderkey, l_linenumber, l_partkey,
    l_extendedprice, l_quantity, l_returnflag, l_linestatus
  FROM lineitem)"""
WORK_ORDER = "day, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"

SWEEP = """
sweep AS (
  SELECT l_linenumber AS length, l_suppkey % 10 AS seed, l_returnflag AS policy,
    l_linestatus AS cap, quantile_cont(l_extendedprice / 1000, 0.99) AS p99
  FROM lineitem GROUP BY 1, 2, 3, 4)"""

TOKEN_LOG = """
token_log AS (
  SELECT conv_id AS job_id, turn AS seq, text AS token, role,
    turn = max(turn) OVER (PARTITION BY conv_id) AS final FROM conversations)"""


def ring(workers: str = "workers", name: str = "ring") -> str:
    return f"""
{name} AS (SELECT substr(md5(worker_id || '#' || v), 1, 16) AS pos, worker_id
  FROM {workers}, range(160) AS r(v))"""


def preferences(keys: str, ring_name: str = "ring", name: str = "pref") -> str:
    """(key, worker_id, rank) for the distinct keys of the query ``keys``."""
    return f"""
{name}_keys AS (SELECT DISTINCT key, substr(md5(key), 1, 16) AS kpos FROM ({keys})),
{name} AS (SELECT key, worker_id, row_number() OVER (PARTITION BY key ORDER BY spot) AS rank
  FROM (SELECT key, worker_id,
          min(CASE WHEN pos > kpos THEN '0' || pos ELSE '1' || pos END) AS spot
        FROM {name}_keys, {ring_name} GROUP BY key, worker_id))"""


def placement(rows: str, caps: tuple[str, ...], base: tuple[int, ...] = (0, 0, 0, 0),
              ids: tuple[str, ...] = ("w0", "w1", "w2", "w3")) -> str:
    """CTE ``placed(cap_factor, win, seq, worker_id, rank)``; ``rows`` is a query
    giving (win, seq, key), ``pref`` and ``ring`` are already defined. ``base`` is
    the load each of the ``ids`` starts with."""
    n = len(ids)
    values = ", ".join(f"('{c}'::DOUBLE)" for c in caps)
    loads = ", ".join(f"('{w}', {b})" for w, b in zip(ids, base))
    out = [f"""
place_rows AS (SELECT cap_factor, win, seq, key
  FROM ({rows}), (VALUES {values}) AS c(cap_factor)),
place_room AS (SELECT cap_factor, win, worker_id, CASE WHEN isinf(cap_factor) THEN 1e18
    ELSE greatest(ceil(cap_factor * greatest((c + {sum(base)}) / {n}.0::DOUBLE, 1.0::DOUBLE) - base), 0)
    END AS room
  FROM (SELECT cap_factor, win, count(*) AS c FROM place_rows GROUP BY cap_factor, win),
    (VALUES {loads}) AS b(worker_id, base)),
left_1 AS (SELECT * FROM place_rows)"""]
    for r in range(1, n + 1):
        taken = " UNION ALL ".join(
            f"SELECT cap_factor, win, worker_id FROM took_{i}" for i in range(1, r))
        used = (f"(SELECT cap_factor, win, worker_id, count(*) AS u FROM ({taken}) GROUP BY 1, 2, 3)"
                if taken else
                "(SELECT cap_factor, win, '' AS worker_id, 0 AS u FROM place_room WHERE false)")
        out.append(f"""
try_{r} AS (SELECT l.*, p.worker_id, m.room - coalesce(u.u, 0) AS room,
    row_number() OVER (PARTITION BY l.cap_factor, l.win, p.worker_id ORDER BY l.seq) AS rn
  FROM left_{r} l JOIN pref p ON p.key = l.key AND p.rank = {r}
  JOIN place_room m ON m.cap_factor = l.cap_factor AND m.win = l.win
    AND m.worker_id = p.worker_id
  LEFT JOIN {used} u ON u.cap_factor = l.cap_factor AND u.win = l.win
    AND u.worker_id = p.worker_id),
took_{r} AS (SELECT cap_factor, win, seq, worker_id, {r} AS rank FROM try_{r} WHERE rn <= room),
left_{r + 1} AS (SELECT cap_factor, win, seq, key FROM try_{r} WHERE rn > room)""")
    every = " UNION ALL ".join(f"SELECT * FROM took_{r}" for r in range(1, n + 1))
    out.append(f"""
placed AS ({every} UNION ALL
  SELECT cap_factor, win, seq, NULL, NULL FROM left_{n + 1})""")
    return ",".join(out)


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(ctes) + "\n"
