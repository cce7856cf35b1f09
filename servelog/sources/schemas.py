"""Explicit schemas of the durable log, the registry and the streams."""

PARAMS = "max_tokens INT, temperature DOUBLE, top_p DOUBLE, stream BOOLEAN"

REQUESTS = """
    id STRING, tenant_id STRING, model STRING, params STRING, status STRING,
    worker_id STRING, batch_id STRING, prefix_hash STRING, cache_hit BOOLEAN,
    queue_wait_ms INT, inference_ms INT, total_ms INT,
    created_at TIMESTAMP, completed_at TIMESTAMP"""

BATCHES = """
    id STRING, model STRING, size INT, worker_id STRING, inference_ms INT,
    created_at TIMESTAMP"""

API_KEYS = "key_hash STRING, tenant_id STRING, rps_limit INT, created_at TIMESTAMP"

WORKERS = """
    worker_id STRING, engine STRING, models ARRAY<STRING>, max_batch INT,
    max_concurrent INT, inflight INT"""

REQUEST_EVENTS = """
    request_id STRING, input STRING, model STRING, prefix_hash STRING,
    enqueue_ts TIMESTAMP, max_tokens INT, temperature DOUBLE, top_p DOUBLE,
    stream BOOLEAN, priority STRING"""

CALIBRATION = """
    model STRING, source STRING, alpha_ms DOUBLE, beta_ms DOUBLE,
    prefill_ms DOUBLE, r2 DOUBLE, decode_ms_per_token DOUBLE,
    prefill_ms_per_token DOUBLE, samples ARRAY<ARRAY<DOUBLE>>"""

TABLES = {"requests": REQUESTS, "batches": BATCHES, "api_keys": API_KEYS}

# Defaults of a request's parameters and of the registry.
PARAM_DEFAULTS = {"max_tokens": 128, "temperature": 0.7, "top_p": 1.0, "stream": False}
DEFAULT_PRIORITY = "default"
DEFAULT_RPS_LIMIT = 10
