"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from servelog import catalog

HEADLINE = (
    "request_rate", "latency_percentiles", "bucket_histogram", "queue_depth", "status_lifecycle",
    "requests_with_batches", "ring_owner", "balanced_assign", "bounded_load_assign",
    "policy_summary", "first_touch", "lru_hits", "work_reuse_distance", "work_batch_cost",
    "longest_prefix_match", "prefix_trie", "reuse_depth", "stem_placement", "token_bucket",
    "idempotent", "size_or_deadline_batches", "worker_liveness", "speedup", "cap_sweep")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("servelog-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    # Start the JVM, the Python workers and the code generator once.
    for name in ("request_rate", "idempotent"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)[2:]}))
    spark.stop()


if __name__ == "__main__":
    main()
