"""Times parsing and storing the documents of both datasets, then the headline queries, each to
its full result. Queries on raw records start from the given tables, rules from the documents.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the number of threads.
"""

from __future__ import annotations

import json
import os
import time

from planewatch import build_session
from planewatch import constants as K
from planewatch.plans.registry import all_queries, rolled, stored

HEADLINE = [
    "upsert_latest", "parse_content", "reduce_generations", "parse_gateway", "gateway_status", "dataset_view",
    "genai_system", "quarantine", "ingest_counters", "credential_scan", "join_key_fanout",
    "d01_canary_output", "d02_injection_phrase", "d04_token_spike", "d05_token_ratio", "d06_cost_per_session",
    "d07_model_routing", "d08_budget_blocks", "d09_attempt_then_block", "d10_auth_clusters",
    "d11_content_without_gateway", "d12_cost_disagreement", "d13_model_disagreement", "d14_prompt_many_keys",
    "d15_enforcement_type", "correlate", "resolve_request", "completion_id_crosscheck", "join_health",
    "join_health_series", "detection_scorecard", "stream_hourly_blocks", "stream_unmatched",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(os.path.join(sf_dir, "events.parquet")).write.format("noop").mode("overwrite").save()
    queries = all_queries()
    times: dict[str, float] = {}
    for dataset in (K.CONTENT, K.GATEWAY):
        start = time.perf_counter()
        stored(spark, sf_dir, dataset)
        times[f"store_{dataset}_documents"] = round(time.perf_counter() - start, 3)
    for dataset in (K.CONTENT, K.GATEWAY):  # what streams read is there before they start, and is not timed
        rolled(spark, sf_dir, dataset)
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
