"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the folder of parquet tables, ``BENCH_CPUS`` the cores to use.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.compare import local_session
from checks.spark_queries import REGISTRY

# build_index is the offline part: chunk, embed and write the dense and sparse index.
HEADLINE = (
    "chunk_documents",
    "pack_words",
    "embed_text",
    "bm25_postings",
    "dense_topk",
    "bm25_topk",
    "hybrid_search",
    "search_trials",
    "semantic_pairs",
    "match_all_conditions",
    "find_eligible_patients",
    "match_cohorts",
    "group_conditions",
    "demographics_counts",
    "analyze_and_match",
)


def timed(action) -> float:
    start = time.time()
    action()
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"))
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> None:
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("scan_patients")  # starts the session's threads and compiles the first code
    seconds = {"build_index": timed(lambda: run("chunk_summary"))}
    for name in sys.argv[1:] or HEADLINE:
        seconds[name] = timed(lambda: run(name))
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
