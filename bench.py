"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from sextant.plans import queries as P

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["bm25_topk", "rrf_fusion", "dense_topk", "system_summary", "trace_policy_text", "policy_summary", "page_markdown", "cross_refs", "build_merge_delta", "tokens_per_doc", "paragraph_chunks", "word_windows", "latency_median_by_type", "budget_running_tally"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", str(2 * int(CPUS))).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.time()
        P.QUERIES[name](spark, DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
