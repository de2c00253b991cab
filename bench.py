"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from tidelog.plans import registry  # noqa: E402

HEADLINE = (
    "host_liveness",
    "timeline_events",
    "page_state",
    "new_identifiers",
    "collection_quality",
    "duplicate_documents",
    "gate_decisions",
    "parsed_pages",
    "indicators",
    "credentials",
    "listings",
    "pair_cooccurrence",
    "identifier_clusters",
    "constrained_clusters",
    "targeted_lineage",
    "admitted_links",
    "next_fetch_batch",
    "text_search",
    "phrase_index_lookup",
    "vector_search",
    "hashed_search",
    "content_alerts",
    "event_alerts",
    "version_changes",
    "audit_verdict",
    "evidence_manifest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # one machine: this stands in for the cluster's shared folder
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidelog-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the executors
    queries = registry()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
