"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from albumloom.plans import load_all
from albumloom.session import build_session

HEADLINE = [
    "junk_rejections", "source_snapshot", "time_hash_segments", "near_duplicate_reach", "duplicate_groups", "merged_segments", "oversize_split", "small_batch_merge",
    "photo_batches", "grid_dedup", "alias_boxes", "poi_in_radius", "photo_places", "median_bit_hash", "folder_dates", "capture_times", "sensitive_content", "same_content",
    "reply_decisions", "three_tier_retry", "conflict_names", "token_totals", "throughput", "failure_runs", "event_folders", "theme_clustering", "day_merge_plan",
    "comparison_table", "text_keywords", "match_by_time", "progress_lines", "warnings_per_stage", "chunk_ingest_stream", "throughput_stream", "burst_stream",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    entries = load_all()
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()  # warm the session
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        entries[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
