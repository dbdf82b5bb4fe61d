"""Times the headline jobs, median of three runs each, and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lexicue.plans import JOBS  # noqa: E402
from lexicue.session import build  # noqa: E402

HEADLINE = [
    "feed_page", "unseen_feed_all_users", "word_lookup_left", "word_rank", "word_occurrences", "definition_plan",
    "covering_segment", "nearest_segment", "overlap_join", "best_match", "merged_transcript", "exact_collapse",
    "fuzzy_collapse", "diagnosis", "diagnosis_gaps", "tap_match", "greedy_dict", "session_stats", "review_replay",
    "view_upsert", "check_rules", "page_fields", "chunk_captions", "scenario_pnl", "view_counts_60s",
]

WARM_UP = ["near_duplicates", "feed_page", "word_lookup_left", "covering_segment"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    def run(name: str) -> float:
        t = time.perf_counter()
        JOBS[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    # untimed jobs of each kind (Python workers, pages, joins, scans) start the engine
    for name in WARM_UP:
        run(name)
    times = {name: round(statistics.median(run(name) for _ in range(3)), 3) for name in HEADLINE}
    spark.stop()
    print(json.dumps({
        "metric": "headline_jobs_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
