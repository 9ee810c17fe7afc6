"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores, BENCH_RUNS how
often each query runs after one warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from checks.tables import Data  # noqa: E402
from countylens.session import local_session  # noqa: E402

HEADLINE = (
    "county_dim", "build_signal", "valid_values", "in_state", "date_range", "in_default_range",
    "map_lookup", "range_stats", "range_stats_of_year", "range_average", "latest_by_county",
    "date_ranges", "correlation", "regression_line", "extents", "correlation_matrix",
    "correlation_by_state", "indicator_map", "signal_map", "cumulative_map", "time_series",
    "tokens", "word_counts_by_state", "top_words", "word_ranks_by_state", "shared_top_words",
    "tweets_by_state", "consolidate_states", "unseen_ids", "embed_fields", "sample_by_key",
    "sample_per_group", "bag_of_words", "normalize_words", "vocabulary",
)


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](Data(spark, folder)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, "bench")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, folder, name)
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))[2:],
        "cpus": cores}))


if __name__ == "__main__":
    main()
