"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Each query is run
to the end through the no-op sink, twice; the better time counts, so that the
compilation of the first run is not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tierloom import plans  # noqa: E402,F401
from tierloom.plans.registry import QUERIES  # noqa: E402
from tierloom.session import local_session  # noqa: E402

HEADLINE = [
    "c05_wrist_speed", "c08_detect_segments", "c08_detect_segments_sensitive", "c09_detect_in_segments",
    "c13_norm_xy_velocity", "c16_four_streams", "c17_sliding_windows", "c22_speed_resample", "a20_segment_export",
    "b03_merge_near_duplicates", "b04_merge_short", "h01_anchored_windows", "d04_normalise_word", "e01_quality_filter",
    "i04_split_sizes", "f06_merge_harvest", "f14_longest_suffix", "g11_per_class_metrics", "h04_similarity_search",
    "j08_batch_inference",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
