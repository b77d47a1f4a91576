"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
input and the cores.  Each query runs once to warm up, then three times; the
median counts.  Results go to the no-op sink, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
# Python workers import the package too, from whatever folder this is started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (HERE, os.environ.get("PYTHONPATH"))))

from tessera.plans import registry  # noqa: E402
from tessera.session import build_session  # noqa: E402

HEADLINE = (
    "usage_totals", "usage_by_layer", "usage_by_zoom", "usage_by_user", "upstream_consumption", "service_counters",
    "error_breakdown", "reconcile_access_log", "event_chunks", "measurement_payloads", "recent_events",
    "tile_bounds", "feature_tile_counts", "geohash_bounds", "cover_ranges", "seed_plan",
    "access_log", "resolved_layers", "redacted_urls", "expanded_urls", "permissions", "response_verdicts",
    "latest_tiles", "cache_lookup", "tiered_lookup", "snapshot_diff", "change_points", "missing_tiles", "first_fetches",
    "store_stats", "feature_tiles", "vector_tile_features", "vector_tile_parts", "limited_vector_tiles",
    "composite_vector_tiles", "clipped_lines", "geometry_tiles", "box_tiles",
    "blend_normal", "blend_resampled", "cropped", "effect_hue", "effect_gaussian", "effect_median", "effect_sobel",
    "effect_gaussian_large", "long_catalog", "stream_windows", "stream_first_fetches",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    queries, times = registry.queries(), {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
