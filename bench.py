"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder (default sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "agg01_market_stats",
    "agg03_price_histogram",
    "agg05_municipality_stats",
    "agg06_coverage_by_source",
    "srt02_page",
    "snk01_csv_properties",
    "snk03_geojson",
    "jn07_listing_summary",
    "txt01_price_by_source",
    "txt11_normalize_address",
    "fin08_roi",
    "fin09_scenario_grid",
    "sco08_composite",
    "sco09_batch",
    "jn03_normalized_address",
    "jn04_similar_address",
    "jn05_spatial_match",
    "jn06_match_cascade",
    "jn14_property_tiles",
    "jn16_risk_within_1km",
    "haz05_assessment",
    "win08_last_write",
    "ups01_properties",
    "ups09_job_lifecycle",
    "jn13_due_crawls",
    "jn21_gazetteer",
    "ext14_next_page",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from proplytics.plans import load_all
    from proplytics.plans.registry import QUERIES
    from proplytics.session import local_session

    load_all()
    spark = local_session(cpus, app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        # first run pays for class loading and code generation; the second is reported
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
