"""Timings of the headline queries; prints one JSON line.

    BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
    BENCH_RUNS    timed runs per query, the median counts (default 2)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scanloom.operators import filters as Q  # noqa: E402
from scanloom.plans import catalog  # noqa: E402
from scanloom.session import archive_session, new_folder  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "latest_per_key", "series_summary", "study_summary", "studies_index", "series_instances", "sort_studies",
    "middle_element", "first_instance", "hierarchy_navigate", "deduplicate", "recombine", "dedup_stats",
    "index_upsert", "new_instances_only", "set_consistency", "change_set", "consistency_round", "sync_plan",
    "pack_groups", "store_response", "match_failures", "job_status", "transfer_progress", "bulkdata_store",
    "frame_rows", "transcode_plan", "quantize_uint16", "export_cleanup", "collapse_pending", "settled_studies",
    "stream_ingest",
]


def main() -> None:
    spark = archive_session(
        f"local[{CPUS}]", CPUS,
        **{"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.sql.files.openCostInBytes": "524288"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(build) -> float:
        build().write.format("noop").mode("overwrite").save()
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return round(statistics.median(times), 3)

    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda n=name: catalog.QUERIES[n](spark, FOLDER))

    stored = new_folder(spark, "bench-index")
    catalog.QUERIES["studies_index"](spark, FOLDER).write.parquet(stored)
    params = {"PatientName": "*01*", "StudyDate": "19960101-19981231", "StudyDescription": ["BUILDING", "MACHINERY"]}
    required = ["patient_name", "study_date", "description"]
    seconds["qido_filter_on_index"] = timed(
        lambda: Q.qido_filter(spark.read.parquet(stored), params, required=required)
    )
    print(json.dumps({
        "metric": "archive_headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
