"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the local cores.
Each query runs once to warm up and then twice; the better run counts. Every
run computes all result columns, through Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from postulant.catalogue import all_queries
from postulant.session import local_session

HEADLINE = [
    "st_total", "st_job_month", "st_calendar", "st_date_range", "br_filters", "br_search", "br_collate_eq",
    "br_page", "br_after", "br_total", "mut_insert", "mut_update", "mut_delete", "tx_email", "tx_phone",
    "tx_address", "tx_names", "tx_redact", "js_defaults", "ing_candidates", "ing_prompts", "ing_insert",
    "ux_extract", "ing_stream", "bn_link", "mut_table", "mut_files", "ing_report",
    "br_jump", "mut_conflict", "ing_keys", "mut_compact", "st_maintained",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    queries = all_queries()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    result = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
