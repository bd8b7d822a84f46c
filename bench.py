"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The JVM is warmed up first by the same queries on a tenth of the tables (not timed), so that the
figures show throughput rather than class loading and compilation. ``value`` is the time to
deduplicate all rows into Silver and to compute the fourteen marts from it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tenderlake.plans import catalog, ledger
from tenderlake.plans.marts import MART_NAMES
from tenderlake.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_UP_DIR = "/root/testdata/sf0.01"
CPUS = os.environ.get("BENCH_CPUS", "8")
OTHERS = (
    "canonical_contracts", "base_columns", "latest_events", "find_by_supplier_text", "find_by_tax_id",
    "find_with_files", "find_documents", "stats_total", "stats_suppliers", "stats_years",
    "search_index", "search_summary", "period_kpis", "supplier_ranking", "era_contrast",
    "exact_median_of_events", "feed_records",
)


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = local_session(
        "bench", CPUS, **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g"}
    )
    queries = catalog.queries()

    def run(name: str, folder: str = SF_DIR) -> None:
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    if os.path.isdir(WARM_UP_DIR):
        for name in (*MART_NAMES, *OTHERS):
            run(name, WARM_UP_DIR)
    times = {"silver_build": timed(lambda: ledger.silver(spark, SF_DIR))}
    times |= {name: timed(lambda: run(name)) for name in (*MART_NAMES, *OTHERS)}
    rebuild = round(sum(times[name] for name in ("silver_build", *MART_NAMES)), 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "marts_rebuild",
        "value": rebuild,
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
        "spark": spark.version,
        "cpus": CPUS,
        "warm_up": WARM_UP_DIR,
    }))


if __name__ == "__main__":
    main()
