"""Time the warehouse build and the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of test tables and BENCH_CPUS the number of cores. The models
are timed as they are stored, each from its stored inputs; the analyses then run over the
stored tables, as a dashboard would run them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from bazarlytics.session import local_session
from catalog import ANALYSES, HISTORY, spark_queries, warehouse

HEADLINE = [
    *[name for name in ANALYSES if not name.endswith(("_list", "_filtered", "_long"))],
    "check_category_metrics",
    "check_seller_metrics",
    "check_missing_date_keys",
    "check_items_against_payments",
    "check_suite",
    *[name for name in HISTORY if name not in ("history_models", "history_runs")],
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    seconds: dict[str, float] = {}

    built = warehouse(spark, folder).build()
    seconds.update({f"build_{name}": spent for name, spent in built.items()})

    queries = spark_queries()
    for name in HEADLINE:
        began = time.monotonic()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = time.monotonic() - began
        print(f"{seconds[name]:7.2f} {name}", file=sys.stderr, flush=True)

    print(
        json.dumps(
            {
                "metric": "seconds to build the warehouse and run the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(spent, 3) for name, spent in seconds.items()},
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
