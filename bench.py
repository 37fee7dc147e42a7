"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is
run whole into Spark's noop sink, so no result passes through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimloom.session import build_session  # noqa: E402
from workload.registry import ALL  # noqa: E402

HEADLINE = (
    "kpi_panel", "carrier_scorecard", "contractor_ranking", "ageing", "update_frequency", "executive_observations",
    "weather_rollup", "claim_page", "row_classes", "reconciliation", "promoted_updates", "import_summary", "column_profile",
    "money_stats", "status_intervals", "invoice_balances", "payment_matches",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    ALL["ageing"][0](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        ALL[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
