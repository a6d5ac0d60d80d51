"""Times the headline queries and prints one JSON line.

Each query runs to completion through the ``noop`` sink, which computes every row and
column without moving the result to the driver. A first untimed pass warms the JVM.
"""

from __future__ import annotations

import json
import os
import time

from stayledger.plans import catalog
from stayledger.session import local_session

HEADLINE = [
    "points_balances", "member_360", "tier_distribution", "direct_booking_share", "revenue_per_member",
    "member_growth", "churn", "clv", "campaign_performance", "chain_overview", "hotel_comparison",
    "hotel_comparison_literal", "fx_convert", "resolve_points_rule", "earn_points", "build_transactions",
    "post_earnings", "expire_points", "qualify_tiers", "audience_sample", "attribute_bookings",
    "sync_errors", "dedupe_payloads", "audit_diff", "fuzzy_members",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    queries = catalog.queries()

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    for name in HEADLINE:
        run(name)
    timings = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
